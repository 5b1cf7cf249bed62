import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.plans.search import Engine, SearchConfig, structural_problems
from tessera.sources import audio, tables
from tessera.sources.release import activate, active, build_release, embeddings_with_reuse, load_index, save_index, validate_release
from tessera.streaming import ingest


def corpus(spark):
    words = ["alpha beta gamma", "beta delta", "gamma epsilon zeta", "eta theta iota", "kappa lambda", ""]
    rows = [(f"v{i // 2}_{i % 2:04d}", f"v{i // 2}", i % 2, 45.0 * (i % 2), 45.0 * (i % 2) + 60, x, bool(x)) for i, x in enumerate(words)]
    return spark.createDataFrame(rows, "window_id string, video_id string, window_index int, start_s double, end_s double, retrieval_text string, eligible boolean")


def test_release_and_search(spark, tmp_path):
    root = f"file://{tmp_path}"
    rel = build_release(spark, corpus(spark), root, "r1", plugins.encode)
    assert validate_release(rel) == [] and rel.manifest["eligible"] == 5
    activate(spark, root, "r1")
    assert active(spark, root).manifest == rel.manifest
    with pytest.raises(FileExistsError):
        build_release(spark, corpus(spark), root, "r1", plugins.encode)
    q = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "kappa lambda")], "query_id string, query_text string")
    out = Engine(rel, config=SearchConfig(top_k=3)).search(q)
    assert structural_problems(out, 3).count() == 0
    best = {r.query_id: r for r in out.where("rank = 1").collect()}
    assert best["q1"].video_id == "v0" and best["q2"].video_id == "v2"
    assert best["q1"].windows[0].window_id == "v0_0000"
    first = Engine(rel, config=SearchConfig(first_stage_only=True)).search(q).collect()
    assert len(first) == 6 and all(r.final_score is None for r in first)
    again = build_release(spark, corpus(spark), root, "r2", plugins.encode, previous=rel)
    assert sorted(map(tuple, again.vectors.select("window_id", "identity").collect())) == sorted(map(tuple, rel.vectors.select("window_id", "identity").collect()))
    seen = []

    def count(rows):
        seen.append(rows.count())
        return plugins.encode(rows)

    changed = corpus(spark).withColumn("retrieval_text", F.when(F.col("window_id") == "v0_0000", "new words").otherwise(F.col("retrieval_text")))
    assert embeddings_with_reuse(changed, count, rel.vectors).count() == 5 and seen == [1]
    with pytest.raises(ValueError):
        SearchConfig(video_k=0)


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b", "a"], True)], "doc_id long, terms array<string>, eligible boolean")
    save_index(docs, f"file://{tmp_path}/i")
    assert sorted((r.term, r.tf) for r in load_index(spark, f"file://{tmp_path}/i").collect()) == [("a", 2), ("b", 1)]


def test_docx(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda x: f"<w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:tbl><w:tr>{cell('R1-2')}{cell('KIS')}{cell('text')}</w:tr><w:tr>{cell('other')}</w:tr></w:tbl></w:body></w:document>"
    with zipfile.ZipFile(tmp_path / "q.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    rows = tables.read_docx_queries(spark, f"file://{tmp_path}/q.docx").collect()
    assert [tuple(r) for r in rows] == [("R1-2", "KIS", "text", "", "", "")]


def test_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("﻿video_name,x\nL01_V001.mp4,1\n,2\n", encoding="utf-8")
    assert [r.video_id for r in tables.read_inventory(spark, f"file://{tmp_path}/i.csv").collect()] == ["L01_V001"]
    (tmp_path / "fps.json").write_text(json.dumps({"L01_V001": 25.0, "bad id!": 30, "L01_V002": -1}))
    assert [(r.video_id, r.fps) for r in tables.read_fps(spark, f"file://{tmp_path}/fps.json").collect()] == [("L01_V001", 25.0)]
    assert [r.stem for r in tables.scan_files(spark, f"file://{tmp_path}", "*.csv").collect()] == ["i"]
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "x double")
    assert sorted(x.x or 0 for x in tables.clean_numbers(nan).collect()) == [0, 0, 1.0]
    s = spark.createDataFrame([("q", "m", 1.0)], "query_id string, method_id string, score double")
    tables.save_scores(s, f"file://{tmp_path}/c", "1", "id")
    assert tables.load_scores(spark, f"file://{tmp_path}/c", "1", "id").count() == 1
    with pytest.raises(ValueError):
        tables.load_scores(spark, f"file://{tmp_path}/c", "1", "other")


def test_audio(spark):
    t = np.arange(48_000) / 48_000
    tone = np.rint(8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    content = audio.write_wav(tone, 48_000)
    low = audio.canonical(content)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert len(low) == 16_000 and np.abs(low[200:-200] - want[200:-200]).max() < 100
    assert audio.mono(np.array([[1, 2], [32767, 32767]])).tolist() == [2, 32767]
    files = spark.createDataFrame([("a", audio.write_wav(np.arange(100)))], "video_id string, content binary")
    windows = spark.createDataFrame([("a", "a_0", 0, 60), ("a", "a_1", 45, 100), ("b", "b_0", 0, 1)], "video_id string, window_id string, sample_start long, sample_end long")
    assert {r.window_id: r.duration_samples for r in audio.window_digests(files, windows).collect()} == {"a_0": 60, "a_1": 55, "b_0": 0}
    bad = spark.createDataFrame([("x", b"no audio")], "path string, content binary")
    assert audio.probe(bad).first().error


def test_plugins(spark):
    class Flaky:
        def load(self): ...
        def transcribe(self, content):
            if content == b"bad":
                raise RuntimeError("broken")
            return {"text": "fine"}

    rows = spark.createDataFrame([("a", b"x"), ("b", b"bad")], "window_id string, content binary")
    assert {r.window_id: r.status for r in plugins.transcribe(rows, Flaky).collect()} == {"a": "ok", "b": "failed"}
    calls = []

    def hungry(items):
        calls.append(len(items))
        if len(items) > 2:
            raise MemoryError
        return items

    assert plugins.halving(hungry, list(range(5))) == list(range(5)) and calls[0] == 5
    plugins.register("flaky", Flaky)
    assert plugins.registered("flaky") is Flaky
    with pytest.raises(KeyError):
        plugins.registered("none")


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    line = {"window_id": "a", "video_id": "v", "start_s": 0.0, "end_s": 60.0, "status": "ok", "raw_text": "5 ký", "arrived": "2024-01-01T00:00:00Z"}
    (source / "0.json").write_text("\n".join(json.dumps(x) for x in (line, line, line | {"window_id": "b", "status": "failed"})))
    q = ingest.write_staging(ingest.transcript_stream(spark, f"file://{source}"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination()
    rows = {r.window_id: r for r in ingest.latest(spark.read.parquet(f"file://{tmp_path}/out")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].retrieval_text == "5 kg" and rows["a"].eligible and not rows["b"].eligible


def test_event_windows(spark):
    ev = spark.sql("select timestamp'2024-01-01 00:00:50' ts, 'x' event_type, 1.0D value union all select timestamp'2024-01-01 00:00:10', 'x', 2.0D")
    assert ingest.event_windows(ev).agg(F.sum("n")).first()[0] == 4  # each event lies in two windows


def test_command_line(spark, tmp_path, capsys):
    from tessera.__main__ import main

    build_release(spark, corpus(spark), f"file://{tmp_path}", "r", plugins.encode)
    assert main(["validate", f"file://{tmp_path}/r"]) == 0
    assert main(["search", f"file://{tmp_path}/r", "alpha", "--top-k", "2"]) == 0
    assert '"rank": 1' in capsys.readouterr().out


