"""Sources, releases and checks that reports stand on; plug-ins that run out of memory."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import plugins
from tessera.operators import governance as g
from tessera.sources import audio, tables
from tessera.sources.release import build_release, load_release, read_text, validate_release, write_text


def test_smaller_batches_of_the_whole_list():
    seen = []

    def call(items):
        seen.append(len(items))
        if len(items) > 8:
            raise MemoryError
        return [x * 2 for x in items]

    assert plugins.descending(call, list(range(20))) == ([2 * x for x in range(20)], 8, 2) and seen == [20, 16, 8, 8, 4]
    assert plugins.preflight(call, 1) == 8
    with pytest.raises(MemoryError):
        plugins.descending(call, list(range(20)), (16, 9))
    plugins.warm_up(plugins.BagScorer())
    plugins.warm_up(plugins.HashEncoder())
    assert plugins.checked_scores([[1.0], 2], 2) == [1.0, 2.0]
    for bad in ([1.0], [1.0, float("nan")]):
        with pytest.raises(ValueError):
            plugins.checked_scores(bad, 2)


def test_release_files_are_checked(spark, tmp_path):
    rows = [("v_0", "v", 0, 0.0, 60.0, "alpha beta", True), ("v_1", "v", 1, 45.0, 90.0, "", False)]
    w = spark.createDataFrame(rows, "window_id string, video_id string, window_index int, start_s double, end_s double, retrieval_text string, eligible boolean")
    r = build_release(spark, w, f"file://{tmp_path}", "r", plugins.encode)
    assert validate_release(r) == []
    manifest = json.loads(read_text(spark, f"{r.path}/manifest.json"))
    manifest["digests"]["vectors"]["digest"] = "0"
    write_text(spark, f"{r.path}/manifest.json", json.dumps(manifest))
    again = load_release(spark, r.path)
    assert validate_release(again) == ["the files of vectors are not the manifest's"] and validate_release(again, hashes=False) == []


def test_score_cache_checks_its_ids(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1, "w", 0.5), ("m", 2, "w", 0.1)], "method_id string, query_id long, window_id string, score double")
    root = f"file://{tmp_path}"
    tables.save_scores(rows, root, "3", "made of this")
    assert tables.load_scores(spark, root, "3", "made of this").count() == 2
    with pytest.raises(ValueError):
        tables.load_scores(spark, root, "3", "made of that")
    rows.limit(1).write.mode("overwrite").partitionBy("method_id").parquet(f"{root}/stage=3")
    with pytest.raises(ValueError):
        tables.load_scores(spark, root, "3", "made of this")


def test_lines_that_are_no_objects(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n[1]\n{"x": 2}\nnope\n')
    got = [(r.line, r.text) for r in tables.bad_lines(spark, f"file://{tmp_path}/a.jsonl", "x int").orderBy("line").collect()]
    assert got == [(3, "[1]"), (5, "nope")]


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["a", "b"])], "x int, y array<string>")
    tables.write_reports({"one": rows, "two": rows.drop("y")}, f"file://{tmp_path}/r", {"best": "one"})
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/r/one").first().y == '["a","b"]'
    assert json.loads(read_text(spark, f"file://{tmp_path}/r/comparison.json")) == {"best": "one"}


def test_prerequisites_and_configuration(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    kept = g.frozen(a, ["t", "id"])
    assert g.prerequisite_problems({"a": a.orderBy(F.desc("id"))}, {"a": kept, "b": kept}) == ["b is missing"]
    assert g.prerequisite_problems({"a": a.where("id = 1")}, {"a": kept}) == ["a is not the frozen table"]
    assert g.prerequisite_problems({"a": a.drop("t")}, {"a": kept}) == ["a lacks t"]
    config = {"stage": {"k": 3, "kind": "x"}}
    assert g.config_problems(config, {"stage.k": (3, 5), "stage.kind": ("y",), "stage.none": ()}) == ["stage.kind is 'x', not one of ['y']", "stage.none is missing"]


def test_media_that_is_no_wav(spark):
    rows = spark.createDataFrame([("a.wav", bytearray(b"RIFFxx")), ("b.mp4", bytearray(b"film")), ("c.mp4", bytearray(b"bad"))], "path string, content binary")

    def decode(content):
        if content == b"bad":
            raise ValueError("no audio")
        return b"RIFF" + content

    got = {r.path: (bytes(r.content) if r.content else None, r.error) for r in audio.extract(rows, decode).collect()}
    assert got == {"a.wav": (b"RIFFxx", None), "b.mp4": (b"RIFFfilm", None), "c.mp4": (None, "no audio")}
    with pytest.raises(FileNotFoundError):
        audio.command("no-such-program-here")
    assert audio.command("cat", content=b"x") == b"x"
