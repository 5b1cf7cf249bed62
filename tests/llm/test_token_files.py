import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import token_files as tf
from tessera.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, source string, start string, ids_crc32 long"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_packing_round_trip(bits, values):
    ids = np.array([v & ((1 << bits) - 1) for v in values], dtype=np.uint32)
    assert tf.unpack(tf.pack(ids, bits), bits, len(ids)).tolist() == ids.tolist()
    assert len(tf.pack(ids, bits)) == -(-len(ids) * bits // 8)


def test_packing_refuses_large_ids():
    with pytest.raises(ValueError):
        tf.pack(np.array([8]), 3)
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_shard_random_access(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(tf, "BLOCK", 64)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n, dtype=np.uint32) for n in (0, 1, 63, 64, 65, 1000, 7)]
    store = fs.LocalFileSystem()
    w = tf.ShardWriter(store.open_output_stream(str(tmp_path / "s.bin")), 13)
    for d in docs:
        w.add(d)
    w.close()
    with store.open_input_file(str(tmp_path / "s.bin")) as f:
        r = tf.ShardReader(f)
        for k in (5, 0, 3, 6, 2, 1, 4):
            assert r.document(k).tolist() == docs[k].tolist()
        whole = np.concatenate(docs)
        assert r.ids(100, 300).tolist() == whole[100:400].tolist()
        assert np.concatenate([ids for _, _, ids in r.runs(200)]).tolist() == whole.tolist()


TEXTS = ["", " ", "a", " a ", "a  b", "\n a\n b", "x <|endoftext|> y", "é 日本語　z", "it's 9.5%,\tok", "\x1c a \x85 b", "a \n\nb", "word " * 50]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", ".", " ", " ", "\n", "\t", "'s", "9", "the", " "]), max_size=30))
def test_pieces_equal_the_library(parts):
    e = tf.encoder(tokenizer_path())
    text = "".join(parts)
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_texts(name):
    e = tf.Encoder(tokenizer_path(name))
    for text, got in zip(TEXTS, e.encode(TEXTS), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_full_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(tf, "KEPT_PIECES", 3)
    e = tf.Encoder(tokenizer_path())
    for text in ("one two three four five", "six two seven one"):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(e.kept) <= 3


def test_digest(spark):
    rows = [(5, "five words", "s", "x", 1), (2, None, None, None, 2), (None, "no id", "s", "y", 3), (5, "five words", "s", "x", 4), (9, "long " * 30_000, "s", "z", 5)]
    out = {}
    for r in tf.token_digest(spark.createDataFrame(rows, SCHEMA), tokenizer_path()).collect():
        out.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    e = tf.encoder(tokenizer_path())
    at = 0
    for doc_id, text in ((None, "no id"), (2, ""), (5, "five words"), (5, "five words"), (9, "long " * 30_000)):
        ids = np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (at, len(ids), zlib.crc32(ids.tobytes())) in out[doc_id]
        at += len(ids)
    assert sum(map(len, out.values())) == len(rows)
    assert tf.token_digest(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0


def test_ids_come_back(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    _, shards = tf.write_tokens(df, tokenizer_path())
    r = tf.read_tokens(spark, shards, with_ids=True).first()
    assert list(r.ids) == [*tf.encoder(tokenizer_path()).tokenizer.encode("a b c").ids, 2]


def test_a_store_that_does_not_replace_files(tmp_path):
    from pyarrow import fs

    from tessera.llm.shared import put_in_place

    class Strict:
        inner = fs.LocalFileSystem()
        get_file_info, delete_file = inner.get_file_info, inner.delete_file

        def move(self, a, b):
            if self.inner.get_file_info(b).type == fs.FileType.File:
                raise OSError("it exists")
            self.inner.move(a, b)

    for text in ("first", "second"):
        (tmp_path / "hidden").write_text(text)
        put_in_place(Strict(), str(tmp_path / "hidden"), str(tmp_path / "file"))
    assert (tmp_path / "file").read_text() == "first" and not (tmp_path / "hidden").exists()
    with pytest.raises(OSError):
        put_in_place(Strict(), str(tmp_path / "none"), str(tmp_path / "other"))
