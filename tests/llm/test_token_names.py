"""Names are told apart in arrays: ids equal the library's, and each distinct name of a step goes to the library once."""

import random

import numpy as np

from tessera.llm import token_files as tf
from tessera.llm.queries import tokenizer_path


def test_ids_and_names(monkeypatch):
    monkeypatch.setattr(tf, "KEPT_PIECES", 3)
    enc = tf.Encoder(tokenizer_path())
    pick = random.Random(4)
    names = ["", "", "a", "B", "né", "日本", "don't", "x1", "\nz", "\t", "12.5", "w" * 100]
    texts = [" ".join(pick.choice(names) for _ in range(pick.randrange(0, 30))) for _ in range(400)] + ["", " ", "a", " a", "a ", "<|endoftext|> a"]
    asked: list[list[str]] = []  # by call; calls for a part of the names that were asked for are among them
    spaced = enc._spaced
    monkeypatch.setattr(enc, "_spaced", lambda x: asked.append(x) or spaced(x))
    for _ in range(2):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in enc.encode(texts)]
        assert got == [enc.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(enc.kept) <= 3
    assert all(len(x) == len(set(x)) and "." not in x for x in asked)  # no name in place of the texts' first pieces


def test_steps_are_large():
    """A worker that can keep no more encodes a name once a step, so steps are larger than those of other operators."""
    assert tf.STEP_BYTES > tf.slices.__defaults__[0]
