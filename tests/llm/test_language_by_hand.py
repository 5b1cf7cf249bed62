"""The hierarchical identifier against one made by hand: margins, votes and the machines' optimum; features of spans."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import language_id as li


def by_hand(model, x):
    """The family with the largest margin, then every pair of its languages asked one after another."""
    out = []
    for row in np.hstack([x, np.ones((len(x), 1), np.float32)]):
        margins = [float(row @ w) for w in model.by_family]
        f = max(range(len(margins)), key=lambda k: margins[k])
        members = [k for k, c in enumerate(model.languages) if li.family(c) == model.families[f]]
        votes = dict.fromkeys(members, 0.0)
        for a, b, w in model.pairs[f]:
            p = 1 / (1 + np.exp(-li.SLOPE * np.clip(float(row @ w), -20, 20)))
            votes[a] += p
            votes[b] += 1 - p
        out.append(max(members, key=lambda k: votes[k]))
    return out


def samples(seed, n=40):
    rng = np.random.default_rng(seed)
    words = {"de": "der und nicht schon über straße", "en": "the and not with over street", "es": "el y no con sobre calle", "fr": "le et pas avec sur rue", "pt": "o e não com sobre rua"}
    texts, y = [], []
    for k, (_, v) in enumerate(sorted(words.items())):
        for _ in range(n):
            texts.append(" ".join(rng.choice(v.split(), 12)))
            y.append(k)
    return sorted(words), li.features(pa.array(texts, pa.large_string())), np.array(y)


def test_predictions_equal_those_by_hand():
    languages, x, y = samples(1)
    model = li.Model(languages, x, y)
    _, other, truth = samples(2)
    got, score = model.predict(other)
    assert got.tolist() == by_hand(model, other)
    assert (got == truth).mean() > 0.97 and ((score >= 0) & (score <= 1)).all()


def test_machines_reach_the_optimum():
    """Dual coordinate descent against gradient descent on the squared hinge loss."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=120) > 0.4, 1.0, -1.0)
    full = np.hstack([x, np.ones((len(x), 1))])
    cost = li.PENALTY * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    loss = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (full @ w)) ** 2).sum()
    w = np.zeros(7)
    for _ in range(20_000):
        short = np.maximum(0, 1 - y * (full @ w))
        w -= 2e-5 * (w - 2 * (cost * short * y) @ full)
    assert loss(li.fit_machine(x, y).astype(float)) <= loss(w) * 1.01


@pytest.mark.parametrize("span", [1, 3, 7, 1 << 20])
def test_features_of_spans(monkeypatch, span):
    texts = ["Der Bär", "", "naïve — text", "a", " \n", "x" * 50 + " yz " * 9, "tail"]
    whole = li.features(pa.array(texts, pa.large_string()))
    monkeypatch.setattr(li, "SPAN_BYTES", span)
    assert (li.features(pa.array(texts, pa.large_string())) == whole).all()
    for k, t in enumerate(texts):
        counts = {}
        b = t.encode()
        folded = [c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in b]
        for i, c in enumerate(folded):
            before, after = folded[i - 1] if i else 32, folded[i + 1] if i + 1 < len(b) else 32
            if c == 32 and 32 in (before, after):
                continue
            code = ((before << 16 | c << 8 | after) * 0x9E3779B1 & 0xFFFFFFFF) >> 20
            counts[code] = counts.get(code, 0) + 1
        total = sum(counts.values())
        assert {j: pytest.approx((n / total) ** 0.5, rel=1e-6) for j, n in counts.items()} == {j: float(whole[k, j]) for j in np.flatnonzero(whole[k])}


def test_dirty_languages_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 2)
    rows = [(i, "der und nicht schon" if i % 2 else "the and not with", "de" if i % 2 else "en") for i in range(80)] + [(100 + i, "noise", f"odd{i}") for i in range(30)]
    rows += [(200, None, "de"), (200, "123", None), (201, "the and " * 600_000, None), (201, "the and not", None), (201, "the and not", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    out = li.language_id(df).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} <= {"de", "en", "und"}
    assert {r.lang_pred for r in out if r.doc_id == 200} == {"und"} and {r.lang_pred for r in out if r.doc_id == 201} == {"en"}
    assert li.language_id(df.limit(0)).count() == 0
