"""Language identification by hierarchical discrimination.

A text is first given to a language family, by one linear support vector machine per family against the rest, and
then to a language of that family, by one-versus-one linear support vector machines. Features are the square roots
of the relative frequencies of hashed byte trigrams of the whole lower-cased text, so they have unit length.

Training uses at most about TRAIN_ROWS labelled documents of each language, TRAIN_TOTAL of all, of the LANGUAGES
languages with the most labelled documents (documented bounds; documents are picked by a hash, evenly over the table).
Their features are gathered on the driver: at most TRAIN_TOTAL * DIM floats, whatever stands in the lang column.
Prediction is one scan without a shuffle; the weights, one row of DIM floats per machine, are broadcast.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, slices, text_array
from tessera.llm.textvec import raw_bytes

DIM = 1 << 12
TRAIN_ROWS, TRAIN_TOTAL, LANGUAGES = 300, 30_000, 200
#: Bytes whose features are made at a time.
SPAN_BYTES = 2 << 20
#: Rows whose features are held at a time.
MOST_ROWS = 1024
UNDECIDED = "und"
#: Passes of dual coordinate descent at most, the gradient at which it ends, and the machines' penalty.
PASSES, NEAR, PENALTY = 300, 1e-2, 10.0
#: Slope from a machine's margin to a probability.
SLOPE = 4.0

# Language families by ISO 639 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "austronesian": "id jv ms tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

# bytes to the classes that features see: letters lower-cased, everything else in ASCII one space
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(code: str) -> str:
    return FAMILY_OF.get(code.lower().replace("_", "-").split("-")[0], f"of {code}")


def features(texts: pa.LargeStringArray) -> np.ndarray:
    """A row of DIM floats of unit length for each text, all 0 for one without bytes."""
    data, offsets = raw_bytes(texts)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, DIM), dtype=np.float32)
    counts = np.zeros(n * DIM, dtype=np.int64)
    starts = np.zeros(len(data) + 1, dtype=bool)
    starts[offsets] = True
    for low in range(0, len(data), SPAN_BYTES):
        high = min(len(data), low + SPAN_BYTES)
        b = _FOLD[data[max(0, low - 1) : high + 1]].astype(np.uint32)  # with a byte on either side
        own = b[low > 0 :][: high - low]
        fresh = starts[low : high + 1]
        before = np.where(fresh[:-1], np.uint32(0x20), b[: high - low] if low else np.concatenate([b[:1], own[:-1]]))
        after = np.where(fresh[1:], np.uint32(0x20), b[(low > 0) + 1 :][: high - low] if high < len(data) else np.concatenate([own[1:], own[-1:]]))
        code = ((before << np.uint32(16)) | (own << np.uint32(8)) | after) * np.uint32(0x9E3779B1) >> np.uint32(20)
        keep = ~((own == 0x20) & ((before == 0x20) | (after == 0x20)))
        first, last = np.searchsorted(offsets, low, side="right") - 1, np.searchsorted(offsets, high)
        text = np.repeat(np.arange(first, last, dtype=np.int64) * DIM, np.diff(np.clip(offsets[first : last + 1], low, high)))
        place = (text + code)[keep]
        part = np.bincount(place - first * DIM, minlength=(last - first) * DIM)
        counts[first * DIM : last * DIM] += part
    counts = counts.reshape(n, DIM)
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1)).astype(np.float32)


def _parts(texts: pa.LargeStringArray):
    """Row ranges of bounded bytes and of at most MOST_ROWS rows, a row of features each."""
    for a, b in slices(texts):
        for low in range(a, b, MOST_ROWS):
            yield low, min(b, low + MOST_ROWS)


def fit_machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine with squared hinge loss, y of -1 and 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * PENALTY * share)
    norm = np.einsum("ij,ij->i", x, x) + slack
    a, w = np.zeros(len(x)), np.zeros(x.shape[1], np.float32)
    order = np.random.default_rng(0)
    for _ in range(PASSES):
        far = 0.0
        for i in order.permutation(len(x)):
            g = y[i] * float(x[i] @ w) - 1 + a[i] * slack[i]
            far = max(far, abs(g) if a[i] > 0 else -g)
            new = max(0.0, a[i] - g / norm[i])
            if new != a[i]:
                w += np.float32((new - a[i]) * y[i]) * x[i]
                a[i] = new
        if far < NEAR:
            break
    return w


class Model:
    """Machines of the families, and of the pairs of languages inside each."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.families = sorted({family(c) for c in languages})
        inside = np.array([self.families.index(family(c)) for c in languages])
        self.members = [np.flatnonzero(inside == f).tolist() for f in range(len(self.families))]
        of = inside[y] if len(y) else y
        self.by_family = [fit_machine(x, np.where(of == f, 1.0, -1.0)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [[(a, b, fit_machine(x[(y == a) | (y == b)], np.where(y[(y == a) | (y == b)] == a, 1.0, -1.0))) for a, b in combinations(m, 2)] for m in self.members]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score) of each row."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        sure = lambda margin: 1 / (1 + np.exp(-SLOPE * np.clip(margin, -20, 20)))
        if self.by_family:
            margins = x @ np.stack(self.by_family, axis=1)
            chosen, score = margins.argmax(axis=1), sure(margins.max(axis=1))
        else:
            chosen, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        language = np.zeros(len(x), dtype=int)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            votes, least = np.zeros((len(rows), len(self.languages))), np.ones((len(rows), len(self.languages)))
            for a, b, w in self.pairs[f]:
                p = sure(x[rows] @ w)
                votes[:, a] += p
                votes[:, b] += 1 - p
                least[:, a] = np.minimum(least[:, a], p)
                least[:, b] = np.minimum(least[:, b], 1 - p)
            best = np.array(members)[votes[:, members].argmax(axis=1)]
            language[rows] = best
            score[rows] *= least[np.arange(len(rows)), best]
        return language, score


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the remainder `part`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def train(docs: DataFrame) -> Model | None:
    """A model of the languages in docs.lang, or None without labelled text."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    each = min(TRAIN_ROWS, TRAIN_TOTAL // len(sizes))
    share = F.lit(0)
    for c in languages:
        share = F.when(F.col("lang") == c, int(min(1.0, each / sizes[c]) * 1_000_000)).otherwise(share)
    some = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share).select("text", "lang")

    def measure(batches):
        for batch in batches:
            texts = text_array(batch)
            rows = [v.tobytes() for a, b in _parts(texts) for v in features(texts.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["lang", "x"])

    rows = sorted((r.lang, bytes(r.x)) for r in some.mapInArrow(lean(measure), "lang string, x binary").collect())
    seen = sorted({c for c, _ in rows})
    if not seen:
        return None
    x = np.frombuffer(b"".join(v for _, v in rows), dtype=np.float32).reshape(-1, DIM)
    return Model(seen, x, np.array([seen.index(c) for c, _ in rows]))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The language of every whole text: one row per input row with doc_id, lang_pred and score.

    A text that is null or has no letter is `und` with score 0, as is every text if there is no model. Of machines or
    languages with equal margins the first by name wins; very long texts are read whole; repeated rows get the same
    answer; a table without rows gives none; only doc_id and text are read, whatever other columns are called.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = held.value
        for batch in batches:
            texts = text_array(batch)
            language, score = [], []
            for a, b in _parts(texts):
                part = texts.slice(a, b - a)
                lettered = np.array([any(map(str.isalpha, t.as_py())) for t in part])
                if m is None:
                    language += [UNDECIDED] * (b - a)
                    score += [0.0] * (b - a)
                    continue
                k, p = m.predict(features(part))
                language += [m.languages[x] if ok else UNDECIDED for x, ok in zip(k.tolist(), lettered.tolist(), strict=True)]
                score += np.where(lettered, np.clip(p, 0.0, 1.0), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(predict), f"doc_id {kind}, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
