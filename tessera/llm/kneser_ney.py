"""Quality classification by a language model of trusted text.

An interpolated modified Kneser-Ney model of words (orders 1 to 3, discounts by count 1, 2 and 3 or more, from the
counts of counts; lower orders by continuation counts; the unigram interpolated with the uniform distribution) is
trained on documents that labels call good. A document is rejected
if its perplexity is above its language's threshold: a quantile over the trusted documents of the language that the
model was not trained on, times a margin.

Counts and scores are sharded joins of n-gram keys. A trie of ngram_trie holds every n-gram of the training texts and
its occurrences, in shards by key. Each trigram is then a row (bigram of its last two words, 1), which the tasks of the
trigrams' shards deal to the bigrams' shards, where they are summed to continuation counts; each bigram is a row (last
word, 1) in the same way. A shard has beside it, for each context, the sum of its children's counts and how many are 1, 2
and more; with the discounts, which follow from the shards' counts of counts, that gives every share and weight exactly.
Each batch of documents joins its distinct n-grams with the shards: a bit sieve drops the absent ones, a successor search
finds the rest.

Shape: tasks hand on one compressed block of sorted keys a shard; no shard follows a frequent word, as a context may span
shards. The driver sees a dozen numbers a shard. Documents are scanned once for scores and are not shuffled;
only (doc_id, language, perplexity) meets the labels, and thresholds are an aggregate.

The model is trained on every document of one half of the trusted ones, by a hash of doc_id; thresholds come from every
document of the other half, as a text's perplexity under a model that has seen it says nothing about others. TRAIN_ROWS
may be set to train on about that many, the same number of each language where there are as many.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import ngram_trie
from tessera.llm.ngram_trie import ORDER, STEP_BYTES, Level, Reader, Sums, Trie, _arrays, _by_range, _hand_on, _merged_buckets, _part, _passes, _sieve, _steps, _write, distinct, spans, token_hashes
from tessera.llm.shared import checkpoint_root, lean, shared_folder, slices, text_array
from tessera.llm.textvec import combine, mix64

#: Training documents, about; None: all.
TRAIN_ROWS: int | None = None
#: Trusted documents up to which their ids are broadcast; beyond, texts are joined once by shuffle and written.
BROADCAST_IDS = 3_000_000
#: Shards of a model in memory; n-grams of a file's shard, about.
SHARDS, SHARD_ENTRIES = 16, 4_000_000
#: What the name of a shard's own file adds to the trie's.
OWN = "-kn"
#: Quantile of the trusted perplexities, and the factor on it.
QUANTILE, MARGIN = 0.99, 1.25
#: Trusted documents of a language from which it has a threshold of its own.
LEAST_TRUSTED = 20
#: Languages up to which their shares of the training documents are broadcast, and thresholds too.
BROADCAST_LANGUAGES = 10_000


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of one occurrence of each, and their counts."""
    value, at, count = np.unique(keys, return_index=True, return_counts=True)
    return value, at, count.astype(np.float64)


def _discounts(count: np.ndarray) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more."""
    n = [float((count == k).sum()) for k in (1, 2, 3, 4)]
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(d, 0.05, [0.95, 1.95, 2.95])])


def _discounted(of: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of n-grams in their contexts after the discount, the contexts, and the mass each gives to lower orders."""
    d = _discounts(count)[np.minimum(count, 3).astype(int)]
    context, place = np.unique(of, return_inverse=True)
    total = np.bincount(place, weights=count, minlength=len(context))
    given = np.bincount(place, weights=d, minlength=len(context))
    return (count - d) / total[place], context, given / np.maximum(total, 1)


@dataclass
class Model:
    """A model in memory: sorted keys and their values in shards by the keys' top bits, and the shards' sieves.
    given: the weight of the uniform distribution below the unigrams, of which each word has `uniform`."""

    shards: list[tuple[np.ndarray, np.ndarray]]
    given: float
    uniform: float
    sieves: tuple[np.ndarray, ...] = ()

    @classmethod
    def train(cls, texts: list[np.ndarray]) -> Model:
        """From the token hashes of each text."""
        hashes = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        depth = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        uni, bi, tri = _keys(hashes)
        on2, on3 = np.flatnonzero(depth >= 1), np.flatnonzero(depth >= 2)
        _, at3, c3 = _counts(tri[on3])
        at3 = on3[at3]
        share3, context3, given3 = _discounted(bi[at3 - 1], c3)
        # a bigram counts by the words before it; one that opens a text, which none precedes, by its occurrences
        opens = on2[depth[on2] == 1]
        _, at2, c2 = _counts(np.concatenate([bi[at3], bi[opens]]))
        at2 = np.concatenate([at3, opens])[at2]
        share2, context2, given2 = _discounted(uni[at2 - 1], c2)
        starts = first[:-1][np.diff(first) > 0]
        _, at1, c1 = _counts(np.concatenate([uni[at2], uni[starts]]))
        at1 = np.concatenate([at2, starts])[at1]
        share1, _, given1 = _discounted(np.zeros(len(at1), np.uint64), c1)
        parts = [(uni[at1], share1), (bi[at2], share2), (tri[at3], share3), (_context_key(context2), given2), (_context_key(context3), given3)]
        key, value = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        order = np.argsort(key)
        key, value = key[order], value[order]
        cuts = np.searchsorted(_by_range(key, SHARDS), np.arange(SHARDS + 1))
        shards = [(key[a:b], value[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return cls(shards, float(given1[0]) if len(given1) else 1.0, 1.0 / (len(at1) + 1), tuple(_sieve(k) for k, _ in shards))

    def join(self, keys: np.ndarray, missing: float) -> np.ndarray:
        """The value of each key, `missing` for absent ones."""
        out = np.full(len(keys), missing)
        shard = _by_range(keys, len(self.shards))
        for k in range(len(self.shards)):
            at = np.flatnonzero(shard == k) if len(self.shards) > 1 else np.arange(len(keys))
            have, values = self.shards[k]
            if not len(at) or not len(have):
                continue
            at = at[_passes(self.sieves[k], keys[at])]
            value, back = distinct(keys[at])
            place = np.minimum(np.searchsorted(have, value), len(have) - 1)
            out[at] = np.where(have[place] == value, values[place], missing)[back]
        return out

    def probabilities(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token given up to two before it in its text."""
        depth = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
        uni, bi, tri = _keys(hashes)
        p = self.join(uni, 0.0) + self.given * self.uniform
        for k, key, context in ((1, bi, uni), (2, tri, bi)):
            on = np.flatnonzero(depth >= k)
            p[on] = self.join(key[on], 0.0) + self.join(_context_key(context[on - 1]), 1.0) * p[on]
        return p


def _keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the 1-, 2- and 3-grams that end at each token; the first ones wrap and are not to be used."""
    uni = mix64(hashes + np.uint64(1))
    bi = combine(np.roll(hashes, 1), hashes)
    return uni, bi, combine(np.roll(hashes, 2), np.roll(hashes, 1), hashes)


def _context_key(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0x6A09E667F3BCC909))


@dataclass
class Counted:
    """A model in files of the shared folder: the trie of all n-grams, whose splits have this model's weights and totals;
    a word's number or an n-gram's node finds its count. discounts: by order; total: of the unigrams' counts."""

    trie: Trie
    discounts: list[np.ndarray]
    total: float = 0.0
    given: float = 1.0
    uniform: float = 1.0

    @property
    def shards(self) -> list[str]:
        return [s[0] for level in self.trie.levels for s in level.shards]

    def probabilities(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each token given up to two before it in its text."""
        return _Reader(self).walk(hashes, first, ORDER).p


class _Reader(Reader):
    """Look-ups in the trie with the model's shares and weights."""

    def __init__(self, model: Counted):
        super().__init__(model.trie)
        self.model = model

    def unigrams(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        m = self.model
        p = np.full(len(number), m.given * m.uniform)
        bases, files = _bases([x for x in m.trie.words if x[0]])
        shard = np.where(number >= 0, np.searchsorted(bases, number, side="right") - 1, -1)
        for s in np.unique(shard[shard >= 0]).tolist():
            at = np.flatnonzero(shard == s)
            p[at] += self._share(1, _arrays(files[s] + OWN)["n"][number[at] - bases[s]], m.total)
        return p

    def _share(self, order: int, n: np.ndarray, total: np.ndarray | float) -> np.ndarray:
        return (n.astype(np.float64) - self.model.discounts[order - 1][np.minimum(n, 3)]) / total

    def _of_contexts(self, order: int, file: str, a: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _arrays(file + OWN)
        sums = own["sums"].reshape(-1, 4)[own["kind"][place]]
        return _weight(sums, self.model.discounts[order - 1]), sums[:, 0].astype(np.float64)

    def _of_nodes(self, order: int, file: str, a: dict, place: np.ndarray, total: np.ndarray) -> np.ndarray:
        return self._share(order, a["count"][place] if order == ORDER else _arrays(file + OWN)["n"][place], total)


def _bases(shards: list[tuple[str, int]]) -> tuple[np.ndarray, list[str]]:
    """Numbers of the shards' first entries, and their files."""
    return np.array([b for _, b in shards], dtype=np.int64), [f for f, _ in shards]


def _weight(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What contexts give to lower orders, from their (total, children of count 1, 2, 3 and more)."""
    return (sums[..., 1:] * d[1:]).sum(axis=-1) / sums[..., 0]


def _context_sums(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(total, children of count 1, 2, 3 and more) of contexts whose children begin at `at`."""
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)], axis=1)


def _kinds(sums: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct rows, of which there are few, and each row's place among them."""
    code = np.zeros(len(sums), dtype=np.int64)
    for column in sums.T:
        code, _ = pd.factorize(code * (column.max() + 1) + column)
    _, one = np.unique(code, return_index=True)
    return {"sums": sums[one].reshape(-1), "kind": code.astype(np.uint16 if len(one) <= 1 << 16 else np.uint32)}


def _last_words(trie: Trie, nodes: np.ndarray) -> np.ndarray:
    """Number of the last word of bigrams."""
    out = np.zeros(len(nodes), dtype=np.int64)
    bases = np.array([s[3] for s in trie.levels[0].shards], dtype=np.int64)
    shard = np.searchsorted(bases, nodes, side="right") - 1
    for s in np.unique(shard).tolist():
        at = np.flatnonzero(shard == s)
        a = _arrays(trie.levels[0].shards[s][0])
        pointers, children = _part(a, "pointer"), _part(a, "child")
        place = nodes[at] - bases[s]
        low = pointers.get(pointers.successor(place.astype(np.uint64) + np.uint64(1))[0] - 1).astype(np.int64)
        base = np.where(low > 0, children.get(np.maximum(low - 1, 0)), np.uint64(0))
        out[at] = (children.get(place) - base).astype(np.int64) - 1
    return out


def _children(a: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a shard, where the children of each begin, and all children as they are relative to their contexts."""
    contexts, pointers, ids = _part(a, "context"), _part(a, "pointer"), _part(a, "child")
    at = pointers.get(np.arange(contexts.n)).astype(np.int64)
    child = ids.get(np.arange(ids.n))
    base = np.concatenate([[np.uint64(0)], child])[at]
    return contexts.get(np.arange(contexts.n)).astype(np.int64), at, (child - np.repeat(base, np.diff(np.append(at, ids.n)))).astype(np.int64) - 1


def _bucketed(bases: np.ndarray):
    return lambda keys: np.searchsorted(bases, keys.astype(np.int64), side="right") - 1


def _openings(docs: DataFrame, trie: Trie, order: int, bases: np.ndarray) -> DataFrame:
    """The n-grams of an order, 1 or 2, that open a text, which no word precedes: they count by their occurrences."""

    def f(batches):
        reader, sums = Reader(trie), Sums()
        for batch in batches:
            for texts in _steps(batch):
                hashes, first = token_hashes(texts)
                at = first[:-1][np.diff(first) >= order]
                pairs = hashes[(at[:, None] + np.arange(order)).reshape(-1)]
                nodes = reader.walk(pairs, np.arange(0, len(pairs) + 1, order), order).node[order - 1 :: order]
                sums.add(nodes.astype(np.uint64))
        yield from _hand_on(sums, _bucketed(bases))

    return docs.select("text").mapInArrow(lean(f), "bucket int, data binary")


def _continuations(spark, trie: Trie, order: int, bases: np.ndarray) -> DataFrame:
    """For each distinct n-gram of an order, 2 or 3, the one without its first word, counted by the tasks of its shards."""
    files = [s[0] for s in trie.levels[order - 2].shards]

    def f(batches):
        reader = Reader(trie)
        for batch in batches:
            for number in batch.column(0).to_pylist():
                sums = Sums()
                context, at, child = _children(_arrays(files[number]))
                if order == 3:  # a child is the rank of the bigram among those of its first word
                    last, back = np.unique(_last_words(trie, context), return_inverse=True)
                    start = reader.children(2, last, np.zeros(len(last), np.int64))[3][back]
                    child = child + np.repeat(start, np.diff(np.append(at, len(child))))
                sums.add(child.astype(np.uint64))
                yield from _hand_on(sums, _bucketed(bases))

    return spark.range(0, len(files), 1, max(len(files), 1)).mapInArrow(lean(f), "bucket int, data binary")


_STATS = "number int, total long, n1 long, n2 long, n3 long, n4 long, contexts array<long>, sums array<long>"


def _stats(number: int, n: np.ndarray, contexts: np.ndarray = (), sums: np.ndarray = ()) -> pa.RecordBatch:
    """A shard's counts of counts, and the sums of its first and last context, which may span shards."""
    ends = [0, -1] if len(contexts) else []
    values = [[number], [int(n.sum())], *([int((n == k).sum())] for k in (1, 2, 3, 4)), [[int(contexts[e]) for e in ends]], [[int(x) for e in ends for x in sums[e]]]]
    types = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["number", "total", "n1", "n2", "n3", "n4", "contexts", "sums"])


def _discounts_of(rows: list) -> np.ndarray:
    return _discounts(np.repeat(np.arange(1.0, 5.0), [sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4)]))


def _set_splits(level: Level, rows: list, d: np.ndarray) -> None:
    """Weights and totals of the contexts that may span shards."""
    whole: dict[int, np.ndarray] = {}
    for r in rows:
        for context, sums in dict(zip(r.contexts, np.array(r.sums, dtype=np.int64).reshape(-1, 4), strict=True)).items():
            whole[context] = whole.get(context, 0) + sums
    level.split = {c: (x[0], float(_weight(whole[c], d)), float(whole[c][0])) for c, x in level.split.items()}


def _count_model(docs: DataFrame) -> Counted:
    """The model of all texts of docs, in files of the shared folder."""
    spark = docs.sparkSession
    trie = ngram_trie.train(docs, ORDER, SHARD_ENTRIES)
    if not trie.size:
        return Counted(trie, [_discounts(np.zeros(0))] * ORDER)
    bigrams, trigrams = trie.levels
    sizes = np.diff([s[3] for s in bigrams.shards] + [bigrams.size]).tolist()
    words = [x for x in trie.words if x[0]]
    of_words = np.diff([b for _, b in words] + [trie.size]).tolist()

    def of_trigrams(batches):
        for batch in batches:
            for number in batch.column(0).to_pylist():
                file = trigrams.shards[number][0]
                a = _arrays(file)
                context, at, _ = _children(a)
                sums = _context_sums(a["count"], at)
                _write(file + OWN, _kinds(sums))
                yield _stats(number, a["count"], context, sums)

    def counted(batches, bases, many):
        for number, keys, counts in _merged_buckets(batches):
            n = np.zeros(many[number], dtype=np.uint32)
            n[keys.astype(np.int64) - bases[number]] = counts
            yield number, n

    def of_bigrams(batches):
        for number, n in counted(batches, bases2, sizes):
            file = bigrams.shards[number][0]
            context, at, _ = _children(_arrays(file))
            sums = _context_sums(n, at)
            _write(file + OWN, {"n": n, **_kinds(sums)})
            yield _stats(number, n, context, sums)

    def of_unigrams(batches):
        for number, n in counted(batches, bases1, of_words):
            _write(words[number][0] + OWN, {"n": n})
            yield _stats(number, n)

    def dealt(rows: DataFrame, shards: int, f) -> list:
        return sorted(rows.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(f), _STATS).collect())

    bases1, bases2 = _bases(words)[0], np.array([s[3] for s in bigrams.shards], dtype=np.int64)
    rows1 = dealt(_openings(docs, trie, 1, bases1).unionByName(_continuations(spark, trie, 2, bases1)), len(words), of_unigrams)
    rows2 = dealt(_openings(docs, trie, 2, bases2).unionByName(_continuations(spark, trie, 3, bases2)), len(sizes), of_bigrams) if sizes else []
    rows3 = sorted(spark.range(0, len(trigrams.shards), 1, max(len(trigrams.shards), 1)).mapInArrow(lean(of_trigrams), _STATS).collect()) if trigrams.shards else []
    discounts = [_discounts_of(r) for r in (rows1, rows2, rows3)]
    for level, rows, d in ((bigrams, rows2, discounts[1]), (trigrams, rows3, discounts[2])):
        _set_splits(level, rows, d)
    total = sum(r.total for r in rows1)
    held = np.array([sum(r[f"n{k}"] for r in rows1) for k in (1, 2)])
    given = (held * discounts[0][1:3]).sum() + (trie.size - held.sum()) * discounts[0][3]
    return Counted(trie, discounts, float(total), float(given / total), 1.0 / (trie.size + 1))


def _languages(rows: DataFrame) -> DataFrame:
    """A small table of languages, broadcast after a check of its size."""
    return F.broadcast(rows) if rows.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else rows


def train(docs: DataFrame, trusted: DataFrame) -> Counted:
    """A model of all documents of the training half of the trusted ones; of about TRAIN_ROWS of them if that is set,
    from all languages alike."""
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct().where(_in_training()).checkpoint()
    if TRAIN_ROWS is not None:
        ids = _languages_alike(docs, ids, TRAIN_ROWS)
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.where("text is not null").join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    if not few:  # every count of the model scans them again
        folder = shared_folder(docs.sparkSession, "trusted-texts")
        texts.select("text").write.parquet(folder)
        texts = docs.sparkSession.read.parquet(folder)
    return _count_model(texts)


def _languages_alike(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """About `most` of the ids, the same number of each language where there are as many."""
    known = docs.where("text is not null").select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("of")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left_semi").checkpoint()
    held = known.groupBy("of").agg(F.count("*").alias("n"))
    each = most / max(held.count(), 1)
    quota = _languages(held.select("of", (F.lit(each) / F.col("n")).alias("share")))
    return known.join(quota, "of").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select(F.col("doc_id").alias("trusted_id")).distinct()


def _in_training(column: str = "trusted_id"):
    return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(2)) == 0


def perplexities(docs: DataFrame, model: Model | Counted) -> DataFrame:
    """doc_id, lang, n_tokens, perplexity of every whole text; one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def f(batches):
        for batch in batches:
            texts, n, value = text_array(batch), [], []
            for a, b in slices(texts, STEP_BYTES):
                hashes, first = token_hashes(texts.slice(a, b - a))
                n.append(np.diff(first))
                logs = [(np.log(model.probabilities(h, f)), f, skip) for h, f, skip in spans(hashes, first)]
                total = np.add.reduceat(logs[0][0], first[:-1]) if len(logs) == 1 else np.array([sum(x[skip:].sum() for x, _, skip in logs)])
                value.append(np.exp(-total / n[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(np.concatenate(value) if value else [], pa.float64())], ["doc_id", "lang", "n_tokens", "perplexity"])

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(lean(f), f"doc_id {kind}, lang string, n_tokens long, perplexity double")


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """Perplexity and verdict of every document, one row per input row.

    Returns doc_id, lang, n_tokens (the end token included), perplexity, threshold, kept. A text that is null or has
    no words is rejected; a perplexity equal to the threshold is kept; very long texts are scored whole; a null language,
    or one with few trusted documents, has the threshold of all; without trusted documents everything with words is
    kept. Repeated rows are judged alike; a table without rows gives none; other columns, whatever their names, are not
    read.
    """
    checkpoint_root(docs.sparkSession)
    scored = perplexities(docs, train(docs, trusted)).checkpoint()
    rest = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id is not null").distinct().where(~_in_training())
    known = scored.where("n_tokens > 1").join(rest, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    by_language = known.groupBy("lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("q"), F.count("*").alias("n")).where(F.col("n") >= LEAST_TRUSTED).select(F.col("lang").alias("of"), (F.col("q") * margin).alias("own"))
    overall = known.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("q")).first()["q"]
    limit = F.coalesce("own", F.lit(float(overall) * margin if overall is not None else float("inf")))
    return scored.join(_languages(by_language), F.col("lang") == F.col("of"), "left").select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), ((F.col("n_tokens") > 1) & (F.col("perplexity") <= limit)).alias("kept"))
