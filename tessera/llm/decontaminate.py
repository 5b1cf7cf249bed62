"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of consecutive words. The words of a window are ordered by rarity in the
corpus; for exact containment the necessary prefix of a window is its one rarest word (containment threshold 1
leaves a prefix of one token). A document meets a window only where it holds that word; the word's place in the
window then fixes the window's only possible place in the document (positional bound), which must lie inside it
(length bound). What is left is verified word by word, first by hash and then by bytes.

Shape: documents are only scanned, once for the rarity of the benchmark's words and once for the join; no
document row is shuffled. The benchmark is cut into blocks of about BLOCK_BYTES of text by item. Tasks make the blocks,
index them by the counted rarity, and keep them in the shared folder; a batch of documents meets them one after
another. The driver sees the blocks' numbers only, so its memory and a task's stay bounded for any benchmark.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import lean, put_in_place, shared_folder, slices, text_array
from tessera.llm.textvec import NOT_WORD, Words, words

WINDOW = 8
#: Text bytes of the benchmark that one block holds, about (one item alone may be longer).
BLOCK_BYTES = 8 << 20
#: Candidate windows verified at a time.
CHUNK = 1 << 18


class Block:
    """Windows of some benchmark items in arrays and, once rarity is known, their index by rarest word."""

    def __init__(self, items: list[tuple[str, str]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        w = words(pa.array([t for _, t in items], pa.large_string()), NOT_WORD, lower=True)
        known: dict[bytes, int] = {}
        at = np.fromiter((known.setdefault(w.bytes_of(i), len(known)) for i in range(len(w.hash))), np.int32, len(w.hash))
        self.vocabulary = np.frombuffer(b"".join(known), dtype=np.uint8)  # the words' bytes, one after another
        self.word_ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, known), np.int64, len(known)))])
        self.word_hash = np.zeros(len(known), np.uint64)
        self.word_hash[at] = w.hash
        sizes = np.minimum(w.count(), WINDOW)
        many = np.where(sizes > 0, w.count() - sizes + 1, 0)
        item = np.repeat(np.arange(len(items)), many)
        first = np.repeat(w.first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held = np.arange(WINDOW)[None, :] < sizes[item][:, None]
        rows = np.where(held, at[np.minimum(first[:, None] + np.arange(WINDOW), max(len(at) - 1, 0))] if len(at) else -1, -1).astype(np.int32)
        self.windows, of = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows.reshape(0, WINDOW), np.zeros(0, np.int64))
        self.length = (self.windows >= 0).sum(axis=1)
        owner = np.fromiter((number[i] for i, _ in items), np.int64, len(items))[item]
        pairs = np.unique(of.reshape(-1).astype(np.int64) * len(self.ids) + owner)
        self.owner = pairs % max(len(self.ids), 1)  # items of each window, one after another
        self.owner_ends = np.searchsorted(pairs, np.arange(len(self.windows) + 1) * len(self.ids))
        self.hashes = np.unique(self.word_hash)

    def index(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Windows by their rarest word, given the counts of some word hashes in the corpus (of the others: 0)."""
        total = np.zeros(len(self.hashes), np.int64)
        place = np.minimum(np.searchsorted(self.hashes, codes), max(len(self.hashes) - 1, 0))
        known = self.hashes[place] == codes if len(self.hashes) else np.zeros(len(codes), bool)
        np.add.at(total, place[known], counts[known])
        own = total[np.searchsorted(self.hashes, self.word_hash)]
        rank = np.empty(len(own) + 1, np.int64)
        rank[np.lexsort((self.word_hash, own))] = np.arange(len(own))
        rank[-1] = len(own)  # of the places behind a short window's end
        self.codes = np.append(self.word_hash, np.uint64(0))[self.windows]
        self.offset = rank[self.windows].argmin(axis=1) if len(self.windows) else np.zeros(0, np.int64)
        pivot = self.codes[np.arange(len(self.windows)), self.offset]
        self.order = np.argsort(pivot, kind="stable")
        self.pivots, self.at = np.unique(pivot[self.order], return_index=True)
        self.at = np.append(self.at, len(pivot))
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.pivots & np.uint64(0xFFFF)).astype(np.int64)] = True

    def matches(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first word in the documents, window) of every verified occurrence."""
        if not len(self.pivots) or not len(w.hash):
            return
        held = np.flatnonzero(self.sieve[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.pivots, w.hash[held]), len(self.pivots) - 1)
        same = self.pivots[slot] == w.hash[held]
        held, slot = held[same], slot[same]
        document = np.searchsorted(w.first, held, side="right") - 1
        many = self.at[slot + 1] - self.at[slot]
        bounds = np.concatenate([[0], np.cumsum(many)])
        low = 0
        while low < len(held):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, side="right")) - 1)
            reps = many[low:high]
            step = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            window = self.order[np.repeat(self.at[slot[low:high]], reps) + step]
            doc = np.repeat(document[low:high], reps)
            first = np.repeat(held[low:high], reps) - self.offset[window]
            ok = (first >= w.first[doc]) & (first + self.length[window] <= w.first[doc + 1])
            first, window = first[ok], window[ok]
            for k in range(WINDOW):
                in_window = self.length[window] > k
                at = np.minimum(first + k, len(w.hash) - 1)
                ok = ~in_window | (w.hash[at] == self.codes[window, k])
                first, window = first[ok], window[ok]
            exact = self._same(w, first, window)
            yield first[exact], window[exact]
            low = high

    def _same(self, w: Words, first: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the words from `first` on are those of the windows, by their bytes."""
        same = np.ones(len(first), dtype=bool)
        for k in range(WINDOW):
            at = np.flatnonzero(same & (self.length[window] > k))
            word, own = first[at] + k, self.windows[window[at], k]
            size = w.end[word] - w.start[word]
            equal = size == self.word_ends[own + 1] - self.word_ends[own]
            same[at[~equal]] = False
            at, word, own, size = at[equal], word[equal], own[equal], size[equal]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            unlike = w.data[np.repeat(w.start[word], size) + step] != self.vocabulary[np.repeat(self.word_ends[own], size) + step]
            same[np.repeat(at, size)[unlike]] = False
        return same


def _put(path: str, block: Block) -> None:
    """A block's file, complete or not there: a task that is run again puts an equal one in its place."""
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    hidden = f"{inside}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(pickle.dumps(block))
    put_in_place(store, hidden, inside)


_last: tuple[str, Block] | None = None


def _get(path: str) -> Block:
    """A block from the shared folder; a task keeps the last one, so it reads a benchmark of one block once."""
    global _last
    if _last is None or _last[0] != path:
        _last = None
        from pyarrow import fs

        store, inside = fs.FileSystem.from_uri(path)
        with store.open_input_stream(inside) as f:
            _last = (path, pickle.loads(f.read()))
    return _last[1]


def forget() -> None:
    """Drops the kept block."""
    global _last
    _last = None


@dataclass(frozen=True)
class Held:
    """Blocks in the shared folder, by number."""

    folder: str
    numbers: tuple[int, ...]
    kind: str

    def path(self, number: int) -> str:
        return f"{self.folder}/{number:06d}.{self.kind}"

    def __iter__(self) -> Iterator[tuple[int, Block]]:
        for number in self.numbers:
            yield number, _get(self.path(number))


def _groups(batches) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(number, rows) of batches sorted by their first column."""
    current, rows = None, []
    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if rows and number[a] != current:
                yield current, rows
                rows = []
            current = int(number[a])
            rows.append(batch.slice(a, b - a))
    if rows:
        yield current, rows


def _cut_blocks(benchmark: DataFrame) -> Held:
    """Blocks of the benchmark, made by tasks: items fall into them by a hash of their id."""
    spark = benchmark.sparkSession
    folder = shared_folder(spark, "benchmark")
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(folder)
    store.create_dir(inside)
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    held = Held(folder, (), "words")

    def make(batches):
        for number, parts in _groups(batches):
            block = Block([x for p in parts for x in zip(p.column(1).to_pylist(), p.column(2).to_pylist(), strict=True)])
            if len(block.windows):
                _put(held.path(number), block)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["number"])

    dealt = rows.select(F.pmod(F.xxhash64("i"), F.lit(n)).alias("number"), "i", "t").repartition(int(n), "number").sortWithinPartitions("number", "i", "t")
    numbers = sorted(r.number for r in dealt.mapInArrow(lean(make), "number long").collect())
    return Held(folder, tuple(numbers), "words")


def _count_rarity(docs: DataFrame, held: Held) -> DataFrame:
    """(number, code, n): how often each block's words occur in docs."""

    def count(batches):
        totals: dict[int, np.ndarray] = {}
        hashes: dict[int, np.ndarray] = {}
        for batch in batches:
            texts = text_array(batch)
            for a, b in slices(texts):
                found = words(texts.slice(a, b - a), NOT_WORD, lower=True).hash
                for number, block in held:
                    own = hashes.setdefault(number, block.hashes)
                    slot = np.minimum(np.searchsorted(own, found), len(own) - 1)
                    totals[number] = totals.get(number, 0) + np.bincount(slot[own[slot] == found], minlength=len(own))
        for number, n in totals.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), number)), pa.array(hashes[number][hit].view(np.int64)), pa.array(n[hit])], ["number", "code", "n"])

    return docs.select("text").mapInArrow(lean(count), "number long, code long, n long").groupBy("number", "code").agg(F.sum("n").alias("n"))


def _index(docs: DataFrame, benchmark: DataFrame) -> Held:
    """The benchmark's windows by their rarest words in docs, held for the join."""
    spark = docs.sparkSession
    held = _cut_blocks(benchmark)
    if not held.numbers:
        return held
    indexed = replace(held, kind="index")

    def make(batches):
        for number, parts in _groups(batches):
            block = _get(held.path(number))
            block.index(np.concatenate([p.column(1).to_numpy() for p in parts]).view(np.uint64), np.concatenate([p.column(2).to_numpy() for p in parts]))
            _put(indexed.path(number), block)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], ["number"])

    every = spark.createDataFrame([(k, 0, 0) for k in held.numbers], "number long, code long, n long")  # blocks without any count too
    rows = _count_rarity(docs, held).unionByName(every).repartition(len(held.numbers), "number").sortWithinPartitions("number", "code")
    rows.mapInArrow(lean(make), "number long").agg(F.count("*")).collect()
    return indexed


def _judge(texts: pa.LargeStringArray, held: Held) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Words, words hit and items of each text."""
    n_words, n_hit, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a), NOT_WORD, lower=True)
        covered = np.zeros(len(w.hash) + 1, dtype=np.int64)
        found: dict[int, set[str]] = {}
        for _, block in held:
            for first, window in block.matches(w):
                np.add.at(covered, first, 1)
                np.add.at(covered, first + block.length[window], -1)
                doc = np.searchsorted(w.first, first, side="right") - 1
                low, many = block.owner_ends[window], block.owner_ends[window + 1] - block.owner_ends[window]
                owner = block.owner[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                for x in np.unique(np.repeat(doc, many) * len(block.ids) + owner).tolist():
                    found.setdefault(x // len(block.ids), set()).add(block.ids[x % len(block.ids)])
        hits = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        n_words.append(w.count())
        n_hit.append(hits[w.first[1:]] - hits[w.first[:-1]])
        items += [sorted(found.get(d, ())) for d in range(b - a)]
    return np.concatenate(n_words), np.concatenate(n_hit), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items they come from.

    Returns one row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >=
    min_items), items (their sorted ids). Null and empty texts have no words and no hits; very long texts are read whole;
    repeated documents and repeated items are each judged alike; items without words or without an id have no windows;
    a table without rows gives none, and without items nothing is hit; other columns of the inputs, whatever their
    names, are not read.
    """
    held = _index(docs, benchmark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def join(batches):
        for batch in batches:
            n_words, n_hit, items = _judge(text_array(batch), held)
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            n_items = [len(x) for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x >= min_items for x in n_items], pa.bool_()), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        lean(join), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The rows of docs that hold windows of fewer than min_items benchmark items, with docs' own columns only."""
    held = _index(docs, benchmark)

    def keep(batches):
        for batch in batches:
            _, _, items = _judge(text_array(batch), held)
            yield batch.filter(pa.array([len(x) < min_items for x in items], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
