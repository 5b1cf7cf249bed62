"""Language-model scoring with an Elias-Fano n-gram trie.

Model. Tokens are the lower-cased words of a text and one end token. A trie of orders 1 to ORDER holds every token of
the training texts and every longer n-gram, however rare. Probabilities are smoothed by interpolated absolute
discounting: with c the counts of training,

    p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))
    pk(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(k-1)(w | shorter h),   g(h) = 1 - sum over held children of (c - D) / c(h)

A text's score is the sum of log10 of its tokens' probabilities given the ORDER - 1 tokens before, from its start on.

Storage. Order 1 is the sorted word hashes as Elias-Fano sequences; a word's number is its rank. Order k is, for each
context (a node of order k - 1) that has children: the context's number, a pointer to its first child (both
monotone, Elias-Fano), and the children. A child is written relative to its context: order 2 as a word number, order
3 as the rank of the bigram of its last two words among the bigrams of their first word. With the last value of the
context before it added, the children of all contexts form one monotone sequence; a query adds the context's base
and looks for the successor inside the context's range. Discounted shares and g are 16-bit fixed-point logarithms.
Levels are cut into shards of bounded size by key, so that children of one common context may span shards; they are
memory-mapped from the shared folder, so a scorer's memory does not grow with the model.

Shape. Three scans of the training texts count one order each. A task sums its n-grams in arrays and hands on one
compressed block per shard, so a frequent n-gram is one entry a task and no shard follows a frequent word; it hands them
on early where they are many, so its memory is bounded. Shards are ranges of keys, cut at quantiles of the n-grams of a
small sample of texts (which decides nothing but the shards' sizes), and a shard's task merges its blocks by streaming
and writes its file. Keys take 63 bits: where numbers of contexts and words need more, contexts are numbered by pages.
One scan scores. Only the sample's keys and the shards' names and ends reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.elias_fano import EliasFano, load, save
from tessera.llm.language_id import held_out
from tessera.llm.shared import lean, put_in_place, shared_folder, slices, text_array
from tessera.llm.textvec import WHITE, mix64, words

ORDER = 3
DISCOUNT = 0.75
#: Text bytes of a vectorised step, and entries after which a task's sums are merged.
STEP_BYTES, MERGE_AT = 4 << 20, 3_000_000
#: Tokens of a single text that are worked on at a time.
SPAN_TOKENS = 1 << 20
#: Entries that a task holds before it hands them on.
FLUSH_AT = 12_000_000
#: Text bytes that one bucket of words stands for; n-grams of a level's shard, about; text bytes of the sample.
BUCKET_BYTES, SHARD_NGRAMS, SAMPLE_BYTES = 48 << 20, 3_000_000, 4 << 20
#: Bits of a key: a page's number of a context, then a child.
KEY_BITS = 63
END = np.uint64(0x9B1A6F6C8D2E4A57)  # the end token's hash
_FIXED = 4096.0  # steps of a stored log10, down to -16


def quantise(share: np.ndarray) -> np.ndarray:
    """Fixed-point -log10 of a share in [1e-15, 1], in 16 bits."""
    return np.rint(np.clip(-np.log10(np.maximum(share, 1e-300)), 0, 15.99) * _FIXED).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return 10.0 ** (q.astype(np.float64) / -_FIXED)


def token_hashes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end token included, and n + 1 offsets."""
    w = words(texts, WHITE, lower=True)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(len(w.hash) + n, dtype=np.uint64)
    ends = first[1:] - 1
    out[ends] = END
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[mask] = w.hash
    return out, first


def spans(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(tokens, offsets, tokens to leave out) of the texts, a single very long one in spans that begin with the ORDER - 1
    tokens before: what is made of a token and its context is the same, in bounded memory."""
    if len(first) != 2 or len(hashes) <= SPAN_TOKENS:
        yield hashes, first, 0
        return
    for at in range(0, len(hashes), SPAN_TOKENS):
        low = max(0, at - (ORDER - 1))
        part = hashes[low : at + SPAN_TOKENS]
        yield part, np.array([0, len(part)]), at - low


class Sums:
    """Counts of 64-bit keys, merged now and then."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0
        self.merge_at = MERGE_AT

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.size += len(keys)
        if self.size > self.merge_at and len(self.keys) > 1:
            self.merged()
            self.merge_at = max(MERGE_AT, 2 * self.size)  # where little repeats, the next merge waits

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.counts = [keys[at]], [np.add.reduceat(counts, at) if len(at) else counts]
        self.size = sum(map(len, self.keys))
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def press(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts, as bytes by place of the differences, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes() + np.ascontiguousarray(counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=12 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    gaps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).reshape(-1)
    counts = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).reshape(-1)
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def _hand_on(sums: Sums, bucket_of: Callable) -> Iterator[pa.RecordBatch]:
    keys, counts = sums.merged()
    if not len(keys):
        return
    bucket = bucket_of(keys)  # rises with the keys
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), pa.array([press(keys[a:b], counts[a:b])], pa.binary())], ["bucket", "data"])


def _by_range(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes that keep their order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _merged_buckets(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, keys, counts), from rows sorted by bucket."""
    current, sums = None, Sums()
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != current and current is not None:
                yield current, *sums.merged()
                sums = Sums()
            current = bucket
            sums.add(*unpress(data.as_py()))
    if current is not None:
        yield current, *sums.merged()


def _write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """A shard, complete or not there: a task that is run again puts an equal file in its place."""
    import uuid

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    hidden = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        f.write(save(arrays))
    put_in_place(store, hidden, path)


def _prefixed(name: str, e: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in e.arrays().items()}


def _part(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano.from_arrays({k.removeprefix(f"{name}."): v for k, v in arrays.items() if k.startswith(f"{name}.")})


def _sieve(keys: np.ndarray) -> np.ndarray:
    """A bit for the hash of each key, one in eight or fewer set: most absent keys end here."""
    size = max(64, 1 << int(8 * len(keys) - 1).bit_length()) if len(keys) else 64
    place = (mix64(keys) & np.uint64(size - 1)).astype(np.int64)
    flags = np.zeros(size, dtype=bool)
    flags[place] = True
    return np.packbits(flags, bitorder="little")


def _passes(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = (mix64(keys) & np.uint64(len(sieve) * 8 - 1)).astype(np.int64)
    return (sieve[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


@dataclass
class Level:
    """Shards of one order, in key order: (file, page, first key, number of its first node)."""

    shards: list[tuple[str, int, int, int]] = field(default_factory=list)
    bits: int = 0  # of a child in a key
    size: int = 0
    #: the first context of each shard, which may begin in an earlier one: (number of the first child, g)
    split: dict[int, tuple] = field(default_factory=dict)


@dataclass
class Trie:
    """What a reader needs: a few numbers and file names a shard."""

    words: list[tuple[str, int]] = field(default_factory=list)  # (file, number of the first word), by hash bucket
    buckets: int = 1
    tokens: int = 0
    size: int = 0
    levels: list[Level] = field(default_factory=list)


_open: dict[str, dict] = {}


def _arrays(uri: str) -> dict:
    if uri not in _open:
        if len(_open) > 256:
            _open.clear()
        _open[uri] = load(uri)
    return _open[uri]


class Reader:
    """Vectorised look-ups in a trie."""

    def __init__(self, trie: Trie):
        self.trie = trie

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, training count) of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        bucket = _by_range(hashes, self.trie.buckets)
        for b in np.unique(bucket).tolist():
            file, base = self.trie.words[b]
            if not file:
                continue
            at = np.flatnonzero(bucket == b)
            a = _arrays(file)
            place, same = _part(a, "hash").successor(hashes[at])
            number[at[same]] = base + place[same]
            count[at[same]] = a["count"][place[same]]
        return number, count

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of words by number."""
        bases = np.array([b for f, b in self.trie.words if f])
        files = [f for f, _ in self.trie.words if f]
        out = np.zeros(len(numbers), dtype=np.int64)
        shard = np.searchsorted(bases, numbers, side="right") - 1
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            out[at] = _arrays(files[s])["count"][numbers[at] - bases[s]]
        return out

    def node_counts(self, order: int, nodes: np.ndarray) -> np.ndarray:
        """Training counts of the nodes of an order."""
        if order == 1:
            return self.counts(nodes)
        level = self.trie.levels[order - 2]
        bases = np.array([b for *_, b in level.shards])
        out = np.zeros(len(nodes), dtype=np.int64)
        shard = np.searchsorted(bases, nodes, side="right") - 1
        for s in np.unique(shard).tolist():
            at = np.flatnonzero(shard == s)
            out[at] = _arrays(level.shards[s][0])["count"][nodes[at] - bases[s]]
        return out

    def children(self, order: int, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For contexts of order - 1 and children relative to them, sorted by context and child: the child's node or -1, its discounted share, the
        context's g (1 without children), and the number of the context's first child."""
        level = self.trie.levels[order - 2]
        n = len(context)
        node, share, g, start = np.full(n, -1, dtype=np.int64), np.zeros(n), np.ones(n), np.zeros(n, dtype=np.int64)
        if not level.shards or not n:
            return node, share, g, start
        page, key = _paged(context, child, level.bits)
        pages, firsts = np.array([p for _, p, _, _ in level.shards]), np.array([k for _, _, k, _ in level.shards], dtype=np.uint64)
        shard = np.full(n, -1, dtype=np.int64)
        for p in np.unique(page).tolist():
            low, high = np.searchsorted(pages, p), np.searchsorted(pages, p, side="right")
            if low < high:
                at = np.flatnonzero(page == p)
                shard[at] = np.maximum(low + np.searchsorted(firsts[low:high], key[at], side="right") - 1, low)
        for s in np.unique(shard[shard >= 0]).tolist():
            at = np.flatnonzero(shard == s)
            file, _, _, base = level.shards[s]
            a = _arrays(file)
            contexts, pointers, ids = _part(a, "context"), _part(a, "pointer"), _part(a, "child")
            own = context[at]
            fresh = np.concatenate([[True], own[1:] != own[:-1]])  # the pairs come sorted
            c, order_of = own[fresh], np.cumsum(fresh) - 1
            place, same = contexts.successor(c.astype(np.uint64))
            held = np.flatnonzero(same)
            place = place[held]
            g_of, total_of, start_of, low_of, high_of, base_of = np.ones(len(c)), np.ones(len(c)), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.int64), np.zeros(len(c), np.uint64)
            g_of[held], total_of[held] = self._of_contexts(order, file, a, place)
            low_of[held] = pointers.get(place).astype(np.int64)
            start_of[held] = base + low_of[held]
            for x, (first, whole, *total) in level.split.items():
                k = np.searchsorted(c, x)
                if k < len(c) and c[k] == x:
                    start_of[k], g_of[k] = first, whole
                    if total:
                        total_of[k] = total[0]
            g[at], start[at] = g_of[order_of], start_of[order_of]
            ask = np.flatnonzero(same[order_of] & _passes(a["sieve"], key[at]))
            if not len(ask):
                continue
            o = order_of[ask]
            used = np.zeros(len(c), dtype=bool)
            used[o] = True
            used = used[held]
            high_of[held[used]] = pointers.get(place[used] + 1).astype(np.int64)
            later = held[used & (low_of[held] > 0)]
            base_of[later] = ids.get(low_of[later] - 1)
            found_at, same_child = ids.successor(base_of[o] + child[at[ask]].astype(np.uint64) + np.uint64(1))
            found = same_child & (found_at >= low_of[o]) & (found_at < high_of[o])
            hit = at[ask[found]]
            node[hit] = base + found_at[found]
            share[hit] = self._of_nodes(order, file, a, found_at[found], total_of[o[found]])
        return node, share, g, start

    def _of_contexts(self, order: int, file: str, a: dict, place: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """g of a shard's contexts, and the total that their children's shares are of, where these are not stored."""
        return restore(a["g"][place]), 1.0

    def _of_nodes(self, order: int, file: str, a: dict, place: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Discounted shares of a shard's nodes."""
        return restore(a["share"][place])

    def unigrams(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probabilities of words alone, by number (-1 if not held) and training count."""
        return (count + 0.5) / (self.trie.tokens + 0.5 * (self.trie.size + 1))

    def walk(self, hashes: np.ndarray, first: np.ndarray, order: int) -> Walk:
        """Nodes of every token up to an order; see Walk."""
        return Walk(self, hashes, first, order)


class Walk:
    """The tokens of some texts in a trie: numbers, counts, and the node of the k-gram that ends at each token (-1 if
    it is not held), with the probability of the token given the k - 1 before."""

    def __init__(self, reader: Reader, hashes: np.ndarray, first: np.ndarray, order: int):
        known, back = distinct(hashes)
        number, count = reader.words(known)
        self.number, self.count = number[back], count[back]
        self.p1 = reader.unigrams(self.number, self.count)
        self.node, self.start, self.p = self.number, None, self.p1
        n = len(hashes)
        self.depth = np.arange(n) - np.repeat(first[:-1], np.diff(first))  # tokens before, in the text
        for k in range(2, order + 1):
            context, child, ask = self.keys(k)
            node, start, p = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), self.p.copy()
            if len(ask):
                pair, back = _unique_pairs(context, child)
                found, share, g, first_child = reader.children(k, *pair)
                held = child >= 0  # the number in place of -1 may be that of a child which these texts do not ask for
                node[ask], start[ask] = np.where(held, found[back], -1), first_child[back]
                p[ask] = np.where(held, share[back], 0.0) + g[back] * self.p[ask]
            self.node, self.start, self.p = node, start, p

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, child or -1 in disguise, tokens) where the context of order k - 1 is held. A child that cannot be
        held is given a number that no child has."""
        n = len(self.number)
        if not n:
            zero = np.zeros(0, np.int64)
            return zero, zero, zero
        before = np.concatenate([[-1], self.node[:-1]])
        ask = np.flatnonzero((self.depth >= k - 1) & (before >= 0))
        child = self.number[ask] if k == 2 else np.where(self.node[ask] >= 0, self.node[ask] - self.start[ask], -1)
        return before[ask], child, ask


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place of each key among them; by hashing, so only the distinct ones are sorted."""
    code, value = pd.factorize(keys.view(np.int64))
    value = value.view(np.uint64)
    order = np.argsort(value)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return value[order], rank[code]


def _unique_pairs(context: np.ndarray, child: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct pairs, sorted, and the place of each input pair among them. A child of -1 becomes one past the largest
    that is asked for; it is for the caller to leave out what is found for it."""
    child = np.where(child < 0, child.max(initial=0) + 1, child)
    bits = int(child.max(initial=0)).bit_length()
    if bits + int(context.max(initial=0)).bit_length() > KEY_BITS:  # too wide for one key: contexts by their rank
        known, rank = distinct(context.astype(np.uint64))
        (place, child), back = _unique_pairs(rank, child)
        return (known[place].astype(np.int64), child), back
    keys, back = distinct((context.astype(np.uint64) << np.uint64(bits)) | child.astype(np.uint64))
    return ((keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)), back


def _steps(batch: pa.RecordBatch) -> Iterator[pa.LargeStringArray]:
    texts = text_array(batch)
    for a, b in slices(texts, STEP_BYTES):
        yield texts.slice(a, b - a)


def _paged(context: np.ndarray, child: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The page of each context, and the key of (context in its page, child)."""
    wide = np.int64(KEY_BITS - bits)
    return context >> wide, ((context & ((np.int64(1) << wide) - 1)).astype(np.uint64) << np.uint64(bits)) | child.astype(np.uint64)


def _count_words(docs: DataFrame, buckets: int) -> DataFrame:
    def f(batches):
        sums, deal = Sums(), lambda keys: _by_range(keys, buckets)
        for batch in batches:
            for texts in _steps(batch):
                sums.add(token_hashes(texts)[0])
                if sums.size > FLUSH_AT:
                    yield from _hand_on(sums, deal)
                    sums = Sums()
        yield from _hand_on(sums, deal)

    return docs.select("text").mapInArrow(lean(f), "bucket int, data binary")


def _ngrams(reader: Reader, texts: pa.LargeStringArray, order: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(page, keys) of the n-grams of an order, all orders below being in the trie."""
    for hashes, first, skip in spans(*token_hashes(texts)):
        context, child, tokens = reader.walk(hashes, first, order - 1).keys(order)
        can = (child >= 0) & (tokens >= skip)
        page, keys = _paged(context[can], child[can], bits)
        for p in np.unique(page).tolist():
            yield p, keys[page == p]


@dataclass
class Cuts:
    """Lower ends of the shards of a level but the first, as (page, key): a shard lies in one page."""

    page: np.ndarray
    key: np.ndarray

    def bucket_of(self, page: int, keys: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.page, page), np.searchsorted(self.page, page, side="right")
        return low + np.searchsorted(self.key[low:high], keys, side="right")

    def page_of(self, bucket: int) -> int:
        return int(self.page[bucket - 1]) if bucket else 0


def _cuts(sample: DataFrame, share: float, trie: Trie, order: int, bits: int, nodes: int, shard_ngrams: int | None = None) -> Cuts:
    """Shards of about shard_ngrams (SHARD_NGRAMS if not given) n-grams each, by the n-grams of the sample, a share of the texts."""

    def f(batches):
        reader, sums = Reader(trie), {}
        for batch in batches:
            for texts in _steps(batch):
                for page, keys in _ngrams(reader, texts, order, bits):
                    sums.setdefault(page, Sums()).add(keys)
        for page, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([s.merged()[0].tobytes()], pa.binary())], ["page", "keys"])

    held: dict[int, list[np.ndarray]] = {}
    for r in sample.mapInArrow(lean(f), "page long, keys binary").collect():
        held.setdefault(r.page, []).append(np.frombuffer(r.keys, dtype=np.uint64))
    pages = range(1, (max(nodes, 1) - 1 >> KEY_BITS - bits) + 1)
    keys = [(p, np.unique(np.concatenate(held[p]))) for p in sorted(held)]
    n = sum(len(k) for _, k in keys)
    expected = n / share
    shards = max(1, math.ceil(expected / (shard_ngrams or SHARD_NGRAMS)), min(sample.sparkSession.sparkContext.defaultParallelism, math.ceil(expected / 100_000)))
    step = max(1, n // shards)
    ends = [(p, int(x)) for p, k in keys for x in k[step::step]] + [(p, 0) for p in pages]
    ends = sorted(set(ends) - {(0, 0)})
    return Cuts(np.array([p for p, _ in ends], dtype=np.int64), np.array([k for _, k in ends], dtype=np.uint64))


def _count_ngrams(docs: DataFrame, trie: Trie, order: int, bits: int, cuts: Cuts) -> DataFrame:
    def f(batches):
        sums, reader = {}, Reader(trie)

        def all_of() -> Iterator[pa.RecordBatch]:
            for page, s in sums.items():
                yield from _hand_on(s, lambda keys: cuts.bucket_of(page, keys))  # noqa: B023
            sums.clear()

        for batch in batches:
            for texts in _steps(batch):
                for page, keys in _ngrams(reader, texts, order, bits):
                    sums.setdefault(page, Sums()).add(keys)
                if sum(s.size for s in sums.values()) > FLUSH_AT:
                    yield from all_of()
        yield from all_of()

    return docs.select("text").mapInArrow(lean(f), "bucket int, data binary")


def _word_shards(counted: DataFrame, buckets: int, folder: str) -> Trie:
    def f(batches):
        for bucket, keys, counts in _merged_buckets(batches):
            file = f"{folder}/words-{bucket:06d}"
            _write(file, {**_prefixed("hash", EliasFano.of(keys)), "count": counts})
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([file]), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["bucket", "file", "n", "tokens"])

    rows = {r.bucket: r for r in counted.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(f), "bucket long, file string, n long, tokens long").collect()}
    trie = Trie(buckets=buckets)
    for b in range(buckets):
        r = rows.get(b)
        trie.words.append((r.file if r else "", trie.size))
        trie.size += r.n if r else 0
        trie.tokens += r.tokens if r else 0
    return trie


def _level(counted: DataFrame, trie: Trie, order: int, bits: int, cuts: Cuts, folder: str) -> Level:
    def write(batches):
        for number, keys, counts in _merged_buckets(batches):
            page = cuts.page_of(number)
            context, child = (keys >> np.uint64(bits)).astype(np.int64) + (page << KEY_BITS - bits), keys & np.uint64((1 << bits) - 1)
            at = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            total = Reader(trie).node_counts(order - 1, context[at])
            taken = np.add.reduceat(counts - DISCOUNT, at)
            many = np.diff(np.append(at, len(keys)))
            last = child[np.append(at[1:], len(keys)) - 1] + np.uint64(1)  # the largest child of each context, from 1
            base = np.concatenate([[np.uint64(0)], np.cumsum(last)[:-1]]).astype(np.uint64)
            share = (counts - DISCOUNT) / np.repeat(total, many)
            file = f"{folder}/level-{order}-{number:06d}"
            _write(
                file,
                {
                    **_prefixed("context", EliasFano.of(context[at].astype(np.uint64))),
                    **_prefixed("pointer", EliasFano.of(np.append(at, len(keys)).astype(np.uint64))),
                    **_prefixed("child", EliasFano.of(np.repeat(base, many) + child + np.uint64(1))),
                    "share": quantise(share),
                    "g": quantise(1 - taken / total),
                    "count": counts.astype(np.uint32),
                    "sieve": _sieve(keys),
                },
            )
            ends = [0, -1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((number, pa.int64()), (file, pa.string()), (int(keys[0].view(np.int64)), pa.int64()), (len(keys), pa.int64()), ([int(context[at][e]) for e in ends], pa.list_(pa.int64())), ([int(at[e]) for e in ends], pa.list_(pa.int64())), ([float(taken[e] / total[e]) for e in ends], pa.list_(pa.float64())))],
                ["number", "file", "first", "n", "contexts", "starts", "taken"],
            )

    dealt = counted.repartition(len(cuts.key) + 1, "bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(lean(write), "number long, file string, first long, n long, contexts array<long>, starts array<long>, taken array<double>").collect()
    level = Level(bits=bits)
    base, open_context, open_start, open_taken = 0, None, 0, 0.0
    for r in sorted(rows):
        level.shards.append((r.file, cuts.page_of(r.number), r.first, base))
        if r.contexts[0] == open_context:
            open_taken += r.taken[0]
        else:
            open_context, open_start, open_taken = r.contexts[0], base + r.starts[0], r.taken[0]
        level.split[open_context] = (open_start, 1 - open_taken)
        if r.contexts[1] != open_context:
            open_context, open_start, open_taken = r.contexts[1], base + r.starts[1], r.taken[1]
        base += r.n
    level.size = base
    return level


def train(docs: DataFrame, order: int = ORDER, shard_ngrams: int | None = None) -> Trie:
    """A trie of the texts of docs, in a new folder under the shared one. Null texts are empty texts: an end token."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "ngram-trie")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    trie = _word_shards(_count_words(docs, buckets), buckets, folder)
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).select("text").checkpoint()
    bits = max(1, trie.size).bit_length()
    nodes = trie.size
    for k in range(2, order + 1):
        cuts = _cuts(sample, share, trie, k, bits, nodes, shard_ngrams)
        level = _level(_count_ngrams(docs, trie, k, bits, cuts), trie, k, bits, cuts, folder)
        trie.levels.append(level)
        nodes = level.size
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, base_score, score. Null texts count as empty: their end token alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def f(batches):
        reader = Reader(trie)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for texts in _steps(batch):
                hashes, first = token_hashes(texts)
                parts = []
                for h, f, skip in spans(hashes, first):
                    walk = reader.walk(h, f, 1 + len(trie.levels))
                    values = ((walk.count > 0).astype(np.int64), np.log10(walk.p1), np.log10(walk.p))
                    parts.append([np.add.reduceat(x, f[:-1]) if not skip else x[skip:].sum(keepdims=True) for x in values])
                for column, x in zip(out, (np.diff(first), *(sum(p[1:], p[0]) for p in zip(*parts, strict=True))), strict=True):
                    column.append(x)
            whole = [np.concatenate(x) if x else np.zeros(0) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(whole, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(f), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and scores all: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Null and empty texts are their end token; very long texts are read whole; repeated rows count each, in training and
    in the result; a table without rows gives none, and one without training documents an untrained model's scores;
    other columns, whatever their names, are not read."""
    out = held_out(F.col("doc_id"), 5, 1)
    slim = docs.select("doc_id", "text")
    trie = train(slim.where(~out))
    return score(slim, trie).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")
