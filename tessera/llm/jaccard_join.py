"""N-gram Jaccard join by chosen paths, with exact verification.

Each text is the set of its 5-word shingles (64-bit hashes of lower-cased words between white space). Equal sets are
one node, so copies never meet in pairs. A node keeps its set's size, a 64-byte min-hash sketch and the SAMPLE
smallest shingle hashes, which is the same random sample of shingles for every set.

Chosen paths: in each of RUNS runs a node joins a bucket for every sampled shingle whose hash, under the run's
function, is below 1 / (similarity * sample size): about one and a quarter buckets, and two similar sets share one
with probability 0.65. Buckets of up to SMALL nodes are compared by brute force on sketches. Larger ones, mostly
around a passage that many texts share, are split again on freshly sampled shingles, for up to DEPTH levels; what
is then still large is truly similar and is compared in blocks. Runs are as many as the target recall needs at the
second level (see runs_for). Sketches only drop pairs that are six standard deviations below the similarity.

A bucket gives a star for each group of similar nodes in it, not pairs. The candidates' components are then verified
exactly: the texts of their nodes are read again, and all pairs inside a component are compared on whole sets, in blocks
of BLOCK nodes, so links that a run missed inside a component are found too. Out come link counts and stars again; their
components are the classes. No step holds more than two blocks of sets, none is capped, and no link, class or
fingerprint reaches the driver.

A group of more than one block is shuffled once: each block is a file in the shared folder, and a task that compares
two blocks reads their files, so what is shuffled grows with the group and not with its square. Keys with many rows
(paths, components, sets) meet their one row by broadcast or, where there are too many such keys, by salt.

Recall. A pair of equal sizes at the similarity is compared with probability 0.9999995, 0.9999, 0.9995 and 0.9983 if
its bucket is found at the first to the fourth level (after no, one, two and three splits); more similar pairs, and
pairs in one component, do better.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components
from tessera.llm.shared import checkpoint_root, lean, put_in_place, shared_folder, slices, text_array
from tessera.llm.textvec import WHITE, _splitmix, combine, mix64, words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
SKETCH, SAMPLE = 64, 48
SMALL, DEPTH, BLOCK = 256, 3, 512
#: Pairs compared at a time.
CHUNK = 1 << 19
#: As many ids as are broadcast at most, to find the candidates' texts again; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: As many keys with more than SMALL rows as are broadcast at most, and salts of a key beyond that.
BROADCAST_KEYS, SALTS = 500_000, 32

_A = _splitmix(SKETCH, 101) | np.uint64(1)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the similarity that is split twice was compared with probability `recall`."""
    shared = 2 * similarity / (1 + similarity)  # of each sample
    one = 1 - math.exp(-shared / similarity)
    two = 1 - math.exp(-shared / similarity * one)
    return math.ceil(math.log(1 - recall) / math.log(1 - two))


def shingle_sets(texts: pa.LargeStringArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    for a, b in slices(texts):
        w = words(texts.slice(a, b - a), WHITE, lower=True)
        n = len(w.hash)
        codes = combine(*(w.hash[k : n - size + 1 + k] for k in range(size))) if n >= size else np.zeros(0, np.uint64)
        for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if last - first >= size:
                yield np.unique(codes[first : last - size + 1])
            elif last > first:
                yield combine(*(w.hash[first + k : first + k + 1] for k in range(last - first)), np.array([last - first], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> str | None:
    """128 bits of a set, equal for equal sets; None for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        one = mix64(s).sum(dtype=np.uint64)
        two = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return f"{int(one):016x}{int(two):016x}"


def sketch(s: np.ndarray) -> bytes:
    """The low byte of SKETCH minima of the set under as many hash functions."""
    out = np.empty(SKETCH, dtype=np.uint8)
    with np.errstate(over="ignore"):
        for k in range(SKETCH):
            out[k] = (int((s * _A[k]).min()) >> 24) & 0xFF
    return out.tobytes()


def _features(batches):
    for batch in batches:
        sig, size, marks, sample = [], [], [], []
        for s in shingle_sets(text_array(batch)):
            sig.append(signature(s))
            size.append(len(s))
            marks.append(sketch(s) if len(s) else b"")
            sample.append(s[:SAMPLE].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.string()), pa.array(size, pa.int64()), pa.array(marks, pa.binary()), pa.array(sample, pa.binary())], ["doc_id", "sig", "size", "sketch", "sample"])


def _chosen(run: int, level: int, path: np.ndarray, sample: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, new path) of the sampled shingles that lead on from each row's path."""
    lengths = np.array([len(x) for x in sample])
    row = np.repeat(np.arange(len(sample)), lengths)
    tokens = np.concatenate(sample) if len(sample) else np.zeros(0, np.uint64)
    code = combine(tokens, path[row], np.full(len(row), run * 16 + level, dtype=np.uint64))
    limit = 1.0 / (similarity * np.maximum(lengths, 1))
    on = (code >> np.uint64(11)).astype(np.float64) / float(1 << 53) < limit[row]
    return row[on], combine(tokens[on], path[row[on]], np.full(int(on.sum()), run * 16 + level + 8, dtype=np.uint64))


def _first_paths(runs: int, similarity: float) -> Callable:
    def f(batches):
        for batch in batches:
            sample = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
            sig = batch.column(0)
            for run in range(runs):
                row, path = _chosen(run, 1, np.full(len(sample), run, dtype=np.uint64), sample, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(np.full(len(row), run, dtype=np.int32)), sig.take(pa.array(row))], ["path", "run", "sig"])

    return f


def _next_paths(level: int, similarity: float) -> Callable:
    def f(batches):
        for batch in batches:
            runs = batch.column(1).to_numpy()
            for run in np.unique(runs).tolist():
                at = np.flatnonzero(runs == run)
                part = batch.take(pa.array(at))
                sample = [np.frombuffer(x, dtype=np.uint64) for x in part.column(3).to_pylist()]
                row, path = _chosen(run, level, part.column(0).to_numpy().view(np.uint64), sample, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(np.full(len(row), run, dtype=np.int32)), part.column(2).take(pa.array(row))], ["path", "run", "sig"])

    return f


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def stars(self, name: list[str], low: int, high: int) -> list[tuple[str, str]]:
        """(member, smallest name of its tree) for the other members of each tree among low .. high: as the head is
        chosen by name, most buckets of a group give the same edges."""
        head: dict[int, str] = {}
        roots = [self.find(k) for k in range(low, high)]
        for k, r in enumerate(roots, low):
            head[r] = min(head.get(r, name[k]), name[k])
        return [(name[k], head[r]) for k, r in enumerate(roots, low) if name[k] != head[r]]


def groups_of(batches, keys: int) -> Iterator[pa.Table]:
    """Whole groups of the first `keys` columns, from batches sorted by them, gathered into tables of many groups."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            changed[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(changed)
        if rest:
            last = rest[-1]
            same = all(last.column(k)[last.num_rows - 1] == batch.column(k)[0] for k in range(keys))
            if not same:
                yield pa.Table.from_batches(rest)
                rest = []
            elif len(cut):
                yield pa.Table.from_batches([*rest, batch.slice(0, int(cut[0]))])
                batch, rest = batch.slice(int(cut[0])), []
                cut = cut[1:] - cut[0]
        if not rest and len(cut):
            yield pa.Table.from_batches([batch.slice(0, int(cut[-1]))])
            batch = batch.slice(int(cut[-1]))
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _group_starts(table: pa.Table, keys: int) -> np.ndarray:
    changed = np.ones(table.num_rows, dtype=bool)
    changed[1:] = False
    for k in range(keys):
        c = table.column(k).to_numpy()
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), table.num_rows)


def _compare_sketches(least: float) -> Callable:
    """Batches of (path, i, j, side, sig, sketch) sorted by (path, i, j) to stars (a, b) of each bucket's similar nodes."""

    def f(batches):
        for table in groups_of(batches, 3):
            starts = _group_starts(table, 3)
            sig = table.column("sig").to_pylist()
            marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            left, right = [], []
            forest = Forest(len(sig))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                step = max(1, CHUNK // (b - a))
                for low in range(a, b, step):
                    rows = np.arange(low, min(b, low + step))
                    same = (marks[rows, None, :] == marks[None, a:b, :]).sum(axis=2) if len(rows) * (b - a) <= 4096 else np.stack([(marks[a:b] == marks[r]).sum(axis=1) for r in rows])
                    x, y = np.nonzero(same >= least * SKETCH)
                    x, y = rows[x], y + a
                    on = x < y
                    for i, j in zip(x[on].tolist(), y[on].tolist(), strict=True):
                        forest.join(i, j)
                for member, head in forest.stars(sig, a, b):
                    left.append(member)
                    right.append(head)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["a", "b"])

    return f


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows inner-joined with table, which has one row a key. counts: (key, n), the rows of each key. The rows of a key
    with more than SMALL of them stay where they are, or are dealt by salt: no task gets a key whole."""
    hot = table.join(counts.where(F.col("n") > SMALL).select(key), key, "left_semi").withColumn("hot", F.lit(True)).checkpoint()
    if hot.count() <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(hot), key, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)))
        marked = salted.join(hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "salt"], "left")
    columns = [*rows.columns, *(c for c in table.columns if c != key)]
    return marked.where("hot").select(*columns).unionByName(marked.where("hot is null").select(*rows.columns).join(table, key).select(*columns))


def _blocks(size: str, most: int) -> tuple[Column, Column]:
    """The blocks of a row's group, and the one that it is in."""
    blocks = F.greatest(F.ceil(F.col(size) / most), F.lit(1)).cast("int")
    return blocks, F.pmod(F.xxhash64("sig"), blocks).cast("int")


def compared(rows: DataFrame, key: str, most: int, compare: Callable, schema: str, large: bool) -> DataFrame:
    """compare over all pairs of blocks of each group. rows: key (a long), n (of the group), sig and what compare reads;
    compare gets batches of (key, i, j, own, sig, ..) sorted by the first three. large: all groups have more than `most`
    rows, otherwise none has; rows are made once either way."""
    payload = [c for c in rows.columns if c not in (key, "n", "sig")]
    columns = [key, "i", "j", "own", "sig", *payload]
    if not large:
        zero = F.lit(0)
        one = rows.select(key, zero.alias("i"), zero.alias("j"), zero.alias("own"), "sig", *payload)
        return one.repartition(key).sortWithinPartitions(key).mapInArrow(lean(compare), schema)
    spark = rows.sparkSession
    folder = shared_folder(spark, "blocks")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    blocks, own = _blocks("n", most)

    def write(batches):
        place, at = fs.FileSystem.from_uri(folder)
        for table in groups_of(batches, 2):
            starts = _group_starts(table, 2)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                file = f"{at}/{part.column(0)[0].as_py() & (2**64 - 1):016x}-{part.column(1)[0].as_py()}"
                hidden = f"{file}.{uuid.uuid4().hex}"
                with place.open_output_stream(hidden) as f, pa.ipc.new_stream(f, part.schema) as s:
                    s.write_table(part)
                put_in_place(place, hidden, file)
            yield pa.RecordBatch.from_arrays([table.column(0).take(starts[:-1]).combine_chunks(), table.column(2).take(starts[:-1]).combine_chunks()], ["g", "blocks"])

    def read(place, file: str) -> list[pa.Table]:
        if place.get_file_info(file).type != fs.FileType.File:  # a block that no row fell into
            return []
        with place.open_input_stream(file) as f:
            return [pa.ipc.open_stream(f).read_all()]

    def pairs(batches):
        place, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for g, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = [t for k in sorted({i, j}) for t in read(place, f"{at}/{g & (2**64 - 1):016x}-{k}")]
                if not held:
                    continue
                both = pa.concat_tables(held).combine_chunks()
                n = both.num_rows
                arrays = [pa.array(np.full(n, g)), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, j, np.int32)), both.column("own").combine_chunks(), both.column("sig").combine_chunks(), *(both.column(c).combine_chunks() for c in payload)]
                yield from compare(iter([pa.RecordBatch.from_arrays(arrays, columns)]))

    dealt = rows.select(F.col(key).alias("g"), own.alias("own"), blocks.alias("blocks"), "sig", *payload).repartition("g", "own").sortWithinPartitions("g", "own")
    groups = dealt.mapInArrow(lean(write), "g long, blocks int").distinct().checkpoint()
    each = groups.select("g", "blocks", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i")).select("g", "i", F.explode(F.expr("sequence(i, blocks - 1)")).alias("j"))
    return each.repartition("g", "i", "j").mapInArrow(lean(pairs), schema)


def _verify(similarity: float) -> Callable:
    """Sets of (component, i, j) to exact links: ('count', sig, null, n) and ('edge', sig, sig, null) rows."""

    def f(batches):
        for table in groups_of(batches, 3):
            starts = _group_starts(table, 3)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
                seen: dict[str, int] = {}
                sig, own, copies, sets = [], [], [], []
                for s, o, c, x in zip(part.column("sig").to_pylist(), part.column("own").to_pylist(), part.column("copies").to_pylist(), part.column("set").to_pylist(), strict=True):
                    if s not in seen:
                        seen[s] = len(sig)
                        sig.append(s)
                        own.append(o)
                        copies.append(c)
                        sets.append(np.frombuffer(x, dtype=np.uint64))
                n = len(sig)
                sizes = np.array([len(x) for x in sets])
                tokens = np.concatenate(sets)
                holder = np.repeat(np.arange(n), sizes)
                order = np.argsort(tokens, kind="stable")
                value, first = np.unique(tokens[order], return_index=True)
                posting = holder[order]
                ends = np.append(first[1:], len(posting))
                place = np.searchsorted(value, tokens)  # of each set's tokens in the inverted lists
                where = np.concatenate([[0], np.cumsum(sizes)])
                links = np.zeros(n, dtype=np.int64)
                weight = np.array(copies)
                forest, left, right = Forest(n), [], []
                side = np.array(own)
                for x in range(n):
                    slots = place[where[x] : where[x + 1]]
                    many = ends[slots] - first[slots]
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    common = np.bincount(posting[np.repeat(first[slots], many) + step], minlength=n)
                    like = common >= similarity * (sizes + sizes[x] - common) - 1e-9
                    like[x] = False
                    if i != j:
                        like &= side != side[x]
                    links[x] = weight[like].sum()
                    for y in np.flatnonzero(like).tolist():
                        forest.join(x, y)
                for member, head in forest.stars(sig, 0, n):
                    left.append(member)
                    right.append(head)
                kept = np.flatnonzero(links).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sig[k] for k in kept] + left, pa.string()), pa.array([None] * len(kept) + right, pa.string()), pa.array(links[kept].tolist() + [None] * len(left), pa.int64())],
                    ["a", "b", "links"],
                )

    return f


def _sets_of(batches):
    for batch in batches:
        sig, sets = [], []
        for s in shingle_sets(text_array(batch)):
            sig.append(signature(s))
            sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.string()), pa.array(sets, pa.binary())], ["sig", "set"])


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Near-duplicate classes: one row per input row with doc_id, class_id, n_links, n_copies, sig (a digest of its set,
    null without one).

    Two documents are linked if their shingle sets have a Jaccard similarity of `similarity` or more. class_id is
    the smallest doc_id of the documents that links lead to; n_links counts the other documents that are linked,
    copies among them; n_copies the documents of the same set, itself included. A null or empty text, or one of
    white space, has no shingles: it is a class of its own with no links. Repeated rows are copies. A null doc_id is
    treated like any other row but never names a class unless all are null. A doc_id may come with several texts: each
    is a row of its own class. Very long texts are read whole; a table without rows gives none; other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    checkpoint_root(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", "text")
    rows = slim.mapInArrow(lean(_features), f"doc_id {kind}, sig string, size long, sketch binary, sample binary").checkpoint()
    nodes = (
        rows.where("sig is not null")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"), F.first("sample").alias("sample"))
        .checkpoint()
    )
    marks = nodes.select("sig", "sketch")
    least = similarity - 6 * math.sqrt(similarity * (1 - similarity) / SKETCH)
    paths = nodes.select("sig", "sample").mapInArrow(lean(_first_paths(runs_for(recall, similarity), similarity)), "path long, run int, sig string")
    leaves, deep = [], None
    for level in range(2, DEPTH + 2):
        paths = paths.checkpoint()
        sizes = paths.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").checkpoint()
        sized = hot_join(paths, sizes, "path", sizes).checkpoint()
        leaves.append(sized.where(F.col("n") <= SMALL).select("path", "sig", "n"))
        more = sized.where(F.col("n") > SMALL)
        if not more.limit(1).count():
            break
        if level == DEPTH + 1:
            deep = more.select("path", "sig", "n")
            break
        large = more.select("path", "run", "sig").join(nodes.select("sig", "sample"), "sig")
        paths = large.select("path", "run", "sig", "sample").mapInArrow(lean(_next_paths(level, similarity)), "path long, run int, sig string")
    marked = lambda rows: rows.join(marks, "sig").select("path", "n", "sig", "sketch")
    stars = compared(marked(reduce(DataFrame.unionByName, leaves)), "path", SMALL, _compare_sketches(least), "a string, b string", large=False)
    if deep is not None:
        stars = stars.unionByName(compared(marked(deep), "path", SMALL, _compare_sketches(least), "a string, b string", large=True))
    candidates = connected_components(stars).select(F.col("node").alias("sig"), "component").checkpoint()
    sizes = candidates.groupBy("component").agg(F.count("*").alias("n")).checkpoint()
    wanted = hot_join(candidates, sizes, "component", sizes).join(nodes.select("sig", "rep", "copies"), "sig").select("component", "n", "sig", "rep", "copies").checkpoint()

    def verified(of: DataFrame, large: bool) -> DataFrame:
        ids = _ids(of.select(F.col("rep").alias("wanted_id")).distinct())
        again = slim.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
        sets = again.mapInArrow(lean(_sets_of), "sig string, set binary")
        parts = of.drop("rep").join(sets, "sig").select(F.xxhash64("component").alias("c"), "n", "sig", "copies", "set")
        return compared(parts, "c", BLOCK, _verify(similarity), "a string, b string, links long", large)

    found = verified(wanted.where(F.col("n") <= BLOCK), large=False)
    if wanted.where(F.col("n") > BLOCK).limit(1).count():
        found = found.unionByName(verified(wanted.where(F.col("n") > BLOCK), large=True))
    found = found.checkpoint()
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("sig"), "component").checkpoint()
    named = classes.join(nodes.select("sig", "rep"), "sig").groupBy("component").agg(F.min("rep").alias("class_rep"), F.count("*").alias("n")).checkpoint()
    by_node = hot_join(classes, named.select("component", "class_rep"), "component", named).select(F.col("sig").alias("linked"), "class_rep")
    full = (
        nodes.select("sig", "rep", "copies")
        .join(by_node, F.col("sig") == F.col("linked"), "left")
        .join(links, F.col("sig") == F.col("a"), "left")
        .select("sig", F.coalesce("class_rep", "rep").alias("class_id"), F.col("copies").alias("n_copies"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        .checkpoint()
    )
    known = hot_join(rows.select("doc_id", "sig").where("sig is not null"), full, "sig", full.select("sig", F.col("n_copies").alias("n")))
    alone = rows.where("sig is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), "sig")
    return known.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_links", "n_copies", "sig").unionByName(alone)


def _ids(rows: DataFrame) -> DataFrame:
    """A table of ids, broadcast after a check of its size."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def _with_signature(docs: DataFrame) -> DataFrame:
    """(row, doc_id, sig) of whole rows."""

    def f(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([signature(s) for s in shingle_sets(text_array(batch))], pa.string())], ["row", "doc_id", "sig"])

    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return packed.mapInArrow(lean(f), T.StructType([*packed.schema.fields[:2], T.StructField("sig", T.StringType())]))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents of docs without near copies: of each class the one whose doc_id names it, with docs' own columns.

    Rows without a doc_id stay. Rows that repeat a doc_id are each judged by the class of their own text, and of equal
    ones that name their class one stays; one that lies in another document's class goes.
    """
    classes = jaccard_join(docs, similarity).checkpoint()
    known = classes.where("doc_id is not null")
    gone = _ids(known.where("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct())
    kept = docs.join(gone, docs["doc_id"] == F.col("gone_id"), "left_anti")
    twice = known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id")).checkpoint()
    if not twice.limit(1).count():
        return kept
    twice = _ids(twice)
    heads = known.where("doc_id = class_id").select(F.col("doc_id").alias("head_id"), F.col("sig").alias("head_sig")).distinct()
    repeated = _with_signature(docs.join(twice, docs["doc_id"] == F.col("twice_id"), "left_semi"))
    judged = repeated.join(heads, (F.col("doc_id") == F.col("head_id")) & F.col("sig").eqNullSafe(F.col("head_sig")), "left_semi").select("row.*").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, kept["doc_id"] == F.col("twice_id"), "left_anti").unionByName(judged)
