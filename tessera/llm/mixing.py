"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's share p of all tokens is raised to an exponent a between 0 (all sources alike) and 1 (as they are) and
normalised. The exponent is bisected: as low as the target entropy asks for, but not below what the repetition limit
allows. Without a budget, the mixture is the smallest one that shows every document at least once: the largest
source makes one epoch and a source of T tokens gets the quota Tmax * (T / Tmax) ** a. With a budget of tokens the
quota is the budget's share, and may be less than an epoch.

Quotas are realised as budgeted block permutations. A source's documents fall into BLOCKS blocks by a hash of
doc_id, and a block of more than PART_TOKENS tokens into parts of about as many. Each epoch is a permutation of the
blocks, within a block of its parts, and within a part of its documents, by hashes of the epoch; block_rank and place
say where a document stands. Full epochs take every block; the last takes blocks in its order while they fit into
what is left of the quota, and of the first block that does not fit the documents in their order while they fit.

Shape: the documents are scanned once for the tokens of (source, block), which is a bounded table that is partly
summed before its shuffle, whatever one source holds; then for the result, joined to that table by broadcast after a
check of its size, so rows stay where they are. On the budget's edge, one block a source, whole parts are taken the
same way and only one part, of bounded size, is sorted document by document. Ranks of documents are made of slim rows,
a block at a time. Up to LISTED_SOURCES sources the exponent is found in one row; beyond, by sections over the table of
sources, to the same value. Tokens are words between white space.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.quality_rules import WORD
from tessera.llm.shared import checkpoint_root

BLOCKS = 1024
#: Tokens of a block above which it has parts.
PART_TOKENS = 1 << 22
#: Least entropy of the mixture, as a part of the entropy of equal weights; most epochs of a source.
TARGET_ENTROPY, MOST_EPOCHS = 0.98, 1.5
STEPS = 40
#: Sources up to which the table of blocks is broadcast, and up to which their sizes are held in one row.
BROADCAST_SOURCES, LISTED_SOURCES = 256, 10_000


def _hash(*parts: Column) -> Column:
    """32 bits of md5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _bisect(shares: Column, fits) -> Column:
    """The edge between exponents where fits is false, below, and true, above, to 2 ** -STEPS."""
    step = lambda s, _: F.when(fits(shares, (s["low"] + s["high"]) / 2), F.struct(s["low"].alias("low"), ((s["low"] + s["high"]) / 2).alias("high"))).otherwise(
        F.struct(((s["low"] + s["high"]) / 2).alias("low"), s["high"].alias("high"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), step, lambda s: s["high"])


def _seldom(least: Column, a: Column, most_epochs: float) -> Column:
    return F.pow(least, a - 1) <= most_epochs


def _by_epochs(least: Column, most_epochs: float) -> Column:
    """The least exponent at which the smallest source, `least` of the largest, is repeated often enough and no more."""
    return F.when(_seldom(least, F.lit(0.0), most_epochs), F.lit(0.0)).otherwise(_bisect(F.array(least), lambda r, a: _seldom(F.get(r, F.lit(0)), a, most_epochs)))


def _rounded(a: Column) -> Column:
    return F.ceil(a * 1_000_000) / 1_000_000


def exponent_of(tokens: Column, target_entropy: float, most_epochs: float) -> Column:
    """The exponent for an array of the sources' token counts, rounded up to six places."""
    largest = F.array_max(tokens)
    ratios = F.transform(tokens, lambda t: t / largest)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    def too_even(r: Column, a: Column) -> Column:  # below the target: the exponent must not be higher
        z = total(F.transform(r, lambda x: F.pow(x, a)))
        h = total(F.transform(r, lambda x: -F.pow(x, a) / z * F.log(F.pow(x, a) / z)))
        return h < target_entropy * F.log(F.size(r).cast("double"))

    by_entropy = F.when(too_even(ratios, F.lit(1.0)), _bisect(ratios, too_even)).otherwise(F.lit(1.0))
    return _rounded(F.greatest(by_entropy, _by_epochs(F.array_min(ratios), most_epochs)))


def exponent_by_sections(sources: DataFrame, target_entropy: float, most_epochs: float, bits: int = 5) -> float:
    """exponent_of for any number of sources with tokens: each pass over the table tries 2 ** bits sections of what is
    left between the bounds, so STEPS halvings take STEPS / bits passes."""
    ends = sources.agg(F.max("source_tokens").alias("high"), F.min("source_tokens").alias("low"), F.count("*").alias("n")).first()
    ratio = F.col("source_tokens") / F.lit(ends.high)

    def even(exponents: list[float]) -> list[bool]:
        """Whether the entropy is below the target at each exponent."""
        w = F.pow(ratio, F.element_at(F.array(*map(F.lit, exponents)), F.col("k") + 1))
        tried = sources.select(F.posexplode(F.array(*[F.lit(0)] * len(exponents))).alias("k", "x"), "source_tokens")
        sums = tried.select("k", w.alias("w")).groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("l"))
        found = {r.k: r.h for r in sums.select("k", (F.log("z") - F.col("l") / F.col("z")).alias("h")).collect()}
        goal = target_entropy * math.log(ends.n)
        return [found[k] < goal for k in range(len(exponents))]

    by_entropy = 1.0
    if even([1.0])[0]:
        low, width = 0.0, 1.0
        for _ in range(0, STEPS, bits):
            step = width / (1 << bits)
            tried = [low + step * k for k in range(1, 1 << bits)]
            below = sum(1 for x in even(tried) if not x)  # entropy falls as the exponent grows
            low, width = low + step * below, step
        by_entropy = low + width
    one = sources.sparkSession.range(1).select(F.lit(ends.low / ends.high).alias("least"))
    return one.select(_rounded(F.greatest(F.lit(by_entropy), _by_epochs(F.col("least"), most_epochs))).alias("a")).first().a


def _keyed(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """doc_id as text, a source key that is never null, block, text, and what is carried along."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("mix_source"),
        F.coalesce("text", F.lit("")).alias("mix_text"),
        *carried,
    ).withColumn("block", _hash(F.col("mix_id")) % BLOCKS)


def _n_tokens() -> Column:
    return F.regexp_count("mix_text", F.lit(WORD)).cast("long").alias("n_tokens")


def _part(parts: Column) -> Column:
    return F.when(parts > 1, _hash(F.col("mix_id"), F.lit("part")) % parts).otherwise(0).cast("long").alias("part")


def _part_order() -> list[Column]:
    return [_hash(F.col("mix_source"), F.col("block").cast("string"), F.col("part").cast("string"), F.col("epoch").cast("string")), F.col("part")]


def _document_order(*ties: str) -> list[Column]:
    return [_hash(F.col("mix_id"), F.col("epoch").cast("string")), F.col("mix_id"), *map(F.col, ties)]


def _exponent(sources: DataFrame, n: int, target_entropy: float, most_epochs: float) -> tuple[float, int, float]:
    """The exponent, the largest source's tokens, and the sum of all sources' weights before they are normalised."""
    filled = sources.where("source_tokens > 0")
    if n <= LISTED_SOURCES:
        one = filled.agg(F.array_sort(F.collect_list("source_tokens")).alias("t")).where(F.size("t") > 0)
        a = one.select(exponent_of(F.col("t"), target_entropy, most_epochs).alias("a")).first()
        a = a.a if a else None
    else:
        a = exponent_by_sections(filled, target_entropy, most_epochs) if filled.limit(1).count() else None
    if a is None:
        return 1.0, 1, 1.0
    largest = filled.agg(F.max("source_tokens").alias("m")).first().m
    return a, largest, filled.agg(F.sum(F.pow(F.col("source_tokens") / F.lit(largest), F.lit(a))).alias("z")).first().z


def _plan(docs: DataFrame, target_entropy: float, most_epochs: float, budget: int | None) -> tuple[DataFrame, int]:
    """(source, block, epoch) that is shown, with the block's rank in the epoch, its parts, and what is taken of it."""
    checkpoint_root(docs.sparkSession)
    blocks = _keyed(docs, []).select("mix_source", "block", _n_tokens()).groupBy("mix_source", "block").agg(F.sum("n_tokens").alias("block_tokens")).checkpoint()
    sources = blocks.groupBy("mix_source").agg(F.sum("block_tokens").alias("source_tokens"))
    n = sources.count()
    a, largest, z = _exponent(sources, n, target_entropy, most_epochs)
    part = F.pow(F.col("source_tokens") / F.lit(largest), F.lit(a))
    quota = F.floor(F.lit(largest) * part) if budget is None else F.floor(F.lit(float(budget)) * part / F.lit(z))
    # a source without tokens costs nothing: one epoch
    fit = sources.select(
        "mix_source",
        F.lit(a).alias("exponent"),
        (part / F.lit(z)).alias("weight"),
        F.when(F.col("source_tokens") > 0, F.floor(quota / F.col("source_tokens"))).otherwise(1).cast("long").alias("epochs"),
        F.when(F.col("source_tokens") > 0, quota % F.col("source_tokens")).otherwise(0).cast("long").alias("rest"),
    )
    order = W.partitionBy("mix_source", "epoch").orderBy(_hash(F.col("mix_source"), F.col("block").cast("string"), F.col("epoch").cast("string")), "block")
    ends = F.sum("block_tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = blocks.join(fit, "mix_source").withColumn("epoch", F.explode(F.expr("sequence(0L, epochs)"))).withColumn("block_rank", F.row_number().over(order)).withColumn("ends", ends)
    room = F.col("rest") - F.col("ends") + F.col("block_tokens")
    taken = F.when((F.col("epoch") < F.col("epochs")) | (F.col("ends") <= F.col("rest")), "all").when(room > 0, "some").otherwise("none")
    parts = F.ceil(F.col("block_tokens") / F.lit(PART_TOKENS)).cast("long")
    plan = placed.select("mix_source", "block", "epoch", F.col("block_rank").cast("long").alias("block_rank"), "exponent", "weight", parts.alias("parts"), taken.alias("takes"), room.alias("room")).where("takes <> 'none'")
    return plan.checkpoint(), n


def _mixed(docs: DataFrame, carried: list[Column], ties: list[str], target_entropy: float, most_epochs: float, budget: int | None) -> DataFrame:
    """Rows as often as they are shown, with part, n_tokens and the plan's columns."""
    plan, sources = _plan(docs, target_entropy, most_epochs, budget)
    keys = ["mix_source", "block"]
    small = lambda rows, most: F.broadcast(rows) if sources <= most else rows
    told = ["exponent", "weight", "epoch", "block_rank", "parts"]
    every = _keyed(docs, carried)
    whole = every.join(small(plan.where("takes = 'all'").select(*keys, *told), BROADCAST_SOURCES), keys).withColumn("part", _part(F.col("parts")))
    edge = plan.where("takes = 'some'").select(*keys, *told, "room")
    near = every.join(small(edge, BROADCAST_SOURCES * BLOCKS), keys).withColumn("part", _part(F.col("parts")))
    sums = near.select(*keys, "epoch", "room", "part", _n_tokens()).groupBy(*keys, "epoch", "room", "part").agg(F.sum("n_tokens").alias("part_tokens"))
    line = W.partitionBy(*keys).orderBy(*_part_order()).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = sums.withColumn("part_room", F.col("room") - F.sum("part_tokens").over(line) + F.col("part_tokens")).where("part_room >= 0").select(*keys, "part", "part_room", (F.col("part_tokens") <= F.col("part_room")).alias("fits")).checkpoint()
    parts = cut.count()
    cut = F.broadcast(cut) if parts <= BROADCAST_SOURCES * BLOCKS else cut
    near = near.join(cut, [*keys, "part"])
    line = W.partitionBy(*keys, "part").orderBy(*_document_order(*ties)).rowsBetween(W.unboundedPreceding, W.currentRow)
    some = near.where("not fits").withColumn("n_tokens", _n_tokens()).withColumn("mix_digest", F.md5("mix_text")).withColumn("used", F.sum("n_tokens").over(line)).where("used <= part_room")
    columns = [*every.columns, *told, "part", "n_tokens"]
    return whole.withColumn("n_tokens", _n_tokens()).select(*columns).unionByName(near.where("fits").withColumn("n_tokens", _n_tokens()).select(*columns)).unionByName(some.select(*columns))


def mix_sources(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, most_epochs: float = MOST_EPOCHS, budget: int | None = None) -> DataFrame:
    """The mixture: a row for each time that a document is shown.

    Returns doc_id, source, n_tokens, epoch (from 0), block, block_rank (of the block in the epoch's permutation, from
    1), place (of the document in its block in that epoch, from 1), exponent, weight (of the source): in order of
    epoch, block_rank and place, the rows of a source are its budgeted permutation. Sources may be null (a source of its
    own); documents without tokens, null texts among them, come in every full epoch; rows that repeat a doc_id are
    shown each and stand in order of their texts' digests; very long texts count as any other; a table without rows
    gives none; other columns, whatever their names, are not read.
    """
    out = _mixed(docs, [F.col("doc_id").alias("own_id"), F.col("source").alias("own_source")], ["mix_digest"], target_entropy, most_epochs, budget).withColumn("mix_digest", F.md5("mix_text")).drop("mix_text")
    line = W.partitionBy("mix_source", "epoch", "block").orderBy(*_part_order(), *_document_order("mix_digest"))
    placed = out.withColumn("place", F.row_number().over(line).cast("long"))
    return placed.select(F.col("own_id").alias("doc_id"), F.col("own_source").alias("source"), "n_tokens", "epoch", "block", "block_rank", "place", "exponent", "weight")


def mix_rows(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, most_epochs: float = MOST_EPOCHS, budget: int | None = None) -> DataFrame:
    """The mixture as rows of docs, with docs' own columns only; see mix_sources. Rows of one doc_id and text that the
    budget's edge parts are told apart by a hash of their other columns."""
    hashed = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    return _mixed(docs, [F.struct("*").alias("own_row"), F.xxhash64(*hashed).alias("own_hash")], ["mix_digest", "own_hash"], target_entropy, most_epochs, budget).select("own_row.*")
