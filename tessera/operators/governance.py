"""Checks of tables against each other and against contracts. A check returns its findings; no rows is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unioned(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def identity_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both tables with the side that has them: left_only, right_only or both."""
    a, b = left.select(*keys).distinct().withColumn("in_left", F.lit(True)), right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    return a.join(b, keys, "full").select(*keys, F.when(F.col("in_right").isNull(), "left_only").when(F.col("in_left").isNull(), "right_only").otherwise("both").alias("side"))


def missing_and_extra(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Expected keys that are missing and observed ones that are extra."""
    e, o = expected.select(key).distinct(), observed.select(key).distinct()
    return e.join(o, key, "left_anti").withColumn("problem", F.lit("missing")).unionByName(o.join(e, key, "left_anti").withColumn("problem", F.lit("extra")))


def leakage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that two splits share."""
    return a.select(key).intersect(b.select(key))


def completed(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected window, with the actual columns, or status `missing`."""
    out = expected.join(actual, keys, "left")
    return out.withColumn("status", F.coalesce(F.col("status"), F.lit("missing")))


def field_mismatches(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-6) -> DataFrame:
    """How many rows differ in each field, nulls compared too."""
    b = actual.select(*keys, *(F.col(f).alias(f"{f}_actual") for f in fields))
    both = expected.select(*keys, *fields).join(b, keys)
    kinds = dict(expected.dtypes)

    def differs(f: str) -> Column:
        x, y = F.col(f), F.col(f"{f}_actual")
        return (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) if kinds[f] in ("double", "float") else ~x.eqNullSafe(y)

    counts = both.agg(*(F.sum(differs(f).cast("long")).alias(f) for f in fields))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0)).alias("mismatches")) for f in fields))).alias("x")).select("x.*")


def contract(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Violations of row conditions in one pass: (check, violations)."""
    counts = rows.agg(*(F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(n) for n, c in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias("violations")) for n in checks))).alias("x")).select("x.*")


# What a benchmark's rows must satisfy.
BENCHMARK_CHECKS = {
    "positive_duration": "end_s > start_s",
    "start_not_negative": "start_s >= 0",
    "has_video": "video_id is not null",
}


def pool_contract(pool: DataFrame, queries: DataFrame, video_k: int, windows_m: int) -> DataFrame:
    """Queries whose candidate pool breaks the contract, with what breaks it: no_pool, unknown_query, repeated_window,
    video_count (not exactly K videos), row_count (more than K * M rows) or empty_text."""
    held = pool.groupBy("query_id").agg(
        F.count("*").alias("rows"), F.count_distinct("window_id").alias("windows"), F.count_distinct("video_id").alias("videos"), F.sum((F.coalesce(F.trim("text"), F.lit("")) == "").cast("long")).alias("empty")
    )
    both = queries.select("query_id").distinct().withColumn("asked", F.lit(True)).join(held, "query_id", "full")
    broken = F.when(F.col("asked").isNull(), F.array(F.lit("unknown_query"))).when(F.col("rows").isNull(), F.array(F.lit("no_pool"))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("rows") != F.col("windows"), "repeated_window"), F.when(F.col("videos") != video_k, "video_count"),
                F.when(F.col("rows") > video_k * windows_m, "row_count"), F.when(F.col("empty") > 0, "empty_text"),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return both.select("query_id", F.explode(broken).alias("problem"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two runs has, with the run's name; none if the runs agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def determinism(runs: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose repeats do not agree on a value."""
    return runs.groupBy(key).agg(F.count_distinct(value).alias("different")).where("different <> 1")


def transcript_status(observed: Column, expected: Column, failed: Column, empty: Column, invalid: Column) -> Column:
    """missing, invalid, partial, complete_with_failures, complete_with_empty or complete."""
    return (
        F.when(F.coalesce(observed, F.lit(0)) == 0, "missing")
        .when(F.coalesce(invalid, F.lit(0)) > 0, "invalid")
        .when(observed < expected, "partial")
        .when(F.coalesce(failed, F.lit(0)) > 0, "complete_with_failures")
        .when(F.coalesce(empty, F.lit(0)) > 0, "complete_with_empty")
        .otherwise("complete")
    )


def reusable(old: DataFrame, new: DataFrame, keys: list[str], identity: str = "identity") -> DataFrame:
    """New rows with the old value where keys and identity agree, and whether it was reused."""
    o = old.select(*keys, F.col(identity).alias("old_identity"), F.col("value").alias("old_value"))
    j = new.join(o, keys, "left")
    same = F.coalesce(F.col(identity) == F.col("old_identity"), F.lit(False))
    return j.withColumn("reused", same).withColumn("value", F.when(same, F.col("old_value"))).drop("old_identity", "old_value")


def acceptance(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """One row: accepted, and the names of the gates that block."""
    out = rows.agg(*(c.alias(n) for n, c in gates.items()))
    blockers = F.filter(F.array(*(F.when(~F.coalesce(F.col(f"`{n}`"), F.lit(False)), F.lit(n)) for n in gates)), lambda x: x.isNotNull())
    return out.select((F.size(blockers) == 0).alias("accepted"), blockers.alias("blockers"))


def table_identity(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the count and an order-free digest of a table's rows, so that it never gathers them: sums of row hashes."""
    h = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    word = lambda k: F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(word(1 + 8 * k).cast("string") for k in range(8))), 256).alias("digest"))


def benchmark_problems(queries: DataFrame, windows: DataFrame, expected: dict[str, int]) -> DataFrame:
    """What is wrong with a benchmark, as (problem, n): counts that differ from the expected ones (query_count,
    window_count, video_count), repeated ids, windows without length, queries of videos without windows, and queries
    that stand in several splits. queries: query_id, correct_video, split; windows: window_id, video_id, start_s, end_s."""
    videos = windows.select("video_id").distinct()
    sizes = {"query_count": queries, "window_count": windows, "video_count": videos}
    counted = [sizes[name].agg((F.count("*") - n).alias("n")).select(F.lit(name).alias("problem"), "n") for name, n in expected.items()]
    found = [
        duplicate_keys(windows, ["window_id"]).agg(F.count("*").alias("n")).select(F.lit("repeated_window").alias("problem"), "n"),
        windows.where(~F.coalesce(F.col("end_s") > F.col("start_s"), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("no_duration").alias("problem"), "n"),
        queries.join(videos.withColumnRenamed("video_id", "correct_video"), "correct_video", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unknown_video").alias("problem"), "n"),
        queries.groupBy("query_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1").agg(F.count("*").alias("n")).select(F.lit("split_overlap").alias("problem"), "n"),
    ]
    return unioned([*counted, *found]).where("n <> 0")


def corpus_contract(queries: DataFrame, holdout: DataFrame, count: int, digest: str | None, columns: list[str]) -> DataFrame:
    """Whether a query set is the agreed one, as (check, passes): its count, its digest (see table_identity; not asked
    for if None), and that no query of the holdout is in it."""
    own = table_identity(queries, columns).first()
    leaked = leakage(queries, holdout, "query_id").limit(1).count()
    rows = [("query_count", own.n == count), ("holdout_leakage", not leaked)] + ([("digest", own.digest == digest)] if digest is not None else [])
    return queries.sparkSession.createDataFrame(rows, "check string, passes boolean")


def frozen(rows: DataFrame, columns: list[str]) -> dict:
    """The identity of a table to write down: its columns, count and digest."""
    r = table_identity(rows, columns).first()
    return {"columns": sorted(columns), "n": r.n, "digest": r.digest}


def prerequisite_problems(tables: dict[str, DataFrame], contracts: dict[str, dict]) -> list[str]:
    """What keeps a stage from starting: a table that is missing, lacks columns, or is not the one that was frozen."""
    out = []
    for name, c in sorted(contracts.items()):
        if name not in tables:
            out.append(f"{name} is missing")
            continue
        lacking = sorted(set(c["columns"]) - set(tables[name].columns))
        if lacking:
            out.append(f"{name} lacks {', '.join(lacking)}")
        elif frozen(tables[name], c["columns"]) != {**c, "columns": sorted(c["columns"])}:
            out.append(f"{name} is not the frozen table")
    return out


def verify_inventory(inventory: DataFrame, frozen_inventory: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Differences of an inventory from the frozen one, as (key, problem): missing, extra, or changed."""
    now = inventory.select(key, F.sha2(F.to_json(F.struct(*sorted(fields))), 256).alias("now"))
    then = frozen_inventory.select(key, F.sha2(F.to_json(F.struct(*sorted(fields))), 256).alias("then"))
    kind = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") != F.col("then"), "changed")
    return now.join(then, key, "full").select(key, kind.alias("problem")).where("problem is not null")


def config_problems(config: dict, required: dict[str, tuple]) -> list[str]:
    """Keys of a stage's configuration that are missing or not among their allowed values. required: a dotted key to
    its allowed values (empty: any)."""
    out = []
    for key, allowed in sorted(required.items()):
        at = config
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            out.append(f"{key} is missing")
        elif allowed and at not in allowed:
            out.append(f"{key} is {at!r}, not one of {list(allowed)}")
    return out


def in_any(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns are each among the wanted values; a column without wanted values is not asked."""
    for c, values in wanted.items():
        if values:
            rows = rows.where(F.col(c).isin(list(values)))
    return rows


def split_rows(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    """Rows of an evaluation split, or all."""
    return rows if split == "all" else rows.where(F.col(column) == split)
