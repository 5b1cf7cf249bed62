"""The domain's tables over the driver's: windows, documents, queries, vectors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.operators import retrieval as r

#: Every vector whose id is divisible by it is a query: the stated query set of searches.
QUERY_EVERY = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores where their files give fewer than half as many splits; so few splits are small, and the
    text work that follows costs more than moving them. Tables of many files stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as windows of 60 s every 45 s of a video."""
    c = spread(table(spark, sf_dir, "conversations"))
    start = F.col("turn") * 45.0
    return c.select(
        t.window_id(F.col("conv_id"), F.col("turn")).alias("window_id"), F.col("conv_id").alias("video_id"), F.col("turn").alias("window_index"),
        start.alias("start_s"), (start + 60.0).alias("end_s"), "role", "text",
    )


def documents(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Documents as windows of their sources, tokenised; eligible if any token is left."""
    norm = t.accent_fold(F.col("text")) if folded else t.for_matching(F.col("text"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("video_id"), "text"))
    d = t.once(d.select("doc_id", "video_id", t.tokens(norm).alias("terms")), "terms")
    return d.withColumn("eligible", F.size("terms") > 0)


def both_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their terms with (`terms`) and without marks on letters (`folded`)."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = t.once(d.select("doc_id", t.for_matching(F.col("text")).alias("plain")), "plain")
    return d.select("doc_id", t.tokens(F.col("plain")).alias("terms"), t.tokens(t.fold_marks(F.col("plain"))).alias("folded"))


def queries(spark: SparkSession, sf_dir: str, folded: bool = False) -> DataFrame:
    """Benchmark passages as queries, with all their tokens."""
    norm = t.accent_fold(F.col("text")) if folded else t.for_matching(F.col("text"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), t.tokens(norm).alias("terms"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("video_id"), F.lit(True).alias("eligible"))


def vector_queries(spark: SparkSession, sf_dir: str, every: int = QUERY_EVERY) -> DataFrame:
    """The query vectors: their own label is the right video, their own place the answer."""
    v = vectors(spark, sf_dir).where(F.col("doc_id") % every == 0)
    return v.select(F.col("doc_id").alias("query_id"), "embedding", F.col("video_id").alias("correct_video"), (F.col("doc_id") * 45.0 + 30.0).alias("answer_time_s"))


def scores(spark: SparkSession, sf_dir: str, best: int | None = None, right: bool = False) -> DataFrame:
    """Dense scores of the query vectors as a table of scored windows. best: for whoever takes the best `best` windows of
    each video of a query only; the others are mostly left out where they are scored. right: windows of the right video only."""
    s = r.dense_scores(vectors(spark, sf_dir), vector_queries(spark, sf_dir), keep=("video_id",), digits=9, best=best, best_by="video_id" if best else None, right=right)
    start = F.col("doc_id") * 45.0
    return s.select("query_id", F.col("doc_id").alias("window_id"), "video_id", start.alias("start_s"), (start + 60.0).alias("end_s"), "score")


#: The two methods' roundings of scores, one after the other.
METHODS = {"exact": (9,), "coarse": (9, 1)}


def two_methods(spark: SparkSession, sf_dir: str, right: bool = False) -> DataFrame:
    """Judged scores of two methods: exact, and rounded so that ties appear. right: of the right video only."""
    from tessera.operators.evaluation import relevance

    judged = relevance(scores(spark, sf_dir, right=right), vector_queries(spark, sf_dir))
    return judged.withColumn("method_id", F.lit("exact")).unionByName(judged.withColumn("score", F.round("score", 1)).withColumn("method_id", F.lit("coarse")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of models: the value is the run time in seconds over a window of a minute."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 50 == 0, "failed").when(F.col("event_id") % 77 == 0, "missing").otherwise("ok")
    return e.select(F.col("event_type").alias("model_id"), (F.col("user_id") % 4).alias("stage_id"), status.alias("status"), F.when(status != "missing", F.col("value")).alias("runtime_s"), F.lit(60.0).alias("duration_s"), F.coalesce("props", F.lit("")).alias("raw_text"))
