"""Streams: transcripts as they arrive, and event windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as t
from tessera.operators.diagnostics import searchable

ARRIVING = T.StructType(
    [
        T.StructField("window_id", T.StringType()), T.StructField("video_id", T.StringType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
        T.StructField("status", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("arrived", T.TimestampType()),
    ]
)


def prepared(rows: DataFrame) -> DataFrame:
    """The text rules that need no other window: searched text, eligibility, identity."""
    out = rows.withColumn("retrieval_text", t.unit_aliases(F.col("raw_text"))).withColumn("eligible", searchable(F.col("status"), F.col("retrieval_text"), F.array().cast("array<string>")))
    return out.withColumn("identity", t.identity("end_s", "retrieval_text", "start_s", "video_id", "window_id"))


def transcript_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return prepared(spark.readStream.schema(ARRIVING).option("maxFilesPerTrigger", files_a_batch).json(path))


def write_staging(stream: DataFrame, table: str, checkpoint: str, late: str = "1 hour"):
    """Appends windows to a staging table, each (window, identity) once while it may still come again."""
    once = stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["window_id", "identity"])
    return once.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(staging: DataFrame) -> DataFrame:
    """The last arrival of each window."""
    return staging.groupBy("window_id").agg(F.max_by(F.struct(*(c for c in staging.columns if c != "window_id")), F.struct("arrived", "identity")).alias("x")).select("window_id", "x.*")


def event_windows(events: DataFrame, length: str = "60 seconds", slide: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events in sliding windows; on a stream, windows close `late` after their end."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
