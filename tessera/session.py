"""Sessions with the settings that the engine counts on; anything already set on the cluster wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str, cores: int | None = None, **conf: str) -> SparkSession:
    """A session; cores asks for a local one."""
    b = SparkSession.builder.appName(name)
    for k, v in (DEFAULTS | conf).items():
        b = b.config(k, v)
    if cores or "SPARK_MASTER" not in os.environ:
        n = cores or os.cpu_count() or 1
        b = b.master(f"local[{n}]").config("spark.sql.shuffle.partitions", str(n)).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may go without: it gets a
    temporary one; on a cluster a machine's own folder would lose data, so it is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            import tempfile

            root = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        context.setCheckpointDir(root)
    return context.getCheckpointDir()
