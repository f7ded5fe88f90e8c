"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# On a cluster start from many shuffle partitions and let adaptive execution merge small ones.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
}


def build_session(master: str | None = None, app: str = "trialspark", **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots.

    Without ``master`` the one of ``spark-submit`` is used, with settings for a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = master is not None and master.startswith("local")
    extra = {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in {**CONF, **({} if local else CLUSTER_CONF), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="trialspark-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a reduced table that several branches read.

    The files go to the shared checkpoint folder, so a lost executor costs a re-read and
    never a wrong result. Meant for reduced tables rather than for trial rows.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
