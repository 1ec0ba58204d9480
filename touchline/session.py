"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the operators were planned with.  Broadcast joins are left to AQE,
#: which decides from measured shuffle sizes, never from a hint.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "touchline", **extra: str) -> SparkSession:
    """A session with the defaults; `extra` wins.  Master comes from spark-submit."""
    b = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in `spark.checkpoint.dir`.  Only where that is unset
    (a local test) is a temporary folder made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/touchline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading back.

    Unlike a cached or locally checkpointed frame this survives the loss of any
    executor, and the reader gets exact sizes for its join choices.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of few row groups is read by few tasks, in however many pieces the file is dealt; working on its rows takes far longer than moving them."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    n = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    return df.repartition(tasks, key) if n[0] and n[1] * tasks > 2 * n[0] else df


def forget(*cuts: DataFrame) -> None:
    """Delete what `cut` has written for these frames; for those whose every reader is written out itself."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
