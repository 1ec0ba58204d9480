"""Log records as JSON, the durable log, and match documents in parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from touchline.operators import log as LG


def encode(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, match_id, body): what a stream or log carries."""
    return rows.select(F.lit(kind).alias("kind"), "match_id", F.to_json(F.struct("*")).alias("body"))


def decode(records: DataFrame, kind: str, schema: StructType) -> DataFrame:
    return records.filter(F.col("kind") == kind).select(F.from_json("body", schema).alias("r")).select("r.*")


def append_log(events: DataFrame, root: str, key: str = "event_id") -> None:
    """Append records not yet in the log; a redelivery changes nothing.

    The log is partitioned by a bucket of the match, so a batch reads only the
    buckets it touches.
    """
    spark = events.sparkSession
    new = LG._first_copy(events, ["match_id", key], []).withColumn("bucket", bucket())
    if exists(spark, root):
        buckets = [r[0] for r in new.select("bucket").distinct().collect()]  # at most BUCKETS values
        old = spark.read.schema(new.schema).parquet(root).filter(F.col("bucket").isin(buckets)).select("match_id", key)
        new = new.join(old, ["match_id", key], "left_anti")
    new.write.mode("append").partitionBy("bucket").parquet(root)


BUCKETS = 64


def bucket():
    return F.pmod(F.xxhash64("match_id"), F.lit(BUCKETS)).cast("int")


def read_log(spark: SparkSession, root: str, schema: StructType, match_id=None) -> DataFrame:
    """The log, or one match's part of it (one bucket is scanned)."""
    log = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(root)
    if match_id is not None:
        one = F.lit(match_id).cast(schema["match_id"].dataType)
        log = log.filter((F.col("bucket") == F.pmod(F.xxhash64(one), F.lit(BUCKETS)).cast("int")) & (F.col("match_id") == one))
    return log.drop("bucket")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


PARTS = ("state", "report", "series", "shots", "network")


def write_documents(parts: dict[str, DataFrame], root: str) -> None:
    """Each part of the match documents is its own table: a page that shows the
    score does not read the shot map."""
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_part(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def document_index(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows held per match and part."""
    counts = [df.groupBy("match_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(n)) for n, df in parts.items()]
    return reduce(DataFrame.unionByName, counts)
