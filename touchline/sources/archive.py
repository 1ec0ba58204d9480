"""The columnar event archive: scan, write, replace, cluster by player."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import schemas
from touchline.session import scratch

PARTITIONS = ["competition_id", "season_id"]
#: A real match is below this many events and stays in one file; an oversized
#: one is spread over several tasks.
MATCH_BLOCK = 8192


def read(spark: SparkSession, root: str, schema=None) -> DataFrame:
    """Scan either layout.  Hive partitions are pruned before any file opens."""
    return spark.read.schema(schema or schemas.ARCHIVE).parquet(root)


def conform(events: DataFrame) -> DataFrame:
    """Cast to the archive row; columns a feed does not send become null."""
    have = set(events.columns)
    return events.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.ARCHIVE.fields
        ]
    )


def write(events: DataFrame, root: str, files_per_partition: int = 8) -> None:
    """Write partitions, replacing those present in `events` as a whole.

    Rows are laid out by match inside a partition, so the row-group statistics
    of `match_id` stay tight and a single match reads a single row group.
    """
    block = F.xxhash64("match_id", F.floor(F.col("idx") / MATCH_BLOCK))
    (
        events.repartition(*PARTITIONS, F.pmod(block, F.lit(files_per_partition)))
        .sortWithinPartitions(*PARTITIONS, "match_id", "idx")
        .write.partitionBy(*PARTITIONS)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(root)
    )


def replace_matches(events: DataFrame, root: str) -> None:
    """Rewriting a match replaces it and leaves its partition neighbours alone.

    Only touched partitions are rewritten.  The merged rows are staged first:
    a job must not overwrite files it is still reading.
    """
    spark = events.sparkSession
    touched = events.select(*PARTITIONS).distinct()
    fresh_ids = events.select("match_id").distinct()
    old = (
        read(spark, root, events.schema)
        .join(touched, PARTITIONS, "left_semi")
        .join(fresh_ids, "match_id", "left_anti")
    )
    stage = scratch(spark, "stage")
    old.select(*events.columns).unionByName(events).write.parquet(stage)
    write(spark.read.schema(events.schema).parquet(stage), root)


def cluster_by_player(events: DataFrame, out: str) -> None:
    """The player-sorted copy: a player's rows sit in few row groups.

    The range key goes on past the player, so one player with a large share of
    the rows is still split over several tasks.
    """
    key = [F.col("player_id").asc_nulls_last(), F.col("match_id"), F.col("idx")]
    events.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").parquet(out)
