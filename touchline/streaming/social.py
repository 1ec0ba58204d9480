"""Windows over the stream of posts: volume, trends, repeats, author cap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions import text as T
from touchline.operators.social import AUTHOR_CAP, AUTHOR_WINDOW_H

RETENTION = "72 hours"


def timed(posts: DataFrame) -> DataFrame:
    """Event time as a timestamp (a watermark needs one) with the retention."""
    return posts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", RETENTION)


def hourly_volume(posts: DataFrame) -> DataFrame:
    """Posts per network and hour."""
    return timed(posts).groupBy(F.window("ts", "1 hour").alias("w"), "network").agg(F.count(F.lit(1)).alias("posts"))


def sliding_trends(posts: DataFrame) -> DataFrame:
    """Hashtag counts over six hours, moving by the hour."""
    tags = timed(posts).select("ts", F.explode(T.hashtags(F.col("text"))).alias("tag"))
    return tags.groupBy(F.window("ts", "6 hours", "1 hour").alias("w"), "tag").agg(F.count(F.lit(1)).alias("posts"))


def first_of_fingerprint(posts: DataFrame) -> DataFrame:
    """A fingerprint is let through once within the retention."""
    return timed(posts.withColumn("fp", T.fingerprint(F.col("network"), F.col("handle"), F.col("text")))).dropDuplicatesWithinWatermark(["fp"])


_OUT = "post_id long, network string, author_id int, n_in_window int"
_STATE = "opened long, counted int"


def _count(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One author: a window opens at the first post after the last ran out."""
    opened, counted = state.get if state.exists else (None, 0)
    span = AUTHOR_WINDOW_H * 3600 * 1_000_000
    posts = pd.concat(list(frames)).sort_values(["us", "post_id"])
    kept = []
    for pid, us in zip(posts["post_id"], posts["us"]):
        if opened is None or us >= opened + span:
            opened, counted = int(us), 0
        counted += 1
        if counted <= AUTHOR_CAP:
            kept.append((pid, key[0], key[1], counted))
    state.update((opened, counted))
    yield pd.DataFrame(kept, columns=["post_id", "network", "author_id", "n_in_window"])


def cap_authors(posts: DataFrame) -> DataFrame:
    """At most eight posts of an author per anchored window.  The state is two
    numbers an author; what is gathered is one author's share of a micro-batch,
    whose size the source limits."""
    p = posts.select("post_id", "network", "author_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return p.groupBy("network", "author_id").applyInPandasWithState(_count, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


class LatestByBatch:
    """Update-mode results kept by batch; the newest row of a key is its value."""

    def __init__(self, root: str, keys: list[str]) -> None:
        self.root, self.keys = root, keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(self.root)

    def read(self, spark) -> DataFrame:
        t = spark.read.parquet(self.root)
        vals = [c for c in t.columns if c not in (*self.keys, "batch_id")]
        return t.groupBy(*self.keys).agg(F.max_by(F.struct(*vals), "batch_id").alias("v")).select(*self.keys, "v.*")
