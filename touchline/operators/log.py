"""The append-only log: events and the corrections that supersede them.

Nothing is updated in place.  A correction's verdict is computed per corrected
event and joined onto the events that need it; the result depends only on which
records exist, not on their order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P


def _first_copy(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the least by `order`, then by content.

    The rank filter runs before the shuffle as well, so a record delivered a
    million times leaves each task once.
    """
    content = F.xxhash64(*[c for c in df.columns if not str(df.schema[c].dataType).startswith("Map")])
    w = Window.partitionBy(*key).orderBy(*order, content)
    return df.withColumn("__copy", F.row_number().over(w)).filter("__copy = 1").drop("__copy")


def distinct_events(events: DataFrame) -> DataFrame:
    return _first_copy(events, ["match_id", "event_id"], ["period", "minute", "second", "idx"])


def distinct_corrections(corrections: DataFrame) -> DataFrame:
    return _first_copy(corrections, ["match_id", "correction_id"], ["period", "decided_at_minute"])


def log_records(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Both record kinds in one frame, tagged."""
    return events.withColumn("kind_of_record", F.lit("event")).unionByName(
        corrections.withColumn("kind_of_record", F.lit("correction")), allowMissingColumns=True
    )


def decision_key() -> Column:
    return F.struct(*P.CORRECTION_ORDER)


def resolve(corrections: DataFrame) -> DataFrame:
    """One verdict per corrected event, from deduplicated corrections.

    The last disallow or reinstate decides whether it counts; amendments merge
    field by field, the latest winning; the reason shown is that of the last
    correction of any kind.  All of it is partial aggregation.
    """
    key = decision_key()
    ruling = F.col("kind").isin("disallow", "reinstate")
    amending = F.col("kind").isin("reassign", "amend")

    def latest(cols: Sequence[str], present: str) -> Column:
        return F.max_by(F.struct(*cols), F.when(amending & F.col(present).isNotNull(), key))

    agg = corrections.groupBy("match_id", F.col("supersedes").alias("event_id")).agg(
        F.coalesce(F.max_by(F.col("kind") == "disallow", F.when(ruling, key)), F.lit(False)).alias("disallowed"),
        F.max_by(F.struct("kind", "reason", "authority", "decided_at_minute"), key).alias("last"),
        F.bool_or("synthesised").alias("synthesised"),
        latest(["new_player_id", "new_player"], "new_player_id").alias("p"),
        latest(["new_team_id", "new_team"], "new_team_id").alias("t"),
        latest(["new_minute"], "new_minute").alias("m"),
        latest(["new_xg"], "new_xg").alias("x"),
        F.count(F.lit(1)).alias("n_corrections"),
    )
    return agg.select(
        "match_id", "event_id", "disallowed", "synthesised", "n_corrections",
        F.col("last.kind").alias("last_kind"), F.col("last.reason").alias("reason"),
        F.col("last.authority").alias("authority"), F.col("last.decided_at_minute").alias("decided_at_minute"),
        "p.new_player_id", "p.new_player", "t.new_team_id", "t.new_team", "m.new_minute", "x.new_xg",
    )


def history(corrections: DataFrame) -> DataFrame:
    """Every correction beside the event it touches, in decision order."""
    return corrections.select(
        "match_id", F.col("supersedes").alias("event_id"), *P.CORRECTION_ORDER,
        "kind", "reason", "authority", "synthesised",
    ).orderBy("match_id", "event_id", *P.CORRECTION_ORDER)


def corrected_events(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Events with amendments applied and the verdict's flags beside them.

    `order_minute` keeps the minute the event was recorded at: an amended minute
    changes what is shown, not the event's place in the match.
    """
    v = verdicts.withColumnsRenamed({"reason": "correction_reason", "authority": "correction_authority",
                                     "decided_at_minute": "corrected_at", "synthesised": "correction_synthesised",
                                     "last_kind": "correction_kind"})
    j = events.withColumn("order_minute", F.col("minute")).join(v, ["match_id", "event_id"], "left")
    swaps = {"player_id": "new_player_id", "player": "new_player", "team_id": "new_team_id",
             "team": "new_team", "minute": "new_minute"}
    # a new player or team replaces id and name together
    present = {"player": "new_player_id", "team": "new_team_id"}
    new = {c: F.when(F.col(present.get(c, n)).isNotNull(), F.col(n)).otherwise(F.col(c))
           for c, n in swaps.items() if c in events.columns}
    new["shot_xg"] = F.when(P.is_shot() & F.col("new_xg").isNotNull(), F.col("new_xg")).otherwise(F.col("shot_xg"))
    new["disallowed"] = F.coalesce("disallowed", F.lit(False))
    new["correction_synthesised"] = F.coalesce("correction_synthesised", F.lit(False))
    return j.withColumns(new).drop(*swaps.values(), "new_xg", "n_corrections")


def effective_events(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The events as they should now be read: amended, and a disallowed goal
    keeps its shot but not its goal."""
    gone = F.col("disallowed") & P.is_goal()
    return corrected_events(events, verdicts).withColumn(
        "shot_outcome", F.when(gone, F.lit(P.GOAL_DISALLOWED)).otherwise(F.col("shot_outcome"))
    )


def as_of(events: DataFrame, corrections: DataFrame, period: int, minute: int) -> tuple[DataFrame, DataFrame]:
    """The log as it stood at a moment; corrections count from their decision."""

    def upto(m: str) -> Column:
        return (F.col("period") < period) | ((F.col("period") == period) & (F.col(m) <= minute))

    return events.filter(upto("minute")), corrections.filter(upto("decided_at_minute"))


def log_size(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Version of each match: distinct events plus every correction delivered,
    repeats included, with the number of verdicts that remove a goal or card."""
    e = events.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_events"))
    k = corrections.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_corrections"))
    gone = resolve(distinct_corrections(corrections)).groupBy("match_id").agg(
        F.count(F.when(F.col("disallowed"), 1)).alias("n_superseded"))
    z = F.lit(0).cast("long")
    out = e.join(k, "match_id", "full").join(gone, "match_id", "left")
    return out.select(
        "match_id",
        (F.coalesce("n_events", z) + F.coalesce("n_corrections", z)).alias("version"),
        F.coalesce("n_corrections", z).alias("n_corrections"),
        F.coalesce("n_superseded", z).alias("n_superseded"),
    )


def superseded(verdicts: DataFrame) -> DataFrame:
    """Ids of the events that no longer count."""
    return verdicts.filter("disallowed").select("match_id", "event_id")
