"""Possession chains: unbroken runs of events with one possession number.

A run ends where the number changes and at the end of a period.  Runs are found
without a task that sees a whole match: an event looks at the one before it within
its minute, the first of a minute at the last number of the minute before, which is
one row; running numbers come from `functions.scan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P
from touchline.functions.scan import running_sums


def numbered(events: DataFrame) -> DataFrame:
    """Events in play that belong to a possession, with `chain`, its number in the match from 1.

    Events without a possession number, and the shootout, are in no chain and break none.
    """
    minute, place = ["match_id", "period", "minute"], ["second", "idx", "event_id"]
    e = events.filter(F.col("possession").isNotNull() & (F.col("period") < 5))
    last = e.groupBy(*minute).agg(F.max_by("possession", F.struct(*place)).alias("last"))
    before = last.select(*minute, F.lag("last").over(Window.partitionBy("match_id", "period").orderBy("minute")).alias("__before"))
    lagged = e.withColumn("__lag", F.lag("possession").over(Window.partitionBy(*minute).orderBy(*place)))
    begins = ~F.col("possession").eqNullSafe(F.coalesce("__lag", "__before"))
    both = lagged.join(before, minute).withColumn("__begins", begins).drop("__lag", "__before")
    return running_sums(both, ["match_id"], ["period", "minute"], place, {"chain": F.col("__begins").cast("int")}).drop("__begins")


def chains(events: DataFrame) -> DataFrame:
    """One row per chain.

    The chain is its first event's team's; `ends_in_shot` if this team's last event in it
    is a shot, whatever the others do after it (a save, a block).  `events` counts both teams',
    `passes` (completed), `shots`, `goals`, `xg` its own.
    """
    clock = (F.col("minute") * 60 + F.col("second")).cast("long")
    order = F.call_function("shiftleft", clock, F.lit(32)) + F.col("idx").cast("long")
    shot = P.is_shot()
    key = ["match_id", "chain", "period", "possession"]
    sides = numbered(events).filter(F.col("team_id").isNotNull()).groupBy(*key, "team_id").agg(
        F.count(F.lit(1)).alias("n"), N.count_if(P.complete()).alias("passes"), N.count_if(shot).alias("shots"), N.count_if(P.is_goal()).alias("goals"),
        N.micro_sum(F.when(shot, F.col("shot_xg"))).alias("xg"), F.min(order).alias("first"), F.max(order).alias("last"), F.max(F.when(shot, order)).alias("last_shot"))
    own = F.min(F.struct("first", "team_id", "passes", "shots", "goals", "xg", F.coalesce(F.col("last") == F.col("last_shot"), F.lit(False)).alias("ends_in_shot")))
    c = sides.groupBy(*key).agg(F.sum("n").alias("events"), own.alias("own"), F.max("last").alias("last"))
    at = lambda col: F.shiftright(col, 32)
    return c.select(*key, "own.team_id", "events", "own.passes", "own.shots", "own.goals", N.from_micro(F.col("own.xg"), 4).alias("xg"),
                    at(F.col("own.first")).alias("start"), (at(F.col("last")) - at(F.col("own.first"))).alias("seconds"), "own.ends_in_shot")


def teams(rows: DataFrame) -> DataFrame:
    """Per team: chains, those ending in a shot and their share, passes per chain."""
    ending = N.count_if(F.col("ends_in_shot"))
    return rows.groupBy("team_id").agg(F.count(F.lit(1)).alias("chains"), ending.alias("ending_in_shot"), N.half_up(ending / F.count(F.lit(1)), 4).alias("share"),
                                       N.half_up(F.sum("passes") / F.count(F.lit(1)), 3).alias("passes_per_chain"))
