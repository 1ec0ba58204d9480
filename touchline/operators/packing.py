"""Packing: how many opponents a pass takes out of the game.

An opponent is taken out if he stood between ball and goal when the pass was
played and no longer does when it arrives.  Who stood where is known only where a
frame of visible players belongs to the event; elsewhere the answer is unknown, not 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

#: How near the line of the pass an opponent must stand for it to go through him.
LANE = 3.0


def opponents(freeze: str = "freeze") -> Column:
    """The opposing outfield players of a frame with known places."""
    return F.filter(F.col(freeze), lambda a: ~a["teammate"] & ~a["keeper"] & a["x"].isNotNull() & a["y"].isNotNull())


def beside(a: Column) -> Column:
    """Squared distance from a player to the line of the pass, between its ends."""
    dx, dy = F.col("end_x") - F.col("x"), F.col("end_y") - F.col("y")
    along = ((a["x"] - F.col("x")) * dx + (a["y"] - F.col("y")) * dy) / (dx * dx + dy * dy)
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ox, oy = a["x"] - F.col("x") - t * dx, a["y"] - F.col("y") - t * dy
    return ox * ox + oy * oy


def packing(events: DataFrame) -> DataFrame:
    """Every pass with `packed` and `through` (those of them the ball passed within LANE).

    Null without a frame or with an unknown end; 0 for a pass that did not arrive, which
    takes nobody out.  `events` has `freeze`, an array of players (x, y, teammate, keeper).
    """
    known = F.col("freeze").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("end_x").isNotNull() & F.col("end_y").isNotNull()
    out = F.filter(opponents(), lambda a: (a["x"] > F.col("x")) & (a["x"] <= F.col("end_x")))
    done = events.filter(P.is_pass()).withColumn("__out", F.when(known, F.when(P.complete(), out).otherwise(F.filter("freeze", lambda _: F.lit(False)))))
    size = lambda c: F.when(F.col("__out").isNotNull(), F.size(c)).cast("long")
    return done.select("match_id", "event_id", "team_id", "player_id", size(F.col("__out")).alias("packed"), size(F.filter("__out", lambda a: beside(a) <= LANE * LANE)).alias("through"))


def with_frames(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Events with `freeze` from a table with a row per visible player (`match_id`, `event_id`, `x`, `y`, `teammate`, `keeper`).

    A frame is the few players in view of one event.
    """
    one = frames.groupBy("match_id", "event_id").agg(F.collect_list(F.struct("x", "y", F.coalesce("teammate", F.lit(False)).alias("teammate"), F.coalesce("keeper", F.lit(False)).alias("keeper"))).alias("freeze"))
    return events.drop("freeze").join(one, ["match_id", "event_id"], "left")


def players(passes: DataFrame) -> DataFrame:
    """Per player: passes seen in a frame, opponents taken out in all and per such pass; players never seen are left out."""
    seen = passes.filter(F.col("packed").isNotNull() & F.col("player_id").isNotNull())
    return seen.groupBy("player_id").agg(F.count(F.lit(1)).alias("passes_seen"), F.sum("packed").alias("packed"), F.sum("through").alias("through"), N.half_up(F.sum("packed") / F.count(F.lit(1)), 3).alias("per_pass"))
