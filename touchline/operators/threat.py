"""Expected threat: what having the ball in a zone of the pitch is worth.

The pitch is a fixed grid.  From a zone a team shoots or moves the ball on; the
worth of a zone is the chance that this leads to a goal within some more moves,

    v(z) = (goals from z + sum over z' of moves from z to z' * v(z')) / actions in z

with v = 0 to begin with.  One aggregate over the archive gives the counts, at
most a row per pair of zones; the rounds work on these alone.  Values are whole
billionths, so that no order of summing can change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P
from touchline.session import cut

# The grid.
COLUMNS, ROWS = 16, 12
ROUNDS = 6
UNIT = 1_000_000_000


def zone(x: str, y: str) -> Column:
    """Number of the zone, along the pitch first; on the far lines the last one.  Null where a coordinate is."""
    col = F.least(F.floor(F.col(x) * COLUMNS / P.LENGTH), F.lit(COLUMNS - 1))
    row = F.least(F.floor(F.col(y) * ROWS / P.WIDTH), F.lit(ROWS - 1))
    known = F.col(x).isNotNull() & F.col(y).isNotNull()  # least and greatest would skip a null
    return F.when(known, (F.greatest(col, F.lit(0)) * ROWS + F.greatest(row, F.lit(0))).cast("int"))


def moved() -> Column:
    """Passes that arrived and carries."""
    return P.complete() | (F.col("type") == "Carry")


def actions(events: DataFrame) -> DataFrame:
    """Shots, passes and carries in play with `zone` and, for moves that arrived, `to`.

    A move without a known end is left out, as is what has no known start.
    """
    e = events.filter((F.col("period") < 5) & F.col("type").isin("Pass", "Carry", "Shot")).select("*", zone("x", "y").alias("zone"), F.when(moved(), zone("end_x", "end_y")).alias("to"))
    return e.filter(F.col("zone").isNotNull() & (F.col("to").isNotNull() | ~F.coalesce(moved(), F.lit(False))))


def counts(events: DataFrame) -> DataFrame:
    """`zone`, `to`, `moves`, `shots`, `goals`: at most a row per pair of zones and one per zone without an arrival."""
    shot = P.is_shot()
    return actions(events).groupBy("zone", "to").agg(N.count_if(~shot).alias("moves"), N.count_if(shot).alias("shots"), N.count_if(P.is_goal()).alias("goals"))


def grid(per: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The worth of every zone from its counts: `zone`, `actions`, `shots`, `goals`, `value` (billionths).

    A zone where nothing happened is worth 0.
    """
    per = cut(per, "threat-counts")
    base = per.groupBy("zone").agg(F.sum(F.col("moves") + F.col("shots")).alias("actions"), F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    base = cut(base, "threat-zones")
    steps = per.filter("to IS NOT NULL").select("zone", "to", F.col("moves").cast("decimal(19,0)").alias("moves"))
    value = base.select("zone", F.lit(0).cast("long").alias("value"))
    for _ in range(rounds):
        onward = steps.join(value.select(F.col("zone").alias("to"), F.col("value").cast("decimal(19,0)").alias("v")), "to").groupBy("zone").agg(F.sum(F.col("moves") * F.col("v")).alias("onward"))
        total = F.col("goals") * F.lit(UNIT).cast("decimal(19,0)") + F.coalesce("onward", F.lit(0))
        value = base.join(onward, "zone", "left").select("zone", total.alias("t"), "actions").selectExpr("zone", "t div actions AS value")
    every = base.sparkSession.range(COLUMNS * ROWS).select(F.col("id").cast("int").alias("zone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(base, "zone", "left").join(value, "zone", "left").select("zone", zero("actions"), zero("shots"), zero("goals"), zero("value"))


def players(events: DataFrame, worth: DataFrame) -> DataFrame:
    """What each player's arrived passes and carries added: `player_id`, `moves`, `xt` (net), `xt_gained` (gains only).

    Moves are counted per player and pair of zones before the grid is joined.
    """
    own = actions(events).filter(F.col("to").isNotNull() & F.col("player_id").isNotNull()).groupBy("player_id", "zone", "to").agg(F.count(F.lit(1)).alias("n"))
    at = lambda name, as_: worth.select(F.col("zone").alias(name), F.col("value").alias(as_))
    own = own.join(at("zone", "before"), "zone").join(at("to", "after"), "to")
    gain = F.col("n").cast("decimal(19,0)") * (F.col("after") - F.col("before")).cast("decimal(19,0)")
    unit = lambda c: N.half_up(F.sum(c).cast("double") / float(UNIT), 6)
    return own.groupBy("player_id").agg(F.sum("n").alias("moves"), unit(gain).alias("xt"), unit(F.greatest(gain, F.lit(0).cast("decimal(38,0)"))).alias("xt_gained"))
