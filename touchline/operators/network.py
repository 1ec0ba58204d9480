"""Pass networks: mean positions and pass volume up to the first substitution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

MIN_TOUCHES = 5
MIN_EDGE = 3
SIDE = ["match_id", "team_id"]


def first_substitution(events: DataFrame) -> DataFrame:
    """Minute of each team's first change."""
    return (events.filter((F.col("type") == "Substitution") & F.col("team_id").isNotNull())
            .groupBy(*SIDE).agg(F.min("minute").alias("first_sub")))


def counted_passes(events: DataFrame) -> DataFrame:
    """Completed passes by pair and minute, cut at the first substitution.

    Rows are summed per minute before the cut-off is joined, so what meets the
    join is bounded by minutes x pairs however many events a match has.
    """
    good = events.filter(
        P.complete() & (F.col("period") <= 2) & F.col("team_id").isNotNull() & F.col("player_id").isNotNull()
        & F.col("x").isNotNull() & F.col("pass_recipient_id").isNotNull())
    lands = F.col("end_x").isNotNull() & F.col("end_y").isNotNull()

    def total(c, cond=None):
        v = N.micro(c)
        return F.sum(v if cond is None else F.when(cond, v))

    names = [F.max(c).alias(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("player", "pass_recipient")]
    per_minute = good.groupBy(*SIDE, "minute", "player_id", "pass_recipient_id").agg(
        F.count(F.lit(1)).alias("n"), total("x").alias("sx"), total("y").alias("sy"),
        N.count_if(lands).alias("n_end"), total("end_x", lands).alias("sex"), total("end_y", lands).alias("sey"), *names)
    cut = first_substitution(events)
    return per_minute.join(cut, SIDE, "left").filter(
        F.col("first_sub").isNull() | (F.col("minute") < F.col("first_sub"))).drop("first_sub")


def nodes(passes: DataFrame) -> DataFrame:
    """Players with enough touches, at the mean of where they passed and received."""
    ends = F.array(
        F.struct(F.col("player_id").alias("player_id"), F.col("player").alias("as_passer"), F.lit(None).cast("string").alias("as_receiver"),
                 F.col("n").alias("k"), F.col("sx").alias("px"), F.col("sy").alias("py")),
        F.struct(F.col("pass_recipient_id").alias("player_id"), F.lit(None).cast("string").alias("as_passer"), F.col("pass_recipient").alias("as_receiver"),
                 F.col("n_end").alias("k"), F.col("sex").alias("px"), F.col("sey").alias("py")))
    touched = passes.select(*SIDE, F.inline(ends)).filter("k > 0")
    mean = lambda c: N.half_up(F.sum(c) / F.sum("k") / F.lit(float(N.MICRO)), 1)
    return touched.groupBy(*SIDE, "player_id").agg(
        F.coalesce(F.max("as_passer"), F.max("as_receiver")).alias("name"),
        mean("px").alias("x"), mean("py").alias("y"), F.sum("k").alias("touches")).filter(F.col("touches") >= MIN_TOUCHES)


def edges(passes: DataFrame, node_rows: DataFrame, min_edge: int = MIN_EDGE) -> DataFrame:
    """Unordered pairs with enough passes whose two ends are both drawn."""
    pair = [F.least("player_id", "pass_recipient_id").alias("a"), F.greatest("player_id", "pass_recipient_id").alias("b")]
    heavy = passes.groupBy(*SIDE, *pair).agg(F.sum("n").alias("passes")).filter(F.col("passes") >= min_edge)
    drawn = node_rows.select(*SIDE, "player_id")
    for end in ("a", "b"):
        heavy = heavy.join(drawn.withColumnRenamed("player_id", end), [*SIDE, end], "left_semi")
    return heavy


def coverage(events: DataFrame, sides: DataFrame) -> DataFrame:
    """Until which minute each side's network counts, with its note."""
    each = sides.select("match_id", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    until = F.coalesce("first_sub", F.lit(90))
    return each.join(first_substitution(events), SIDE, "left").select(
        *SIDE, until.alias("until_minute"),
        F.concat(F.lit("Completed passes between players who started, up to the first substitution ("),
                 until.cast("string"), F.lit("').")).alias("note"))
