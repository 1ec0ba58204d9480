"""Per-minute match state, model features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

#: Column order of the model matrix; neutral-venue competitions.
FEATURES = ("minute", "minutes_remaining", "score_diff", "red_card_diff", "xg_diff", "shots_diff",
            "shots_on_target_diff", "possession_diff", "elo_diff", "is_neutral_venue")
NEUTRAL_COMPETITIONS = (43, 55, 72, 223, 1267, 53, 1470)
SERIES = ("goals", "xg_micro", "shots", "on_target", "reds", "touches")


def minute_increments(effective: DataFrame, sides: DataFrame) -> DataFrame:
    """What each minute of regulation adds, per side; everything after 90' is in
    minute 90.  Reduced per team before the sides are joined.  A team that is
    not the home side counts as away."""
    n = N.count_if
    per_team = (
        effective.filter((F.col("period") <= 2) & F.col("team_id").isNotNull())
        .groupBy("match_id", F.least("minute", F.lit(P.REGULATION)).alias("minute"), "team_id")
        .agg(F.count(F.lit(1)).alias("touches"), n(P.is_shot()).alias("shots"),
             N.micro_sum(F.when(P.is_shot(), F.col("shot_xg"))).alias("xg_micro"),
             n(P.is_shot() & F.col("shot_outcome").isin(*P.ON_TARGET_EFFECTIVE)).alias("on_target"),
             n(P.is_goal()).alias("scored"), n(P.is_own_goal()).alias("own"),
             n(F.col("card").isin(*P.RED_CARDS)).alias("reds")))
    t = per_team.join(sides, "match_id")
    home = F.col("team_id") == F.col("home_id")

    def side(c: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.col(c)).otherwise(0))

    plain = [c for c in SERIES if c != "goals"]
    return t.groupBy("match_id", "minute").agg(
        (side("scored", home) + side("own", ~home)).alias("home_goals"), (side("scored", ~home) + side("own", home)).alias("away_goals"),
        *[side(c, cond).alias(f"{s}_{c}") for c in plain for s, cond in (("home", home), ("away", ~home))])


def minute_state(increments: DataFrame, sides: DataFrame) -> DataFrame:
    """Cumulative state at the start of every minute 0..90, and the touches of
    the ten minutes before it.  The windows run over 91 rows per match."""
    spine = sides.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(P.REGULATION))).alias("minute"))
    cols = [f"{s}_{c}" for c in SERIES for s in ("home", "away")]
    d = spine.join(increments, ["match_id", "minute"], "left").fillna(0, cols)
    by = Window.partitionBy("match_id").orderBy("minute")
    before, ten = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(-10, -1)
    zero = F.lit(0).cast("long")
    return d.select("match_id", "minute", *[F.coalesce(F.sum(c).over(before), zero).alias(c) for c in cols],
                    *[F.coalesce(F.sum(f"{s}_touches").over(ten), zero).alias(f"{s}_recent") for s in ("home", "away")])


def feature_rows(state: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row per match and minute with the ten model columns in order.

    `extra`: match_id, elo_diff, is_neutral_venue (defaults 0 and neutral).
    """
    diff = lambda c: (F.col(f"home_{c}") - F.col(f"away_{c}")).cast("double")
    recent = F.col("home_recent") + F.col("away_recent")
    out = state.select(
        "match_id", "minute",
        F.greatest(F.lit(P.REGULATION) - F.col("minute"), F.lit(0)).cast("double").alias("minutes_remaining"),
        diff("goals").alias("score_diff"), diff("reds").alias("red_card_diff"),
        (diff("xg_micro") / float(N.MICRO)).alias("xg_diff"), diff("shots").alias("shots_diff"),
        diff("on_target").alias("shots_on_target_diff"),
        N.ratio(F.col("home_recent") - F.col("away_recent"), recent, 0.0).alias("possession_diff"))
    if extra is None:
        return out.withColumns({"elo_diff": F.lit(0.0), "is_neutral_venue": F.lit(1.0)})
    e = extra.select("match_id", F.col("elo_diff").cast("double").alias("elo_diff"), F.col("is_neutral_venue").cast("double").alias("is_neutral_venue"))
    return out.join(e, "match_id", "left").fillna({"elo_diff": 0.0, "is_neutral_venue": 1.0})


def labels(increments: DataFrame, sides: DataFrame) -> DataFrame:
    """Result of all regulation goals, the last minute's included: 0 home win,
    1 draw, 2 away win."""
    t = increments.groupBy("match_id").agg(F.sum("home_goals").alias("h"), F.sum("away_goals").alias("a"))
    d = F.coalesce(F.col("h") - F.col("a"), F.lit(0))
    return sides.select("match_id").join(t, "match_id", "left").select("match_id", F.when(d > 0, 0).when(d == 0, 1).otherwise(2).alias("label"))


def neutral(competition: Column) -> Column:
    return competition.isin(*NEUTRAL_COMPETITIONS).cast("double")


def date_split(rows: DataFrame, date: str = "match_date", holdout: float = 0.2) -> DataFrame:
    """Mark rows `is_train`: everything before the date on which the row at the
    (1 - holdout) mark falls, so no date is on both sides.

    Only per-date counts are ordered; the flag comes back by an equi-join.
    """
    per = rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"))
    all_dates = Window.partitionBy(F.lit(1))  # one row per date
    upto = all_dates.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    per = per.select(date, F.sum("n").over(upto).alias("upto"), F.floor(F.sum("n").over(all_dates) * (1 - holdout)).alias("mark"))
    per = per.select(date, F.min(F.when(F.col("upto") > F.col("mark"), F.col(date))).over(all_dates).alias("cutoff"))
    return rows.join(per.select(date, "cutoff", (F.col(date) < F.col("cutoff")).alias("is_train")), date)
