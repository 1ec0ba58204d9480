"""Team metrics per match and side, from effective events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

#: A metric's plain-language gloss.
GLOSSARY = {
    "xg": "Expected goals: how many goals the chances created were worth to an average team. "
          "2.4 means the chances were worth about two or three goals.",
    "possession": "Share of on-ball actions. A rough measure of who had the ball, not who controlled the game.",
    "ppda": "Passes allowed per defensive action in the opponent's half. Lower means more aggressive pressing; "
            "under 9 is intense, over 15 is sitting off.",
    "field_tilt": "Share of all final-third passes that this team made. It shows who was playing in the "
                  "other side's half, which possession alone does not.",
    "pass_accuracy": "Completed passes as a share of all passes attempted.",
    "shots_on_target": "Shots that would have gone in without a save - goals plus saves.",
    "progressive_passes": "Passes that moved the ball at least 25% closer to goal, or into the box.",
    "big_chances": "Shots worth 0.3 xG or more - the kind a player is expected to score about one in three of.",
}
#: Types that count as pressing (with tackles, see below).
PRESSING = ("Interception", "Foul Committed", "Dribbled Past")

COUNTERS = ("touches", "shots", "shots_on_target", "big_chances", "goals", "passes", "passes_completed",
            "corners", "final_third_passes", "progressive_passes", "defensive_actions_high", "fouls",
            "yellow_cards", "red_cards", "xg_micro", "own_goals", "deep_passes")


def glossary(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(GLOSSARY.items()), "metric string, gloss string")


def team_counters(effective: DataFrame) -> DataFrame:
    """Counters per match and team, shootout excluded; partial aggregation."""
    n = N.count_if
    press = F.when(F.col("type") == "Duel", F.col("duel_type") == "Tackle").otherwise(F.col("type").isin(*PRESSING))
    done = P.complete()
    restart = F.coalesce(F.col("pass_type").isin(*P.RESTARTS), F.lit(False))
    red = F.col("card").isin(*P.RED_CARDS)
    return effective.filter((F.col("period") != 5) & F.col("team_id").isNotNull()).groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("touches"),
        n(P.is_shot()).alias("shots"),
        n(P.is_shot() & F.col("shot_outcome").isin(*P.ON_TARGET_EFFECTIVE)).alias("shots_on_target"),
        n(P.is_shot() & (F.col("shot_xg") >= P.BIG_CHANCE)).alias("big_chances"),
        n(P.is_goal()).alias("goals"),
        n(P.is_pass()).alias("passes"), n(done).alias("passes_completed"),
        n(P.is_pass() & (F.col("pass_type") == "Corner")).alias("corners"),
        n(done & (F.col("end_x") >= P.FINAL_THIRD_X) & F.col("end_y").isNotNull()).alias("final_third_passes"),
        n(done & P.progressive()).alias("progressive_passes"),
        n(press & (F.col("x") >= P.PRESS_ZONE_X)).alias("defensive_actions_high"),
        n(F.col("type") == "Foul Committed").alias("fouls"),
        n(F.col("card").isNotNull() & ~red).alias("yellow_cards"), n(red).alias("red_cards"),
        N.micro_sum(F.when(P.is_shot(), F.col("shot_xg"))).alias("xg_micro"),
        n(P.is_own_goal()).alias("own_goals"),
        n(P.is_pass() & (F.col("x") < P.DEEP_X) & ~restart).alias("deep_passes"),
    )


def team_metrics(effective: DataFrame, sides: DataFrame) -> DataFrame:
    """Both sides' metrics for every match.

    Own goals and deep passes are credited to the other side.  PPDA is null for
    a side that made no defensive action high up.
    """
    t = team_counters(effective).join(sides, "match_id")
    pick = {"home": F.col("team_id") == F.col("home_id"), "away": F.col("team_id") == F.col("away_id")}
    m = t.groupBy("match_id", "home_id", "away_id").agg(
        *[F.sum(F.when(cond, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s, cond in pick.items() for c in COUNTERS])

    touch = N.ratio("home_touches", F.col("home_touches") + F.col("away_touches"), 0.5)
    tilt = N.ratio("home_final_third_passes", F.col("home_final_third_passes") + F.col("away_final_third_passes"), 0.5)
    rows = []
    for s, o in (("home", "away"), ("away", "home")):
        share = (lambda r: r) if s == "home" else (lambda r: 1 - r)
        plain = [c for c in COUNTERS if c not in ("goals", "xg_micro", "own_goals", "deep_passes")]
        rows.append(F.struct(
            F.lit(s).alias("side"), F.col(f"{s}_id").alias("team_id"),
            (F.col(f"{s}_goals") + F.col(f"{o}_own_goals")).alias("goals"),
            *[F.col(f"{s}_{c}").alias(c) for c in plain],
            F.col(f"{o}_deep_passes").alias("opponent_passes_deep"),
            N.from_micro(f"{s}_xg_micro", 2).alias("xg"),
            N.half_up(N.ratio(f"{s}_passes_completed", f"{s}_passes", 0.0), 3).alias("pass_accuracy"),
            N.half_up(share(touch), 3).alias("possession"),
            N.half_up(share(tilt), 3).alias("field_tilt"),
            N.half_up(N.ratio(f"{o}_deep_passes", f"{s}_defensive_actions_high"), 2).alias("ppda")))
    return m.select("match_id", F.inline(F.array(*rows)))
