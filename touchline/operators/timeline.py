"""Notable events, the shot map, and the continuous match clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

#: Nominal clock at the start of each period, the pause kept
#: between periods, and where in its minute a decision lands (seconds).
PERIOD_START = {1: 0, 2: 2700, 3: 5400, 4: 6300, 5: 7200}
BREAK_S, DECISION_S = 60, 30


def _item(kind: str, detail: Column, xg: Column | None = None) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), (xg if xg is not None else none).alias("xg"))


def timeline(events: DataFrame) -> DataFrame:
    """Goals, missed penalties, big chances, own goals, cards, changes, shootout.

    A shot yields its first matching class; a card or a change may add a second
    row for the same event.
    """
    outcome, xg = F.col("shot_outcome"), F.col("shot_xg")
    goal = outcome == P.GOAL
    of_shot = (
        F.when(F.col("period") == 5, _item("shootout", F.when(goal, F.lit("scored")).otherwise(F.lower(outcome))))
        .when(goal, _item("goal", F.col("shot_type"), xg))
        .when(F.col("shot_type") == "Penalty", _item("penalty_miss", outcome, xg))
        .when(xg >= P.BIG_CHANCE, _item("big_chance", outcome, xg)))
    sub_name = F.col("sub_player") if "sub_player" in events.columns else F.lit("")
    items = F.array_compact(F.array(
        F.when(P.is_shot(), of_shot).when(P.is_own_goal(), _item("own_goal", F.lit(""))),
        F.when(F.col("card").isNotNull(), _item("card", F.col("card"))),
        F.when(F.col("type") == "Substitution", _item("sub", F.coalesce(sub_name, F.lit("")))),
    ))
    notable = P.is_shot() | P.is_own_goal() | F.col("card").isNotNull() | (F.col("type") == "Substitution")
    return events.filter(notable & F.col("team_id").isNotNull()).select(
        "match_id", "event_id", "period", "minute", "second", "idx", "team_id", "team", "player", F.inline(items))


def corrected_timeline(events: DataFrame, corrections: DataFrame, verdicts: DataFrame, sides: DataFrame) -> DataFrame:
    """The timeline with corrections in it; a disallowed goal stays, flagged."""
    v = verdicts.select("match_id", "event_id", "disallowed", "reason", "decided_at_minute")
    flagged = F.col("disallowed") & (F.col("kind") == "goal")
    t = timeline(events).join(v, ["match_id", "event_id"], "left").join(sides, "match_id", "left").select(
        "match_id", "kind", "period", "minute", "second", (F.col("team_id") == F.col("home_id")).alias("home"), "team", "player", "detail",
        F.col("event_id").cast("string").alias("event_id"), "xg", F.coalesce(flagged, F.lit(False)).alias("disallowed"),
        F.when(flagged, F.col("reason")).alias("correction_reason"), F.when(flagged, F.col("decided_at_minute")).alias("corrected_at"))
    c = corrections.select(
        "match_id", F.lit("correction").alias("kind"), "period", F.col("decided_at_minute").alias("minute"), F.lit(59).alias("second"),
        F.lit("").alias("team"), F.lit("").alias("player"), F.col("reason").alias("detail"), F.col("correction_id").alias("event_id"),
        F.lit(False).alias("disallowed"), F.col("kind").alias("correction_kind"), "authority",
        F.col("supersedes").cast("string").alias("supersedes"), "synthesised")
    return t.unionByName(c, allowMissingColumns=True)


def in_order(items: DataFrame) -> DataFrame:
    return items.orderBy("match_id", "period", "minute", "second", "event_id")


def shot_map(events: DataFrame, verdicts: DataFrame, sides: DataFrame) -> DataFrame:
    """Shots with coordinates, flags and the freeze-frame, from raw events."""
    shots = events.filter(P.is_shot() & F.col("x").isNotNull()).drop("home_id", "away_id")
    off = verdicts.filter("disallowed").select("match_id", "event_id", F.lit(True).alias("disallowed"))
    r = N.half_up
    extra = []
    if "freeze" in events.columns:
        extra.append(F.transform(F.coalesce("freeze", F.array()), lambda a: F.struct(
            r(a["x"], 1).alias("x"), r(a["y"], 1).alias("y"), a["teammate"].alias("teammate"), a["keeper"].alias("keeper"),
            a["name"].alias("name"))).alias("freeze"))
    return shots.join(off, ["match_id", "event_id"], "left").join(sides, "match_id", "left").select(
        "match_id", "event_id", "period", "minute", "second", F.coalesce(F.col("team_id") == F.col("home_id"), F.lit(False)).alias("home"),
        "team", "player_id", "player", r("x", 1).alias("x"), r("y", 1).alias("y"), r("end_x", 1).alias("end_x"), r("end_y", 1).alias("end_y"),
        r("shot_xg", 4).alias("xg"), F.col("shot_outcome").alias("outcome"), F.col("shot_type").alias("type"),
        F.col("shot_body_part").alias("body_part"), (F.col("shot_outcome") == P.GOAL).alias("goal"),
        F.coalesce("disallowed", F.lit(False)).alias("disallowed"), (F.col("period") == 5).alias("shootout"), *extra)


def _nominal(period: Column) -> Column:
    out = F.lit(0)
    for p, s in PERIOD_START.items():
        out = F.when(period == p, s).otherwise(out)
    return out


def period_starts(events: DataFrame) -> DataFrame:
    """Seconds from kick-off at which each period begins; a period begins where
    the one before ended, plus the pause."""
    last = events.groupBy("match_id", "period").agg(F.max(F.col("minute") * 60 + F.col("second")).alias("last"))
    length = F.greatest(F.col("last") - _nominal(F.col("period")), F.lit(0)) + BREAK_S
    before = Window.partitionBy("match_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("match_id")
    return last.withColumn("length", length).select(
        "match_id", "period", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("starts_at"),
        F.sum("length").over(whole).alias("match_length"))


def schedule(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events and corrections on one continuous clock.

    Order by (match_id, at, source, period, minute, second, idx, record_id); an
    event comes before a correction at the same second.
    """
    starts = period_starts(events)
    recs = events.select("match_id", F.lit(0).alias("source"), F.col("event_id").cast("string").alias("record_id"),
                         "period", "minute", "second", "idx").unionByName(
        corrections.select("match_id", F.lit(1).alias("source"), F.col("correction_id").alias("record_id"), "period",
                           F.col("decided_at_minute").alias("minute"), F.lit(DECISION_S).alias("second"), F.lit(0).alias("idx")))
    # a decision in a period without events is placed after everything else
    length = starts.groupBy("match_id").agg(F.max("match_length").alias("tail"))
    off = F.greatest(F.col("minute") * 60 + F.col("second") - _nominal(F.col("period")), F.lit(0))
    j = recs.join(starts.drop("match_length"), ["match_id", "period"], "left").join(length, "match_id", "left")
    return j.select("match_id", (F.coalesce("starts_at", "tail") + off).alias("at"),
                    F.when(F.col("source") == 0, "event").otherwise("correction").alias("kind"), "record_id", "period", "minute", "second", "idx")
