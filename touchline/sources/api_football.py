"""Live feed that reports video decisions: events, and corrections from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import pitch as P

FEED = "api-football"
_P = "struct<id:bigint,name:string>"
EVENTS = f"match_id bigint, response array<struct<time:struct<elapsed:int,extra:int>,team:{_P},player:{_P},assist:{_P},type:string,detail:string,comments:string>>"
# Card details and short match states.
CARDS = {"Yellow Card": "Yellow Card", "Red Card": "Red Card", "Second Yellow card": "Second Yellow"}
LIVE, DONE = ("1H", "2H", "ET", "P", "LIVE", "BT"), ("FT", "AET", "PEN")


def status(short: Column) -> Column:
    return F.when(short.isin(*LIVE), "live").when(short == "HT", "half_time").when(short.isin(*DONE), "finished").otherwise("scheduled")


def _rows(raw: DataFrame) -> DataFrame:
    r = raw.select("match_id", F.posexplode("response").alias("i", "e"))
    elapsed, extra = F.coalesce("e.time.elapsed", F.lit(0)), F.coalesce("e.time.extra", F.lit(0))
    return r.withColumns({"elapsed": elapsed, "minute": elapsed + extra, "kind": F.coalesce("e.type", F.lit("")), "detail": F.coalesce("e.detail", F.lit(""))})


def events(raw: DataFrame) -> DataFrame:
    """Everything but the video decisions, as canonical events."""
    r = _rows(raw).filter("kind <> 'Var'")
    pid = F.col("e.player.id").cast("string")
    eid = F.concat_ws("-", F.lit("af"), F.col("match_id").cast("string"), F.col("i").cast("string"), "kind", F.col("elapsed").cast("string"), F.coalesce(pid, F.lit("")))
    goal, own = F.col("kind") == "Goal", F.col("detail") == "Own Goal"
    shot, sub = goal & ~own, F.col("kind") == "subst"
    card = F.lit(None).cast("string")
    for k, v in CARDS.items():
        card = F.when((F.col("kind") == "Card") & (F.col("detail") == k), v).otherwise(card)
    return r.select(
        "match_id", eid.alias("event_id"), F.col("i").alias("idx"), P.period_from_minute("elapsed").alias("period"), "minute", F.lit(0).alias("second"),
        F.when(goal & own, "Own Goal Against").when(goal, "Shot").when(F.col("kind") == "Card", "Bad Behaviour").when(sub, "Substitution")
        .when(F.col("kind") == "", "Unknown").otherwise(F.col("kind")).alias("type"),
        F.col("e.team.id").cast("string").alias("team_id"), F.col("e.team.name").alias("team"), pid.alias("player_id"), F.when(pid.isNotNull(), F.col("e.player.name")).alias("player"),
        F.when(shot, F.when(F.col("detail") == "Missed Penalty", "Missed").otherwise("Goal")).alias("shot_outcome"),
        F.when(shot, F.when(F.col("detail").contains("Penalty"), "Penalty").otherwise("Open Play")).alias("shot_type"), card.alias("card"),
        F.when(sub, F.col("e.assist.id").cast("string")).alias("sub_player_id"), F.when(sub & F.col("e.assist.id").isNotNull(), F.col("e.assist.name")).alias("sub_player"),
        F.lit(FEED).alias("source_feed"), eid.alias("source_event_id"))


def corrections(raw: DataFrame) -> DataFrame:
    """A cancelled goal takes the team's latest goal that came before it in the
    feed and is not later by the clock.

    Two orders have to agree (feed and clock), so each decision is laid out over
    the minutes it can reach back to; within one team and minute the last goal
    before it is a running last value, and the latest over the minutes wins.  No
    decision is paired with every goal.
    """
    ev = events(raw)
    g = ev.filter(F.col("shot_outcome") == "Goal").select("match_id", "team_id", F.col("minute").alias("m"), "idx", F.struct("idx", "event_id", "period", "minute").alias("goal"))
    low = F.lower("detail")
    v = _rows(raw).filter((F.col("kind") == "Var") & (low.contains("goal cancelled") | low.contains("goal disallowed"))).select(
        "match_id", F.col("e.team.id").cast("string").alias("team_id"), "i", "minute", F.coalesce("e.comments", "e.detail", F.lit("Goal cancelled by VAR")).alias("reason"))
    reach = v.withColumn("m", F.explode(F.sequence(F.lit(0), "minute"))).select("match_id", "team_id", "m", F.col("i").alias("idx"), F.struct("i", "minute", "reason").alias("var"))
    both = g.unionByName(reach, allowMissingColumns=True)
    w = Window.partitionBy("match_id", "team_id", "m").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = both.withColumn("goal", F.last("goal", True).over(w)).filter("var is not null AND goal is not null")
    hit = before.groupBy("match_id", "var").agg(F.max("goal").alias("goal"))
    return hit.select(
        F.concat_ws("-", F.lit("af-var"), F.col("match_id").cast("string"), F.col("var.i").cast("string")).alias("correction_id"), "match_id",
        F.col("goal.event_id").alias("supersedes"), F.lit("disallow").alias("kind"), F.col("var.reason").alias("reason"), F.lit("VAR").alias("authority"),
        F.col("goal.period").alias("period"), F.greatest("var.minute", "goal.minute").alias("decided_at_minute"), F.lit(False).alias("synthesised"))
