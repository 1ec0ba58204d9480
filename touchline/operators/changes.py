"""What changed between two projections of the same matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.functions import prose
from touchline.operators.model import CLASSES

#: Message types, most important first.
ORDER = {"correction_applied": 0, "event_appended": 1, "state_changed": 2, "wp_updated": 3, "report_regenerated": 4}


def _message(df: DataFrame, kind: str, ref: Column, text: Column) -> DataFrame:
    return df.select("match_id", F.lit(ORDER[kind]).alias("rank"), F.lit(kind).alias("type"), ref.cast("string").alias("ref"), text.cast("string").alias("text"))


def corrections_applied(before: DataFrame, after: DataFrame, goals: DataFrame, state: DataFrame) -> DataFrame:
    """New corrections, told in words with the score as it now stands."""
    new = after.join(before.select("match_id", "correction_id"), ["match_id", "correction_id"], "left_anti")
    g = goals.select("match_id", F.col("event_id").alias("supersedes"), "scorer", F.col("minute").alias("goal_minute"))
    s = state.select("match_id", P.score_text("home_score", "away_score").alias("score"))
    j = new.join(g, ["match_id", "supersedes"], "left").join(s, "match_id")
    head = prose.correction_headline(F.col("kind"), F.col("authority"), F.col("reason"))
    said = prose.correction_message(F.col("kind"), head, F.col("reason"), F.col("scorer"), F.col("goal_minute"), F.col("score"))
    return _message(j, "correction_applied", F.col("correction_id"), said)


def items_appended(before: DataFrame, after: DataFrame) -> DataFrame:
    """New timeline items; corrections are announced on their own."""
    key = ["match_id", "kind", "event_id"]
    new = after.filter("kind <> 'correction'").join(before.select(*key), key, "left_anti")
    return _message(new, "event_appended", F.col("event_id"), F.col("kind"))


def states_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Score, status or clock differ; a match not seen before counts as 0-0."""
    cols = ["home_score", "away_score", "status", "period", "minute", "second"]
    b = before.select("match_id", F.struct(*cols).alias("b"))
    j = after.select("match_id", F.struct(*cols).alias("a")).join(b, "match_id", "left")
    said = F.concat_ws(" ", P.score_text(F.col("a.home_score"), F.col("a.away_score")), F.col("a.status"), P.clock_text(F.col("a.period"), F.col("a.minute")))
    return _message(j.filter(~F.col("a").eqNullSafe(F.col("b"))), "state_changed", F.lit(None), said)


def _point(state: DataFrame, series: DataFrame, name: str) -> DataFrame:
    at = state.select("match_id", F.least("minute", F.lit(P.REGULATION)).alias("minute"))
    return at.join(series, ["match_id", "minute"]).select("match_id", F.struct("minute", *CLASSES).alias(name))


def probability_updated(before_state: DataFrame, before: DataFrame, after_state: DataFrame, after: DataFrame) -> DataFrame:
    j = _point(after_state, after, "a").join(_point(before_state, before, "b"), "match_id", "left")
    return _message(j.filter(~F.col("a").eqNullSafe(F.col("b"))), "wp_updated", F.col("a.minute"), F.concat_ws(" ", *[F.format_string("%.4f", F.col(f"a.{c}")) for c in CLASSES]))


def reports_regenerated(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines or lede differ."""
    b = before.select("match_id", F.struct("lines", "lede").alias("b"))
    j = after.select("match_id", F.struct("lines", "lede").alias("a")).join(b, "match_id", "left")
    return _message(j.filter(~F.col("a").eqNullSafe(F.col("b"))), "report_regenerated", F.lit(None), F.col("a.lede"))


def report_key(lines: Column, lede: Column) -> Column:
    """What a report says, in short: equal for equal lines and lede only."""
    return F.sha2(F.to_json(F.struct(lines.alias("lines"), lede.alias("lede"))), 256)


def reports_told_anew(keys: DataFrame, after: DataFrame) -> DataFrame:
    """The same against the `key` of the report last told; no key, or a null one, is a match without a report so far."""
    j = after.join(keys.select("match_id", F.col("key").alias("b")), "match_id", "left")
    return j.filter(~F.col("key").eqNullSafe(F.col("b"))).select(*after.columns)


def report_messages(told: DataFrame) -> DataFrame:
    return _message(told, "report_regenerated", F.lit(None), F.col("lede"))


def score_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Matches whose score differs, across all matches."""
    sc = ["home_score", "away_score"]
    b = before.select("match_id", F.struct(*sc).alias("b"))
    j = after.select("match_id", *sc, F.struct(*sc).alias("a")).join(b, "match_id", "left")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("match_id", *sc)
