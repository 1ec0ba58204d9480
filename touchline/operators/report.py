"""Match reports: lines, lede, headline, closing, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.functions import prose
from touchline.functions.scan import running_sums
from touchline.operators import moments as MO


def running_score(goals: DataFrame) -> DataFrame:
    """Goals that count, regulation and extra time, with the score after each."""
    g = goals.filter(~F.col("disallowed") & (F.col("period") <= 4))
    return running_sums(g, ["match_id"], ["period", "minute"], ["second", "idx", "event_id"],
                        {"home_now": F.when(F.col("home"), 1), "away_now": F.when(~F.col("home"), 1)})


def comeback(goals: DataFrame, winners: DataFrame) -> DataFrame:
    """How long the winner trailed, and when they last went one ahead.

    Each goal moves the lead by one, so the lead before it is known without
    looking back; spells behind are the sum of their ends minus their starts.
    """
    w = winners.select("match_id", (F.col("home_score") > F.col("away_score")).alias("home_won"))
    g = running_score(goals).join(w, "match_id")
    own = F.col("home") == F.col("home_won")
    lead = F.when(F.col("home_won"), F.col("home_now") - F.col("away_now")).otherwise(F.col("away_now") - F.col("home_now"))
    was = lead - F.when(own, 1).otherwise(-1)
    at = F.struct("period", "minute", "second", "idx", "event_id")
    starts, ends = (lead < 0) & (was >= 0), (lead >= 0) & (was < 0)
    m = F.col("minute")
    t = g.groupBy("match_id").agg(
        F.coalesce(F.sum(F.when(ends, m)), F.lit(0)).alias("e"), F.coalesce(F.sum(F.when(starts, m)), F.lit(0)).alias("s"),
        (F.count(F.when(starts, 1)) - F.count(F.when(ends, 1))).alias("open"), F.max_by("minute", F.when(starts, at)).alias("last_start"),
        F.coalesce(F.max_by("minute", F.when((lead == 1) & own, at)), F.lit(0)).alias("decisive"))
    still_behind = F.when(F.col("open") > 0, F.col("last_start")).otherwise(0)
    return t.select("match_id", (F.col("e") - F.col("s") + still_behind).alias("trailed"), "decisive")


def ledes(goals: DataFrame, winners: DataFrame) -> DataFrame:
    j = winners.join(comeback(goals, winners), "match_id", "left").fillna(0, ["trailed", "decisive"])
    return j.select("match_id", "trailed", "decisive", prose.lede().alias("lede"))


def lines(moments: DataFrame) -> DataFrame:
    """One sentence per moment, numbered by the order in the match."""
    said = prose.moment_sentence(MO._for_winner("before"), MO._for_winner("after"))
    return moments.select("match_id", "period", "minute", "second", "idx", "event_id", "kind", said.alias("line"))


def gathered(moments: DataFrame) -> DataFrame:
    """The sentences of each match in order, as an array; bounded where the moments are."""
    return lines(moments).groupBy("match_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("period", "minute", "second", "idx", "event_id", "line"))), lambda s: s["line"]).alias("lines"))


def spoken(winners: DataFrame, goals: DataFrame, moments: DataFrame) -> DataFrame:
    """`lines` and `lede` of each match as it stands, finished or not: what makes a report another one."""
    j = live_ledes(winners, ledes(goals, winners)).select("match_id", "lede").join(gathered(moments), "match_id", "left")
    return j.select("match_id", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), "lede")


def closing(moments: DataFrame) -> DataFrame:
    b = MO.biggest_swing(moments)
    return b.select("match_id", prose.closing_line(F.col("minute"), F.col("before_p_home"), F.col("after_p_home")).alias("closing"),
                    F.col("swing").alias("biggest_swing"))


def notes(moments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Which of the three notes each match needs, as text."""
    late = moments.groupBy("match_id").agg(F.bool_or(F.col("period") >= 3).alias("late"))
    fixed = corrections.groupBy("match_id").agg(F.bool_or("synthesised").alias("made_up"), F.lit(True).alias("fixed"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return late.join(fixed, "match_id", "full").select("match_id", F.array_compact(F.array(
        F.when(yes("late"), prose.NOTE_EXTRA_TIME), F.when(yes("fixed"), prose.NOTE_CORRECTED), F.when(yes("made_up"), prose.NOTE_SYNTHESISED))).alias("notes"))


def reports(winners: DataFrame, goals: DataFrame, moments: DataFrame, corrections: DataFrame, matches: DataFrame) -> DataFrame:
    """The whole report of every match, one row each.

    After suppression the moments of a period are more than 90 seconds apart, so
    the lines gathered per match are bounded by its length.
    """
    text = gathered(moments)
    meta = matches.select("match_id", "competition", "match_date")
    head = winners.join(meta, "match_id").select("match_id", prose.headline().alias("headline"))
    out = head
    for part in (ledes(goals, winners), text, closing(moments), notes(moments, corrections)):
        out = out.join(part, "match_id", "left")
    out = out.withColumns({"lines": F.coalesce("lines", F.array().cast("array<string>")), "notes": F.coalesce("notes", F.array().cast("array<string>")),
                           "closing": F.coalesce("closing", F.lit(""))})
    body = F.array(F.col("headline"), F.lit(""), F.col("lede"), F.lit(""))
    body = F.concat(body, F.col("lines"), F.when(F.col("closing") != "", F.array(F.lit(""), F.col("closing"))).otherwise(F.array().cast("array<string>")),
                    F.when(F.size("notes") > 0, F.concat(F.array(F.lit("")), F.transform("notes", lambda n: F.concat(F.lit("("), n, F.lit(")"))))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("text", F.array_join(body, "\n")).drop("trailed", "decisive")


def live_ledes(winners: DataFrame, finished: DataFrame) -> DataFrame:
    """The finished report's lede, or a present-tense one."""
    return winners.join(finished.select("match_id", "lede"), "match_id", "left").select(
        "match_id", "status", F.when(F.col("status") == "finished", F.col("lede")).otherwise(prose.live_lede()).alias("lede"))
