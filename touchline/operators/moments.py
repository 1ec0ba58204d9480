"""Moments that decided a match, ranked by how far they moved the probability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from touchline.functions import numeric as N
from touchline.functions import pitch as P
from touchline.functions.scan import running_sums
from touchline.operators.model import CLASSES

# Report length and the window within which two moments are one.
MAX_MOMENTS, WINDOW_S = 8, 90


def winner(state: DataFrame, matches: DataFrame) -> DataFrame:
    """Winner class (0 home, 1 draw, 2 away) and the name used in prose; a
    shootout decides before the score."""
    h, a, sh, sa = (F.col(c) for c in ("home_score", "away_score", "home_shootout", "away_shootout"))
    cls = (F.when(F.col("shootout") & (sh > sa), 0).when(F.col("shootout") & (sa > sh), 2)
           .when(h > a, 0).when(a > h, 2).otherwise(1))
    names = matches.select("match_id", "home", "away")
    return state.join(names, "match_id").withColumn("winner", cls).withColumn(
        "winner_name", F.when(F.col("winner") == 2, F.col("away")).otherwise(F.col("home")))


def brackets(series: DataFrame) -> DataFrame:
    """Probabilities at the start of each minute and of the next, per match.

    The series holds 91 minutes; an event after its end is bracketed by its last
    point twice.
    """
    at = Window.partitionBy("match_id").orderBy("minute")
    return series.select("match_id", F.col("minute").alias("at"), *[F.col(c).alias(f"before_{c}") for c in CLASSES],
                         *[F.coalesce(F.lead(c).over(at), F.col(c)).alias(f"after_{c}") for c in CLASSES])


def with_probabilities(events: DataFrame, series: DataFrame) -> DataFrame:
    """Attach what each event's minute did; a third each where there is no series."""
    at = F.least(F.greatest("minute", F.lit(0)), F.lit(P.REGULATION))
    j = events.withColumn("at", at).join(brackets(series), ["match_id", "at"], "left").drop("at")
    return j.fillna(1.0 / 3, [f"{w}_{c}" for w in ("before", "after") for c in CLASSES])


def _for_winner(prefix: str) -> Column:
    return F.element_at(F.array(*[F.col(f"{prefix}_{c}") for c in CLASSES]), F.col("winner") + 1)


def last_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction of each event, whatever its kind."""
    key = F.struct(*P.CORRECTION_ORDER)
    return corrections.groupBy("match_id", F.col("supersedes").alias("event_id")).agg(
        F.max_by(F.struct("kind", "reason", "decided_at_minute", "synthesised"), key).alias("k")).select(
        "match_id", "event_id", F.col("k.kind").alias("k_kind"), F.col("k.reason").alias("k_reason"),
        F.col("k.decided_at_minute").alias("k_minute"), F.col("k.synthesised").alias("k_synthesised"))


def candidates(events: DataFrame, corrections: DataFrame, series: DataFrame, winners: DataFrame) -> DataFrame:
    """Goals, reds, missed penalties (always kept) and big chances, each with
    its swing and the score after it.

    Reads raw events: a disallowed goal is still a moment.  Whether it stands is
    taken from its last correction alone.
    """
    goal = P.is_goal() | P.is_own_goal()
    red = F.col("card").isin(*P.RED_CARDS)
    miss = P.is_shot() & (F.col("shot_type") == "Penalty")
    chance = P.is_shot() & (F.col("shot_xg") >= P.BIG_CHANCE)
    kind = F.when(goal, "goal").when(red, "red_card").when(miss, "penalty_miss").when(chance, "big_chance")
    c = events.filter(F.col("period") != 5).withColumn("kind", kind).filter("kind is not null").select(
        "match_id", "event_id", "period", "minute", "second", "idx", "team_id", "team", "player", "kind", "card", "x", "y",
        "shot_xg", "shot_type", "shot_outcome", P.is_own_goal().alias("own"))
    c = c.join(last_corrections(corrections), ["match_id", "event_id"], "left")
    off = (F.col("kind") == "goal") & F.coalesce(F.col("k_kind") == "disallow", F.lit(False))
    w = winners.select("match_id", "home_id", "winner", "winner_name")
    c = c.withColumn("kind", F.when(off, "disallowed_goal").otherwise(F.col("kind"))).join(w, "match_id")
    mine = F.coalesce(F.col("team_id") == F.col("home_id"), F.lit(False))
    counts = F.col("kind") == "goal"
    c = running_sums(c, ["match_id"], ["period", "minute"], ["second", "idx", "event_id"], {
        "home_after": F.when(counts & (F.col("own") != mine), 1), "away_after": F.when(counts & (F.col("own") == mine), 1)})
    c = with_probabilities(c, series)
    of_goal = F.col("kind").isin("goal", "disallowed_goal")
    return c.withColumns({
        "swing": F.abs(_for_winner("after") - _for_winner("before")),
        "mandatory": F.col("kind") != "big_chance",
        "shot_type": F.when(F.col("own"), "Own Goal").when(F.col("kind") == "red_card", "").otherwise(F.col("shot_type")),
        "detail": F.when(of_goal, F.coalesce("k_reason", F.lit(""))).when(F.col("kind") == "red_card", F.col("card")).otherwise(F.col("shot_outcome")),
        "ruled_out_at": F.when(F.col("kind") == "disallowed_goal", F.col("k_minute")),
        "synthesised": of_goal & F.coalesce("k_synthesised", F.lit(False)),
    }).drop("k_kind", "k_reason", "k_minute", "k_synthesised", "card", "shot_outcome", "own")


def choose(cands: DataFrame, limit: int = MAX_MOMENTS) -> DataFrame:
    """All mandatory moments, then the largest swings until `limit` is reached."""
    must = cands.filter("mandatory").groupBy("match_id").agg(F.count(F.lit(1)).alias("n_must"))
    largest = Window.partitionBy("match_id").orderBy(F.col("swing").desc(), *P.EVENT_ORDER)
    may = cands.filter("NOT mandatory").withColumn("rank", F.row_number().over(largest)).filter(F.col("rank") <= limit)
    may = may.join(must, "match_id", "left").filter(F.col("rank") <= limit - F.coalesce("n_must", F.lit(0))).drop("rank", "n_must")
    return cands.filter("mandatory").unionByName(may)


def _keep_larger(at: np.ndarray, must: np.ndarray) -> list[int]:
    """One period of one match, by swing: places that stay; a moment near a kept
    one goes, unless it is mandatory and displaces optional ones."""
    kept: list[int] = []
    for i in range(len(at)):
        near = [k for k in kept if abs(at[k] - at[i]) <= WINDOW_S]
        if all(must[i] and not must[k] for k in near):
            kept = [k for k in kept if k not in near] + [i]
    return kept


@F.pandas_udf(ArrayType(IntegerType()))
def _kept(at: pd.Series, must: pd.Series) -> pd.Series:
    return pd.Series([_keep_larger(a, m) for a, m in zip(at, must)], index=at.index, dtype=object)


def suppress_duplicates(chosen: DataFrame) -> DataFrame:
    """Within a period and 90 seconds keep the larger swing, mandatory first.

    A swing depends only on the minute, so of several moments of one kind of
    importance in the same second only the first can survive; dropping the rest
    first bounds each period to the seconds it has, and the walk to that.  Periods
    are walked many to a batch: only times and importance go to Python.
    """
    w = Window.partitionBy("match_id", "period", "minute", "second", "mandatory").orderBy("idx", "event_id")
    first = chosen.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    by_swing = F.struct(F.isnull("swing").alias("none"), (-F.col("swing")).alias("less"), (~F.col("mandatory")).alias("may"), "minute", "second", "idx", "event_id",
                        F.struct(*chosen.columns).alias("row"))
    periods = first.groupBy("match_id", "period").agg(F.array_sort(F.collect_list(by_swing)).alias("m"))
    at = F.transform("m", lambda x: x["minute"] * 60 + x["second"])
    kept = periods.withColumn("kept", _kept(at, F.transform("m", lambda x: ~x["may"])))
    return kept.select(F.explode(F.transform("kept", lambda i: F.col("m")[i]["row"])).alias("row")).select("row.*")


def biggest_swing(moments: DataFrame) -> DataFrame:
    """The largest swing of each match; the earliest of equals."""
    at = F.struct((-F.col("swing")).alias("s"), "period", "minute", "second", "idx", "event_id")
    cols = [c for c in moments.columns if c != "match_id"]
    return moments.groupBy("match_id").agg(F.min_by(F.struct(*cols), at).alias("m")).select("match_id", "m.*")
