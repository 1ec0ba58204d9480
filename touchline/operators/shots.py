"""Shot and event queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for cond in conds:
        out = out & cond
    return out


def _worth(min_xg: float) -> Column:
    """xG of at least `min_xg`, an unknown one counting as 0.  Above 0 this is a
    plain comparison, which the file scan can skip row groups by."""
    xg = F.col("shot_xg")
    return xg >= min_xg if min_xg > 0 else F.coalesce(xg, F.lit(0.0)) >= min_xg


def matching_events(
    events: DataFrame,
    *,
    match_id=None,
    type: str | None = None,  # noqa: A002 - the query's own name
    player_id=None,
    period: int | None = None,
    min_xg: float | None = None,
) -> DataFrame:
    """The event log, filtered; every given filter reaches the scan."""
    conds: list[Column] = []
    if match_id is not None:
        conds.append(F.col("match_id") == match_id)
    if type:
        conds.append(F.col("type") == type)
    if player_id is not None:
        conds.append(F.col("player_id") == player_id)
    if period:
        conds.append(F.col("period") == period)
    if min_xg is not None:
        conds.append(_worth(min_xg))
    return events.filter(_all(conds)) if conds else events


def event_page(events: DataFrame, *, limit: int = 500, offset: int = 0, **filters) -> DataFrame:
    """One page in log order."""
    return matching_events(events, **filters).orderBy("match_id", "idx").offset(offset).limit(limit)


def event_total(events: DataFrame, **filters) -> DataFrame:
    """How many events the page is taken from."""
    return matching_events(events, **filters).agg(F.count(F.lit(1)).alias("total"))


def shots(
    events: DataFrame,
    *,
    competition_id: int | None = None,
    season_id: int | None = None,
    player_id=None,
    min_xg: float = 0.0,
    outside_box: bool = False,
    body_part: str | None = None,
    limit: int | None = 500,
) -> DataFrame:
    """Ad-hoc shot query, best chances first; the shootout is left out."""
    conds = [P.is_shot(), F.col("period") < 5, _worth(min_xg)]
    if competition_id is not None:
        conds.append(F.col("competition_id") == competition_id)
    if season_id is not None:
        conds.append(F.col("season_id") == season_id)
    if player_id is not None:
        conds.append(F.col("player_id") == player_id)
    if outside_box:
        conds.append(P.outside_box())
    if body_part:
        conds.append(F.col("shot_body_part") == body_part)
    picked = events.filter(_all(conds)).orderBy(F.col("shot_xg").desc_nulls_last(), "match_id", "idx")
    if limit is not None:
        picked = picked.limit(limit)
    dates = ["match_date"] if "match_date" in events.columns else []
    return picked.select(
        "match_id", *dates, "idx", "player_id", "player", "team", "minute", "x", "y",
        N.half_up("shot_xg", 3).alias("xg"), F.col("shot_outcome").alias("outcome"),
        F.col("shot_type").alias("type"), F.col("shot_body_part").alias("body_part"),
    )


def outside_box_by_player(events: DataFrame) -> DataFrame:
    """Shots from outside the box, per player."""
    return (
        events.filter(P.is_shot() & (F.col("period") < 5) & P.outside_box())
        .groupBy("player_id", "player")
        .agg(
            F.count(F.lit(1)).alias("shots"),
            N.count_if(P.is_goal()).alias("goals"),
            N.from_micro(N.micro_sum("shot_xg"), 2).alias("xg"),
        )
    )


def shots_of_match(events: DataFrame, min_xg: float = 0.0) -> DataFrame:
    """Shots of each match worth at least `min_xg`; an unknown xG counts as 0."""
    return events.filter(P.is_shot() & _worth(min_xg))


def player_shots(events: DataFrame, matches: DataFrame | None = None, limit: int = 400) -> DataFrame:
    """Each player's latest shots, newest first.

    The rank filter is applied before the shuffle too, so a prolific player
    sends at most `limit` rows per task.
    """
    picked = events.filter(P.is_shot() & (F.col("period") < 5) & F.col("x").isNotNull())
    if matches is not None and "match_date" not in events.columns:
        picked = picked.join(matches.select("match_id", "match_date"), "match_id")
    newest = Window.partitionBy("player_id").orderBy(
        F.col("match_date").desc(), F.col("match_id").desc(), F.col("idx").desc()
    )
    return (
        picked.withColumn("rank", F.row_number().over(newest))
        .filter(F.col("rank") <= limit)
        .select(
            "player_id", "rank", "match_id", F.col("match_date").alias("date"), "minute", "x", "y",
            N.half_up("shot_xg", 3).alias("xg"), F.col("shot_outcome").alias("outcome"),
            F.col("shot_type").alias("type"), F.col("shot_body_part").alias("body_part"),
        )
    )
