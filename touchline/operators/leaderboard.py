"""Archive analytics by player: one rollup, many questions.

`player_match` folds the event scan to one row per player and match.  Every
leaderboard, career and catalog figure is a sum over that rollup, so distinct
match counts need no distinct aggregation and a player holding a large share of
all events is already reduced before the shuffle on the player.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P


def _one(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0).cast("long")


def _open_shot() -> Column:
    return P.is_shot() & (F.col("period") < 5)


#: metric -> (summand per event, description).  xG is summed in millionths.
METRICS: dict[str, tuple[Callable[[], Column], str]] = {
    "goals": (lambda: _one(P.is_goal() & (F.col("period") < 5)), "Goals, excluding penalty shootouts"),
    "xg": (
        lambda: F.when(_open_shot(), F.coalesce(N.micro("shot_xg"), F.lit(0))).otherwise(0).cast("long"),
        "Expected goals from every shot taken",
    ),
    "shots": (lambda: _one(_open_shot()), "Shots"),
    "assists": (lambda: _one(F.col("pass_goal_assist")), "Passes that led directly to a goal"),
    "key_passes": (
        lambda: _one(F.col("pass_shot_assist") | F.col("pass_goal_assist")),
        "Passes that led directly to a shot",
    ),
    "progressive_passes": (
        lambda: _one(P.complete() & P.progressive_archive()),
        "Completed passes that moved the ball at least 25% closer to goal, or into the box",
    ),
    "dribbles": (lambda: _one(F.col("type") == "Dribble"), "Dribbles attempted"),
    "pressures": (lambda: _one(F.col("type") == "Pressure"), "Pressing actions"),
    # career columns that are not ranked
    "passes": (lambda: _one(P.is_pass()), "Passes attempted"),
    "passes_known": (lambda: _one(P.is_pass() & F.col("pass_outcome").isNotNull()), "Passes with an outcome"),
    "passes_complete": (lambda: _one(P.complete()), "Passes completed"),
}
RANKED = ("goals", "xg", "shots", "assists", "key_passes", "progressive_passes", "dribbles", "pressures")

MATCH_KEYS = ("competition_id", "season_id", "match_id", "match_date")


def describe_metrics(df: DataFrame) -> DataFrame:
    """The metric list as rows, joined on nothing: ids and descriptions."""
    spark = df.sparkSession
    return spark.createDataFrame([(m, METRICS[m][1]) for m in RANKED], "id string, description string")


def player_match(
    events: DataFrame, metrics: Sequence[str] = tuple(METRICS), matches: DataFrame | None = None
) -> DataFrame:
    """One row per player and match with the chosen metric sums.

    `matches` supplies date, competition and season when the events lack them;
    it meets the rollup, never the raw events.
    """
    keys = [k for k in MATCH_KEYS if k in events.columns]
    latest = [c for c in ("team", "player", "position") if c in events.columns]

    # Over the raw events all buffers are numbers, so that Spark hashes and never sorts them;
    # a player has one or two spellings per match, and the latest is picked among these.
    spelt = events.filter(F.col("player_id").isNotNull()).groupBy(*keys, "player_id", *latest).agg(
        *[F.sum(METRICS[m][0]()).alias(m) for m in metrics], F.max("idx").alias("_at"))
    # an unknown name never hides a known one: its order key is null
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in latest]
    out = spelt.groupBy(*keys, "player_id").agg(*[F.sum(m).alias(m) for m in metrics], *last)
    if matches is not None:
        extra = [k for k in MATCH_KEYS if k not in keys]
        out = out.join(matches.select("match_id", *extra), "match_id")
    return out


def _latest(c: str) -> Column:
    when = F.struct("match_date", "match_id")
    return F.max_by(c, F.when(F.col(c).isNotNull(), when))


def leaderboard(
    rollup: DataFrame,
    metric: str,
    *,
    competition_id: int | None = None,
    season_id: int | None = None,
    limit: int = 25,
) -> DataFrame:
    """Top players by one metric, with their latest name and team."""
    if metric not in RANKED:
        raise KeyError(metric)
    if competition_id is not None:
        rollup = rollup.filter(F.col("competition_id") == competition_id)
    if season_id is not None:
        rollup = rollup.filter(F.col("season_id") == season_id)
    total = F.sum(metric)
    value = N.from_micro(total, 2) if metric == "xg" else total
    return (
        rollup.groupBy("player_id")
        .agg(
            _latest("player").alias("player"),
            _latest("team").alias("team"),
            F.count(F.lit(1)).alias("matches"),
            value.alias("value"),
        )
        .filter(F.col("value") > 0)
        .orderBy(F.col("value").desc(), F.col("matches"), F.col("player_id"))
        .limit(limit)
    )


def _career() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("matches"),
        F.sum("goals").alias("goals"),
        N.from_micro(F.sum("xg"), 2).alias("xg"),
        F.sum("assists").alias("assists"),
    ]


def player_seasons(rollup: DataFrame, player_id=None) -> DataFrame:
    """A career: one row per player and competition-season."""
    if player_id is not None:
        rollup = rollup.filter(F.col("player_id") == player_id)
    return rollup.groupBy("player_id", "competition_id", "season_id").agg(
        _latest("team").alias("team"),
        *_career(),
        F.sum("shots").alias("shots"),
        F.sum("key_passes").alias("key_passes"),
        F.sum("passes").alias("passes"),
        N.half_up(N.ratio(F.sum("passes_complete"), F.sum("passes_known")), 3).alias("pass_accuracy"),
        F.min("match_date").alias("first"),
        F.max("match_date").alias("last"),
    )


def career_order(seasons: DataFrame) -> DataFrame:
    return seasons.orderBy("player_id", F.col("last").desc(), "competition_id", "season_id")


def name_seasons(seasons: DataFrame, catalog: DataFrame) -> DataFrame:
    """Attach competition and season names; the id stands in for a missing one."""
    return (
        seasons.join(catalog, ["competition_id", "season_id"], "left")
        .withColumn("competition", F.coalesce("competition_name", F.col("competition_id").cast("string")))
        .withColumn("season", F.coalesce("season_name", F.col("season_id").cast("string")))
        .drop("competition_name", "season_name")
    )


def players_catalog(rollup: DataFrame) -> DataFrame:
    """Every player with headline career numbers."""
    return rollup.groupBy("player_id").agg(
        _latest("player").alias("name"),
        F.array_sort(F.collect_set("team")).alias("teams"),
        *_career(),
        _latest("position").alias("position"),
        F.min("match_date").alias("first"),
        F.max("match_date").alias("last"),
    )


def archive_size(events: DataFrame) -> DataFrame:
    """Events, matches and players from one narrow scan.

    The pairs (match, player) are counted once; each pair is sent on twice, under
    its match with its events and under its player, and groups are counted then.
    """
    pairs = events.groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("match_id").cast("string").alias("key"), "n"),
                    F.struct(F.lit(1).alias("side"), F.col("player_id").cast("string").alias("key"), F.lit(0).cast("long").alias("n")))
    groups = pairs.select(F.inline(sides)).groupBy("side", "key").agg(F.sum("n").alias("n"))
    one = F.when(F.col("key").isNotNull(), F.col("side"))
    # a null match is a group of its own, a null player is none
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if(F.col("side") == 0).alias("matches"), F.count_if(one == 1).alias("players"))
