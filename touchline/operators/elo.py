"""Causal Elo: a rating is read before the match that updates it.

Each rating depends on all matches before it, so a competition is worked through
in date order.  Competitions run in parallel; a long one is cut into steps of a
bounded number of results, and only the ratings (one row per team) pass from
step to step, through the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scan import running_sums
from touchline.session import cut

# Fixed values of the rating.
START, K, SCALE = 1500.0, 24.0, 400.0
STEP_ROWS = 200_000


def _rate(matches: pd.DataFrame, ratings: pd.DataFrame) -> pd.DataFrame:
    """One competition, one step: differences before each match, ratings after."""
    known = pd.Index(ratings["team"])
    teams = known.append(pd.Index(pd.unique(pd.concat([matches["home"], matches["away"]]))).difference(known))
    table = np.full(len(teams), START)
    table[:len(known)] = ratings["rating"].to_numpy()
    # All that a match needs besides the ratings is worked out for the whole step at once.
    margin = (matches["hg"] - matches["ag"]).to_numpy()
    weight, result = K * np.sqrt(np.maximum(np.abs(margin), 1)), (np.sign(margin) + 1) / 2
    sides = np.column_stack([teams.get_indexer(matches["home"]), teams.get_indexer(matches["away"])])
    diffs = np.empty(len(matches))
    for k, pair in enumerate(sides):
        diffs[k] = table[pair[0]] - table[pair[1]]
        won = weight[k] * (result[k] - 1.0 / (1.0 + 10.0 ** (-diffs[k] / SCALE)))
        table[pair] += (won, -won)
    out = pd.DataFrame({"match_id": matches["match_id"].to_numpy(), "value": diffs}).assign(team=None)
    after = pd.DataFrame({"team": teams, "value": table}).assign(match_id=None)
    return pd.concat([out, after], ignore_index=True)


def causal_elo(
    results: DataFrame,
    competition: str = "competition_id",
    order: Sequence[str] = ("match_date", "kick_off", "match_id"),
    step_rows: int = STEP_ROWS,
) -> DataFrame:
    """match_id -> home rating minus away rating before the match."""
    day, *rest = order
    n = results.select(
        F.col(competition).cast("string").alias("comp"), "match_id", *[c for c in order if c != "match_id"],
        F.col("home_id").cast("string").alias("home"), F.col("away_id").cast("string").alias("away"),
        F.coalesce("home_goals", F.lit(0)).cast("long").alias("hg"), F.coalesce("away_goals", F.lit(0)).cast("long").alias("ag"))
    ranked = running_sums(n, ["comp"], [day], rest, {"seq": F.lit(1)})
    ranked = cut(ranked.select("comp", "match_id", "home", "away", "hg", "ag", "seq", F.floor((F.col("seq") - 1) / step_rows).alias("step")), "elo-input")
    steps = ranked.agg(F.max("step")).first()[0]
    if steps is None:
        return results.select("match_id", F.lit(0.0).alias("elo_diff"))
    mid = dict(ranked.dtypes)["match_id"]
    schema = f"comp string, match_id {mid}, team string, value double"
    ratings = ranked.sparkSession.createDataFrame([], "comp string, team string, rating double")
    parts: DataFrame | None = None

    def work(key, matches, state):
        return _rate(matches.sort_values("seq"), state).assign(comp=key[0])[["comp", "match_id", "team", "value"]]

    for i in range(int(steps) + 1):
        todo = ranked.filter(F.col("step") == i).groupBy("comp").cogroup(ratings.groupBy("comp"))
        done = cut(todo.applyInPandas(work, schema), "elo")
        ratings = done.filter("team is not null").select("comp", "team", F.col("value").alias("rating"))
        part = done.filter("team is null").select("match_id", F.col("value").alias("elo_diff"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def latest_first(results: DataFrame, team_rows: DataFrame, n: int = 5) -> DataFrame:
    """Form: each team's last results, newest first."""
    newest = Window.partitionBy("team_id").orderBy(F.col("match_date").desc(), F.col("match_id").desc())
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return team_rows.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= n).select(
        "team_id", "n", "match_id", "match_date", "opponent_id", F.when(gf > ga, "W").when(gf == ga, "D").otherwise("L").alias("result"),
        F.concat(gf.cast("string"), F.lit("-"), ga.cast("string")).alias("score"))
