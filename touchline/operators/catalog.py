"""Match cards and everything listed from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N

# Stages that are not knockout; thresholds of the story tags.
LEAGUE_STAGES = ("Regular Season", "Group Stage")
SWING, GOALS, ROBBERY = 0.4, 5, 0.8
TAGS = ("penalties", "turnaround", "goal-fest", "smash-and-grab", "stalemate", "knockout")


def knockout(stage: str = "stage") -> Column:
    s = F.coalesce(F.col(stage), F.lit(""))
    return (s != "") & ~s.isin(*LEAGUE_STAGES)


def story_tags() -> Column:
    """Why a match is worth a look, from its score, xG, swing and stage."""
    h, a, hx, ax = (F.col(c) for c in ("home_score", "away_score", "home_xg", "away_xg"))
    robbed = ((h > a) & (hx < ax - ROBBERY)) | ((a > h) & (ax < hx - ROBBERY))
    rules = (F.col("shootout"), F.coalesce(F.col("biggest_swing"), F.lit(0.0)) >= SWING, h + a >= GOALS, robbed, (h == 0) & (a == 0), knockout())
    return F.array_compact(F.array(*[F.when(r, F.lit(t)) for r, t in zip(rules, TAGS)]))


def cards(matches: DataFrame, state: DataFrame, metrics: DataFrame, reports: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One flat row per match: scoreboard line and story.

    `frames`: match_id, has_freeze_frames (from the shot map), optional.
    """
    xg = metrics.groupBy("match_id").agg(F.max(F.when(F.col("side") == "home", F.col("xg"))).alias("home_xg"),
                                         F.max(F.when(F.col("side") == "away", F.col("xg"))).alias("away_xg"))
    st = state.select("match_id", "home_score", "away_score", "shootout", "home_shootout", "away_shootout", "status")
    rp = reports.select("match_id", "headline", F.col("lede").alias("standfirst"), F.round(F.coalesce("biggest_swing", F.lit(0.0)), 4).alias("biggest_swing"))
    c = matches.join(st, "match_id").join(xg, "match_id", "left").join(rp, "match_id", "left")
    if frames is not None:
        c = c.join(frames, "match_id", "left")
    else:
        c = c.withColumn("has_freeze_frames", F.lit(False))
    return c.withColumns({"tags": story_tags(), "biggest_swing": N.half_up("biggest_swing", 3),
                          "has_freeze_frames": F.coalesce("has_freeze_frames", F.lit(False))})


def has_freeze_frames(shot_rows: DataFrame) -> DataFrame:
    return shot_rows.groupBy("match_id").agg(F.bool_or(F.size("freeze") > 0).alias("has_freeze_frames"))


def team_catalog(cards_: DataFrame) -> DataFrame:
    """Every team's record across the archive."""
    side = lambda s, o: F.struct(
        F.col(f"{s}_id").alias("team_id"), F.col(s).alias("name"), F.col(f"{s}_score").alias("gf"), F.col(f"{o}_score").alias("ga"),
        F.coalesce(F.col(f"{s}_xg"), F.lit(0.0)).alias("xf"), F.coalesce(F.col(f"{o}_xg"), F.lit(0.0)).alias("xa"))
    rows = cards_.select("match_id", "competition", "match_date", F.inline(F.array(side("home", "away"), side("away", "home"))))
    gf, ga = F.col("gf"), F.col("ga")
    return rows.groupBy("team_id").agg(
        F.max_by("name", F.struct("match_date", "match_id")).alias("name"), F.count(F.lit(1)).alias("matches"),
        N.count_if(gf > ga).alias("won"), N.count_if(gf == ga).alias("drawn"), N.count_if(gf < ga).alias("lost"),
        F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"),
        N.from_micro(N.micro_sum("xf"), 1).alias("xg_for"), N.from_micro(N.micro_sum("xa"), 1).alias("xg_against"),
        F.array_sort(F.collect_set("competition")).alias("competitions"), F.min("match_date").alias("first"), F.max("match_date").alias("last"))


def season_catalog(cards_: DataFrame) -> DataFrame:
    """Per competition-season: matches and date range."""
    return cards_.groupBy("competition_id", "competition", "season_id").agg(
        F.count(F.lit(1)).alias("matches"), F.min("match_date").alias("from"), F.max("match_date").alias("to"))


def competition_catalog(cards_: DataFrame) -> DataFrame:
    """Competitions with their seasons, newest season first."""
    s = F.struct(F.col("to"), F.col("season_id"), F.col("matches"), F.col("from"))
    return season_catalog(cards_).groupBy("competition_id", "competition").agg(
        F.sum("matches").alias("matches"), F.sort_array(F.collect_list(s), asc=False).alias("seasons"))


def archive_stats(size: DataFrame, cards_: DataFrame) -> DataFrame:
    """Size of the archive with competitions, seasons and dates, as key/value rows."""
    seasons = season_catalog(cards_)
    text = lambda c: F.col(c).cast("string").alias(c)
    a = size.select(*[text(c) for c in ("events", "matches", "players")]).unpivot([], ["events", "matches", "players"], "key", "value")
    b = seasons.agg(F.countDistinct("competition_id").cast("string").alias("competitions"), F.count(F.lit(1)).cast("string").alias("seasons"),
                    F.min("from").alias("from"), F.max("to").alias("to"))
    return a.unionByName(b.unpivot([], ["competitions", "seasons", "from", "to"], "key", "value"))


# ---- listings


def feed(cards_: DataFrame, *, tag: str | None = None, before: tuple[str, int] | None = None, limit: int = 30) -> DataFrame:
    """Newest first; `before` is the (date, id) of the last row already seen."""
    rows = cards_
    if tag:
        rows = rows.filter(F.array_contains("tags", tag))
    if before:
        date, mid = before
        rows = rows.filter((F.col("match_date") < date) | ((F.col("match_date") == date) & (F.col("match_id") < mid)))
    return rows.orderBy(F.col("match_date").desc(), F.col("match_id").desc()).limit(limit)


def team_matches(cards_: DataFrame, team_id=None) -> DataFrame:
    """Each team's matches; order by date and id, newest first."""
    both = cards_.select("*", F.explode(F.array("home_id", "away_id")).alias("team_id"))
    return both if team_id is None else both.filter(F.col("team_id") == team_id)


def matches_on(cards_: DataFrame, date: str) -> DataFrame:
    return cards_.filter(F.col("match_date") == date)


def season_matches(cards_: DataFrame, competition_id: int, season_id: int) -> DataFrame:
    return cards_.filter((F.col("competition_id") == competition_id) & (F.col("season_id") == season_id))


def collections(cards_: DataFrame) -> DataFrame:
    """Six editorial collections.  Each is its own top-k, so no list is ranked
    as a whole; `finals` lists every final."""
    total_xg = F.coalesce("home_xg", F.lit(0.0)) + F.coalesce("away_xg", F.lit(0.0))
    goals = (F.col("home_score") + F.col("away_score")).cast("double")
    date = F.col("match_date")
    none, nodate = F.lit(None).cast("double"), F.lit(None).cast("string")
    picks = [
        ("turnarounds", F.array_contains("tags", "turnaround"), F.col("biggest_swing"), nodate, 12),
        ("finals", F.col("stage") == "Final", none, date, None),
        ("goal_fests", goals >= GOALS, goals, nodate, 12),
        ("smash_and_grab", F.array_contains("tags", "smash-and-grab"), F.abs(F.col("home_xg") - F.col("away_xg")), nodate, 12),
        ("shootouts", knockout() & F.col("shootout"), none, date, 24),
        ("highest_xg", F.lit(True), total_xg, nodate, 12),
    ]
    out = []
    for name, cond, value, day, n in picks:
        rows = cards_.filter(cond).select(F.lit(name).alias("collection"), "match_id", value.alias("value"), day.alias("date"))
        if n:
            rows = rows.orderBy(F.col("value").desc_nulls_last(), F.col("date").desc_nulls_last(), "match_id").limit(n)
        out.append(rows)
    return reduce(DataFrame.unionByName, out)


def front_page(cards_: DataFrame, picked: DataFrame, stats: DataFrame) -> DataFrame:
    """Latest stories, the head of each collection and the archive's size."""
    latest = feed(cards_, limit=18).select(F.lit("latest").alias("block"), F.col("match_id").cast("string").alias("key"), F.col("match_date").alias("value"))
    first = Window.partitionBy("collection").orderBy(F.col("value").desc_nulls_last(), F.col("date").desc_nulls_last(), "match_id")
    heads = picked.withColumn("n", F.row_number().over(first)).filter("n <= 8").select(
        F.concat(F.lit("collection:"), F.col("collection")).alias("block"), F.col("match_id").cast("string").alias("key"), F.col("n").cast("string").alias("value"))
    return latest.unionByName(heads).unionByName(stats.select(F.lit("archive").alias("block"), "key", "value"))


def search_index(competitions: DataFrame, teams: DataFrame, players: DataFrame) -> DataFrame:
    """Everything that can be found by name, heavier kinds first."""
    w = lambda base: (F.lit(base) + F.col("matches")).cast("long").alias("weight")
    c = competitions.select(F.lit("competition").alias("kind"), F.col("competition_id").cast("string").alias("id"), F.col("competition").alias("name"),
                            F.lit("").alias("subtitle"), w(10_000))
    t = teams.select(F.lit("team").alias("kind"), F.col("team_id").cast("string").alias("id"), "name",
                     F.array_join(F.slice("competitions", 1, 2), ", ").alias("subtitle"), w(1_000))
    p = players.select(F.lit("player").alias("kind"), F.col("player_id").cast("string").alias("id"), "name",
                       F.coalesce(F.try_element_at("teams", F.lit(1)), F.lit("")).alias("subtitle"), w(0))
    return c.unionByName(t).unionByName(p)


def search(index: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Exact name, then a word that starts with the query, then anywhere; the
    heavier first within a tier."""
    from touchline.functions.text import _fold, fold

    q = _fold(needle.strip())
    hits = index.withColumn("folded", fold("name")).filter(F.col("folded").contains(q))
    tier = F.when(F.col("folded") == q, 0).when(F.exists(F.split("folded", r"\s+"), lambda w: w.startswith(q)), 1).otherwise(2)
    return hits.withColumn("tier", tier).orderBy("tier", F.col("weight").desc(), "kind", "id").limit(limit).drop("folded")
