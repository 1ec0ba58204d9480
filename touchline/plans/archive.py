"""Registered queries: archive analytics (scan, rollup, shots)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import leaderboard as LB
from touchline.operators import shots as SH
from touchline.plans.fixture import half_up, long, micro, table, with_views
from touchline.session import scratch
from touchline.sources import archive as AR


def _rollup(spark, d, metrics=tuple(LB.METRICS)):
    return LB.player_match(table(spark, d, "match_events"), metrics, table(spark, d, "matches"))


def _leaderboard(metric):
    def run(spark, d):
        return LB.leaderboard(_rollup(spark, d, (metric,)), metric)

    return run


SHOT_OPEN = "type = 'Shot' AND period < 5"
IN_BOX_END = "(end_x >= 102 AND end_y BETWEEN 18 AND 62)"
NEARER = "sqrt((120 - end_x) * (120 - end_x) + (40 - end_y) * (40 - end_y)) <= 0.75e0 * sqrt((120 - x) * (120 - x) + (40 - y) * (40 - y))"
SQL_METRIC = {
    "goals": f"sum(CASE WHEN {SHOT_OPEN} AND shot_outcome = 'Goal' THEN 1 ELSE 0 END)",
    "xg": f"sum(CASE WHEN {SHOT_OPEN} THEN {micro('shot_xg')} ELSE 0 END)",
    "shots": f"sum(CASE WHEN {SHOT_OPEN} THEN 1 ELSE 0 END)",
    "assists": "sum(CASE WHEN pass_goal_assist THEN 1 ELSE 0 END)",
    "key_passes": "sum(CASE WHEN pass_shot_assist OR pass_goal_assist THEN 1 ELSE 0 END)",
    "progressive_passes": f"sum(CASE WHEN type = 'Pass' AND pass_outcome = 'Complete' AND end_x IS NOT NULL AND ({NEARER} OR {IN_BOX_END}) THEN 1 ELSE 0 END)",
    "dribbles": "sum(CASE WHEN type = 'Dribble' THEN 1 ELSE 0 END)",
    "pressures": "sum(CASE WHEN type = 'Pressure' THEN 1 ELSE 0 END)",
}
DATED = "(SELECT e.*, m.match_date FROM match_events e JOIN matches m USING (match_id))"


def _sql_value(metric):
    v = SQL_METRIC[metric]
    return half_up(f"({v}) / 1e6", 2) if metric == "xg" else long(v)


def _leaderboard_sql(metric):
    return with_views(
        f"""SELECT player_id, arg_max(player, (match_date, match_id, idx)) AS player,
                   arg_max(team, (match_date, match_id, idx)) AS team,
                   count(DISTINCT match_id) AS matches, {_sql_value(metric)} AS value
            FROM {DATED} WHERE player_id IS NOT NULL GROUP BY player_id
            HAVING {_sql_value(metric)} > 0 ORDER BY value DESC, matches, player_id LIMIT 25""",
        "match_events", "matches",
    )


CAREER = f"""count(DISTINCT match_id) AS matches, {long(SQL_METRIC['goals'])} AS goals,
  {_sql_value('xg')} AS xg, {long(SQL_METRIC['assists'])} AS assists"""
SEASONS_SQL = f"""SELECT player_id, competition_id, season_id, arg_max(team, (match_date, match_id, idx)) AS team, {CAREER},
  {long(SQL_METRIC['shots'])} AS shots, {long(SQL_METRIC['key_passes'])} AS key_passes,
  {long("sum(CASE WHEN type = 'Pass' THEN 1 ELSE 0 END)")} AS passes,
  {half_up("avg(CASE WHEN type = 'Pass' THEN CAST(pass_outcome = 'Complete' AS INT) END)", 3)} AS pass_accuracy,
  min(match_date) AS first, max(match_date) AS last
  FROM {DATED} WHERE player_id IS NOT NULL GROUP BY player_id, competition_id, season_id"""


def player_seasons(spark, d):
    return LB.career_order(LB.player_seasons(_rollup(spark, d)))


def _season_names(spark, d):
    # names are known for every second season only, so the id fallback is used too
    m = table(spark, d, "matches")
    return (
        m.select("competition_id", "season_id").distinct().filter(F.col("season_id") % 2 == 0)
        .withColumn("competition_name", F.concat(F.lit("League "), F.col("competition_id").cast("string")))
        .withColumn("season_name", F.concat((F.col("season_id") + 2000).cast("string"), F.lit("/"),
                                            (F.col("season_id") + 2001).cast("string")))
    )


def player_seasons_named(spark, d):
    named = LB.name_seasons(LB.player_seasons(_rollup(spark, d)), _season_names(spark, d))
    return named.select("player_id", "competition_id", "season_id", "competition", "season", "matches", "goals")


def players_catalog(spark, d):
    return LB.players_catalog(_rollup(spark, d)).withColumn("teams", F.array_join("teams", ","))


def archive_size(spark, d):
    return LB.archive_size(table(spark, d, "match_events"))


def metric_list(spark, d):
    # the described metrics, each with the number of players it ranks
    r = _rollup(spark, d)
    per = r.groupBy("player_id").agg(*[F.sum(m).alias(m) for m in LB.RANKED])
    n = per.agg(*[F.count(F.when(F.col(m) > 0, 1)).alias(m) for m in LB.RANKED])
    long_form = n.unpivot([], list(LB.RANKED), "id", "players")
    return LB.describe_metrics(r).join(long_form, "id")


PAGE_COLS = ["match_id", "idx", "event_id", "period", "minute", "second", "type", "team_id", "player_id", "x", "y", "shot_outcome"]


def event_page(spark, d):
    e = table(spark, d, "match_events")
    return SH.event_page(e, type="Shot", min_xg=0.3, limit=50, offset=25).select(*PAGE_COLS)


def event_page_total(spark, d):
    return SH.event_total(table(spark, d, "match_events"), type="Shot", min_xg=0.3)


def event_log_match(spark, d):
    e = table(spark, d, "match_events")
    return SH.event_page(e, match_id=7, limit=5000).select(*PAGE_COLS)


SHOT_COLS = """match_id, idx, player_id, player, team, minute, x, y, {xg} AS xg,
  shot_outcome AS outcome, shot_type AS type, shot_body_part AS body_part""".format(xg=half_up("shot_xg", 3))


def _shots(**kw):
    return lambda spark, d: SH.shots(table(spark, d, "match_events"), **kw)


def _shots_sql(where, limit=500):
    return with_views(
        f"SELECT {SHOT_COLS} FROM match_events WHERE {SHOT_OPEN} AND {where} "
        f"ORDER BY shot_xg DESC NULLS LAST, match_id, idx LIMIT {limit}", "match_events")


def outside_box_null_rules(spark, d):
    """Unknown coordinates: kept only when y alone puts the shot outside."""
    e = table(spark, d, "match_events")
    e = (e.withColumn("x", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("x")))
          .withColumn("y", F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("y"))))
    return SH.shots(e, outside_box=True, limit=None).select("match_id", "idx", "x", "y")


def match_shots(spark, d):
    return SH.shots_of_match(table(spark, d, "match_events"), 0.2).select("match_id", "event_id", "period", "minute", "shot_outcome")


def player_shots(spark, d):
    return SH.player_shots(table(spark, d, "match_events"), table(spark, d, "matches"))


def _written(spark, d):
    root = scratch(spark, "archive")
    e = table(spark, d, "match_events").join(table(spark, d, "matches").select("match_id", "match_date"), "match_id")
    AR.write(AR.conform(e), root)
    return root


ROW = ["competition_id", "season_id", "match_id", "match_date", "idx", "period", "type", "player_id", "x", "shot_outcome", "pass_outcome"]
ROW_SQL = """competition_id, season_id, CAST(match_id AS BIGINT) AS match_id, match_date, idx, period, type,
  CAST(player_id AS VARCHAR) AS player_id, x, shot_outcome, pass_outcome"""


def archive_scan(spark, d):
    """Write the archive, then scan one season of it: pruned by directory."""
    back = AR.read(spark, _written(spark, d))
    return back.filter(F.col("season_id") == 0).select(*ROW)


def archive_write(spark, d):
    """Everything written comes back."""
    return AR.read(spark, _written(spark, d)).select(*ROW)


def archive_replace_match(spark, d):
    """Writing a match again replaces it and leaves the others."""
    root = _written(spark, d)
    again = AR.read(spark, root).filter(F.col("match_id") % 5 == 2).withColumn("type", F.concat(F.lit("~"), F.col("type")))
    AR.replace_matches(again, root)
    return AR.read(spark, root).groupBy("season_id", "match_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("type").startswith("~").cast("long")).alias("replaced"))


def archive_compacted(spark, d):
    """The player-sorted copy holds the same rows."""
    src = AR.read(spark, _written(spark, d))
    out = scratch(spark, "compacted")
    AR.cluster_by_player(src, out)
    return AR.read(spark, out).select(*ROW)


def leaderboard_compacted(spark, d):
    """A leaderboard over the compacted archive: the same answer."""
    src = AR.read(spark, _written(spark, d))
    out = scratch(spark, "compacted")
    AR.cluster_by_player(src, out)
    rows = AR.read(spark, out).withColumn("player_id", F.col("player_id").cast("int"))
    return LB.leaderboard(LB.player_match(rows, ("goals",)), "goals")


QUERIES = {f"leaderboard_{m}": _leaderboard(m) for m in LB.RANKED} | {
    "leaderboard_season": lambda s, d: LB.leaderboard(_rollup(s, d, ("shots",)), "shots", competition_id=11, season_id=0, limit=10),
    "leaderboard_metrics": metric_list,
    "player_seasons": player_seasons,
    "player_seasons_named": player_seasons_named,
    "players_catalog": players_catalog,
    "archive_size": archive_size,
    "event_page": event_page,
    "event_page_total": event_page_total,
    "event_log_match": event_log_match,
    "shots_all": _shots(limit=None),
    "shots_top": _shots(limit=500),
    "shots_filtered": _shots(competition_id=11, season_id=0, min_xg=0.1, body_part="Head", limit=5000),
    "shots_outside_box": _shots(outside_box=True, limit=5000),
    "shots_outside_box_nulls": outside_box_null_rules,
    "shots_outside_box_by_player": lambda s, d: SH.outside_box_by_player(table(s, d, "match_events")),
    "shots_of_match": match_shots,
    "player_shots": player_shots,
    "archive_scan": archive_scan,
    "archive_write": archive_write,
    "archive_replace_match": archive_replace_match,
    "archive_compacted": archive_compacted,
    "leaderboard_compacted": leaderboard_compacted,
}

_PAGE = ", ".join(PAGE_COLS)
ORACLE = {f"leaderboard_{m}": _leaderboard_sql(m) for m in LB.RANKED} | {
    "leaderboard_season": with_views(
        f"""SELECT player_id, arg_max(player, (match_date, match_id, idx)) AS player, arg_max(team, (match_date, match_id, idx)) AS team,
            count(DISTINCT match_id) AS matches, {_sql_value('shots')} AS value FROM {DATED}
            WHERE competition_id = 11 AND season_id = 0 GROUP BY player_id HAVING value > 0
            ORDER BY value DESC, matches, player_id LIMIT 10""", "match_events", "matches"),
    "leaderboard_metrics": with_views(
        " UNION ALL ".join(
            f"SELECT '{m}' AS id, '{LB.METRICS[m][1]}' AS description, (SELECT count(*) FROM (SELECT player_id FROM match_events GROUP BY player_id HAVING {SQL_METRIC[m]} > 0)) AS players"
            for m in LB.RANKED), "match_events"),
    "player_seasons": with_views(SEASONS_SQL, "match_events", "matches"),
    "player_seasons_named": with_views(
        f"""SELECT player_id, competition_id, season_id,
            CASE WHEN season_id % 2 = 0 THEN concat('League ', competition_id) ELSE CAST(competition_id AS VARCHAR) END AS competition,
            CASE WHEN season_id % 2 = 0 THEN concat(season_id + 2000, '/', season_id + 2001) ELSE CAST(season_id AS VARCHAR) END AS season,
            matches, goals FROM ({SEASONS_SQL})""", "match_events", "matches"),
    "players_catalog": with_views(
        f"""SELECT player_id, arg_max(player, (match_date, match_id, idx)) AS name,
            array_to_string(list_sort(list(DISTINCT team)), ',') AS teams, {CAREER},
            arg_max(position, (match_date, match_id, idx)) AS position, min(match_date) AS first, max(match_date) AS last
            FROM {DATED} WHERE player_id IS NOT NULL GROUP BY player_id""", "match_events", "matches"),
    "archive_size": with_views(
        "SELECT count(*) AS events, count(DISTINCT match_id) AS matches, count(DISTINCT player_id) AS players FROM match_events", "match_events"),
    "event_page": with_views(
        f"SELECT {_PAGE} FROM match_events WHERE type = 'Shot' AND coalesce(shot_xg, 0) >= 0.3 ORDER BY match_id, idx LIMIT 50 OFFSET 25", "match_events"),
    "event_page_total": with_views(
        "SELECT count(*) AS total FROM match_events WHERE type = 'Shot' AND coalesce(shot_xg, 0) >= 0.3", "match_events"),
    "event_log_match": with_views(f"SELECT {_PAGE} FROM match_events WHERE match_id = 7 ORDER BY match_id, idx LIMIT 5000", "match_events"),
    "shots_all": _shots_sql("TRUE", 10**12),
    "shots_top": _shots_sql("TRUE", 500),
    "shots_filtered": _shots_sql("competition_id = 11 AND season_id = 0 AND coalesce(shot_xg, 0) >= 0.1 AND shot_body_part = 'Head'", 5000),
    "shots_outside_box": _shots_sql("NOT (x >= 102 AND y BETWEEN 18 AND 62)", 5000),
    "shots_outside_box_nulls": with_views(
        f"""SELECT match_id, idx, x, y FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN NULL ELSE x END AS x,
            CASE WHEN event_id % 5 = 0 THEN NULL ELSE y END AS y) FROM match_events)
            WHERE {SHOT_OPEN} AND NOT (x >= 102 AND y BETWEEN 18 AND 62)""", "match_events"),
    "shots_outside_box_by_player": with_views(
        f"""SELECT player_id, player, count(*) AS shots, {long("sum(CASE WHEN shot_outcome = 'Goal' THEN 1 ELSE 0 END)")} AS goals,
            {half_up(f"sum({micro('shot_xg')}) / 1e6", 2)} AS xg FROM match_events
            WHERE {SHOT_OPEN} AND NOT (x >= 102 AND y BETWEEN 18 AND 62) GROUP BY player_id, player""", "match_events"),
    "shots_of_match": with_views(
        "SELECT match_id, event_id, period, minute, shot_outcome FROM match_events WHERE type = 'Shot' AND coalesce(shot_xg, 0) >= 0.2", "match_events"),
    "player_shots": with_views(
        f"""SELECT player_id, rank, match_id, match_date AS date, minute, x, y, {half_up('shot_xg', 3)} AS xg,
            shot_outcome AS outcome, shot_type AS type, shot_body_part AS body_part FROM (
              SELECT *, CAST(row_number() OVER (PARTITION BY player_id ORDER BY match_date DESC, match_id DESC, idx DESC) AS INT) AS rank
              FROM {DATED} WHERE {SHOT_OPEN} AND x IS NOT NULL) WHERE rank <= 400""", "match_events", "matches"),
    "archive_scan": with_views(f"SELECT {ROW_SQL} FROM {DATED} WHERE season_id = 0", "match_events", "matches"),
    "archive_write": with_views(f"SELECT {ROW_SQL} FROM {DATED}", "match_events", "matches"),
    "archive_replace_match": with_views(
        f"SELECT season_id, CAST(match_id AS BIGINT) AS match_id, count(*) AS n, {long('sum(CASE WHEN match_id % 5 = 2 THEN 1 ELSE 0 END)')} AS replaced FROM match_events GROUP BY season_id, match_id", "match_events"),
    "archive_compacted": with_views(f"SELECT {ROW_SQL} FROM {DATED}", "match_events", "matches"),
    "leaderboard_compacted": _leaderboard_sql("goals"),
}
