"""Registered queries: league tables under each rule set, groups, coverage gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import standings as SD
from touchline.plans import corrections as C
from touchline.plans.fixture import table, with_views
from touchline.session import cut

BY = ["region_id", "season_id"]


def _h2h(spark, d):
    return SD.head_to_head(table(spark, d, "results_region"), BY)


def _standings(rule):
    def run(spark, d):
        return SD.standings(table(spark, d, "results_region"), BY, rule)

    return run


def _match_results(spark, d):
    """Final scores of the derived matches, as results."""
    from touchline.operators import state as ST

    st = ST.match_state(C.corrected(spark, d), C.sides(spark, d))
    m = table(spark, d, "matches")
    return ST.with_names(st.select("match_id", F.col("home_score").alias("home_goals"), F.col("away_score").alias("away_goals")), m)


def league_standings(spark, d):
    """The league behind the match events, under its own competition's rule."""
    return SD.standings(_match_results(spark, d), ["competition_id", "season_id"], SD.LEAGUE_RULES[11])


def cards(spark, d):
    """Seasons of every kind: a full league, groups, a partial league, a cup."""
    cols = ["competition_id", "season_id", "international", "stage", "kickoff", "home_id", "away_id", "home_goals", "away_goals"]
    league = _match_results(spark, d).select(
        "competition_id", "season_id", F.lit(False).alias("international"), "stage", F.col("match_date").cast("timestamp_ntz").alias("kickoff"),
        "home_id", "away_id", "home_goals", "away_goals")
    r = table(spark, d, "results_region")

    def as_competition(cid, rows, intl, stage):
        return rows.withColumns({"competition_id": F.lit(cid), "international": F.lit(intl), "stage": F.lit(stage)}).select(*cols)

    return (league.unionByName(as_competition(43, r, True, "Group Stage"))
            .unionByName(as_competition(55, r.filter("season_id % 2 = 0"), True, "Group Stage"))
            .unionByName(as_competition(72, r, True, "Round of 16"))
            .unionByName(as_competition(2, r.filter("match_id % 97 = 1"), False, "Regular Season")))


def season_tables(spark, d):
    c = cut(cards(spark, d), "cards")
    return SD.season_tables(c, SD.season_facts(c))


def season_notes(spark, d):
    return SD.season_notes(SD.season_facts(cards(spark, d)))


def explained(spark, d):
    """The league table with the rule's sentence beside each row."""
    t = league_standings(spark, d)
    return t.join(SD.explanations(t), "rule_id").select("competition_id", "season_id", "position", "team_id", "points", "rule_id", "explanation")


QUERIES = {
    "league_rows": lambda s, d: SD.league_rows(_h2h(s, d), BY).drop("away_goals"),
    "head_to_head": _h2h,
} | {f"standings_{r.lower()}": _standings(r) for r in SD.TIE_BREAKS} | {
    "standings_unknown_rule": _standings("NO_SUCH_RULE"),
    "standings_league": league_standings,
    "standings_explained": explained,
    "groups": lambda s, d: SD.groups(table(s, d, "results_region"), ["season_id"]),
    "season_tables": season_tables,
    "season_notes": season_notes,
}


def h2h_sql(src, by):
    b = ", ".join(by)
    return f"""SELECT {b}, team_id, opponent_id, count(*) AS played, count(*) FILTER (WHERE gf > ga) AS won, count(*) FILTER (WHERE gf = ga) AS drawn,
      count(*) FILTER (WHERE gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against, CAST(sum(ag) AS BIGINT) AS away_goals FROM (
      SELECT {b}, home_id AS team_id, away_id AS opponent_id, home_goals AS gf, away_goals AS ga, 0 AS ag FROM {src} UNION ALL
      SELECT {b}, away_id, home_id, away_goals, home_goals, away_goals FROM {src}) GROUP BY {b}, team_id, opponent_id"""


def rows_sql(h2h, by):
    b = ", ".join(by)
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in SD.SUMS)
    return f"""SELECT *, goals_for - goals_against AS goal_difference, won * 3 + drawn AS points FROM (SELECT {b}, team_id, {sums} FROM {h2h} GROUP BY {b}, team_id)"""


MINI = {"h2h_points": "h.won * 3 + h.drawn", "h2h_goal_difference": "h.goals_for - h.goals_against", "h2h_away_goals": "h.away_goals", "h2h_goals_for": "h.goals_for"}


def standings_ctes(prefix, h2h, by, rule, shown=None):
    """CTEs that unroll the rule list; the last is <prefix>_final."""
    out = {f"{prefix}_0": rows_sql(h2h, by)}
    scores = ["points"]
    for i, r in enumerate(SD.TIE_BREAKS[rule].rules):
        prev = f"{prefix}_{i}"
        if r in MINI:
            same = " AND ".join([f"a.{c} = b.{c}" for c in (*by, *scores)])
            key = " AND ".join(f"a.{c} = h.{c}" for c in (*by, "team_id"))
            grp = ", ".join(f"a.{c}" for c in (*by, "team_id"))
            using = ", ".join((*by, "team_id"))
            out[f"{prefix}_{i + 1}"] = f"""SELECT p.*, coalesce(m.v, 0) AS s{i} FROM {prev} p LEFT JOIN (
               SELECT {grp}, sum({MINI[r]}) AS v FROM {prev} a JOIN {h2h} h ON {key} JOIN {prev} b ON b.team_id = h.opponent_id AND {same} GROUP BY {grp}) m USING ({using})"""
        else:
            out[f"{prefix}_{i + 1}"] = f"SELECT *, {r} AS s{i} FROM {prev}"
        scores.append(f"s{i}")
    b = ", ".join(by)
    order = ", ".join(f"{s} DESC" for s in scores)
    out[f"{prefix}_final"] = f"""SELECT {b}, CAST(row_number() OVER (PARTITION BY {b} ORDER BY {order}, team_id) AS INT) AS position, team_id, played, won, drawn, lost, goals_for, goals_against,
      goal_difference, points, count(*) OVER (PARTITION BY {b}, {', '.join(scores)}) > 1 AS unresolved, '{shown or rule}' AS rule_id FROM {prefix}_{len(SD.TIE_BREAKS[rule].rules)}"""
    return out


def _standings_sql(rule, shown=None):
    return with_views("SELECT * FROM t_final", "results_region", h2h=h2h_sql("results_region", BY), **standings_ctes("t", "h2h", BY, rule, shown))


RESULTS_MATCH = """SELECT m.*, s.home_score AS home_goals, s.away_score AS away_goals FROM state s JOIN matches m USING (match_id)"""
LB = ["competition_id", "season_id"]
LEAGUE = dict(state=C.STATE, results_match=RESULTS_MATCH, lh2h=h2h_sql("results_match", LB), **standings_ctes("l", "lh2h", LB, "LIGA"))
REACH = """SELECT season_id, home_id AS team_id, home_id AS other FROM edges UNION SELECT r.season_id, r.team_id, e.away_id FROM reach r JOIN edges e ON e.season_id = r.season_id AND e.home_id = r.other"""
EDGES = "SELECT DISTINCT season_id, home_id, away_id FROM results_region UNION SELECT DISTINCT season_id, away_id, home_id FROM results_region"
GROUPS = """SELECT season_id, team_id, CAST(dense_rank() OVER (PARTITION BY season_id ORDER BY k, label) AS INT) AS group_no FROM (
   SELECT l.season_id, l.team_id, l.label, min(f.kickoff) OVER (PARTITION BY l.season_id, l.label) AS k FROM
   (SELECT season_id, team_id, min(other) AS label FROM reach GROUP BY season_id, team_id) l
   LEFT JOIN (SELECT season_id, home_id AS team_id, min(kickoff) AS kickoff FROM results_region GROUP BY season_id, home_id) f USING (season_id, team_id))"""
# the same groups serve competitions 43 (all seasons) and 55 (even ones)
GB = ["competition_id", "season_id", "group_no"]
GROUP_RESULTS = """SELECT c.competition_id, r.season_id, g.group_no, r.home_id, r.away_id, r.home_goals, r.away_goals FROM results_region r
   JOIN groups g ON g.season_id = r.season_id AND g.team_id = r.home_id JOIN (SELECT 43 AS competition_id UNION ALL SELECT 55) c ON c.competition_id = 43 OR r.season_id % 2 = 0"""
GROUP_CTES = dict(edges=EDGES, reach=REACH, groups=GROUPS, group_results=GROUP_RESULTS,
                  g43=h2h_sql("(SELECT * FROM group_results WHERE competition_id = 43)", GB), g55=h2h_sql("(SELECT * FROM group_results WHERE competition_id = 55)", GB),
                  **standings_ctes("f", "g43", GB, "FIFA_GROUP"), **standings_ctes("u", "g55", GB, "UEFA_EURO_GROUP"))
COVER = """SELECT season_id, count(*) AS matches, (SELECT count(DISTINCT t) FROM (SELECT home_id AS t, season_id AS s FROM {r} UNION ALL SELECT away_id, season_id FROM {r}) WHERE s = season_id) AS teams FROM {r} GROUP BY season_id"""
GROUP_NOTE = "CASE WHEN n < k * (k - 1) // 2 THEN concat(n, ' of ', CAST(k * (k - 1) // 2 AS BIGINT), ' group matches are in the archive.') ELSE '' END"
_T = "position, team_id, played, won, drawn, lost, goals_for, goals_against, goal_difference, points, unresolved, rule_id"
SEASON_TABLES = f"""SELECT competition_id, season_id, {_T}, '' AS note, 'League' AS "table" FROM l_final JOIN (SELECT season_id FROM cover WHERE matches >= 0.9 * teams * (teams - 1)) USING (season_id)
  UNION ALL SELECT competition_id, season_id, {_T}, {GROUP_NOTE}, concat('Group ', group_no) FROM (SELECT * FROM f_final UNION ALL SELECT * FROM u_final)
  JOIN (SELECT competition_id, season_id, group_no, count(*) AS n, (SELECT count(*) FROM groups g WHERE g.season_id = x.season_id AND g.group_no = x.group_no) AS k
        FROM group_results x GROUP BY competition_id, season_id, group_no) USING (competition_id, season_id, group_no)"""
PL_PART = "SELECT * FROM results_region WHERE match_id % 97 = 1"


def _partial(cid, cov):
    return f"""SELECT {cid} AS competition_id, season_id, matches, CASE WHEN matches >= 0.9 * teams * (teams - 1) THEN '' ELSE
      concat('The open data holds ', matches, ' of this season''s ', teams * (teams - 1), ' league matches - mostly one club''s fixtures. A table built from them would be wrong, so none is shown.') END AS note FROM {cov}"""


SEASON_NOTES = f"""{_partial(11, 'cover')} UNION ALL {_partial(2, 'cover_pl')}
  UNION ALL SELECT 43, season_id, count(*), '{SD.NOTE_GROUPS}' FROM results_region GROUP BY season_id
  UNION ALL SELECT 55, season_id, count(*), '{SD.NOTE_GROUPS}' FROM results_region WHERE season_id % 2 = 0 GROUP BY season_id
  UNION ALL SELECT 72, season_id, count(*), '{SD.NOTE_KNOCKOUT}' FROM results_region GROUP BY season_id"""


def _sql(query, recursive=False, **extra):
    return with_views(query, "match_events", "corrections", "matches", "results_region", recursive=recursive,
                      verdicts=C.VERDICTS, corrected=C.CORRECTED, **extra)


ORACLE = {
    "league_rows": with_views(f"SELECT * EXCLUDE (away_goals) FROM ({rows_sql('h2h', BY)})", "results_region", h2h=h2h_sql("results_region", BY)),
    "head_to_head": with_views(h2h_sql("results_region", BY), "results_region"),
} | {f"standings_{r.lower()}": _standings_sql(r) for r in SD.TIE_BREAKS} | {
    "standings_unknown_rule": _standings_sql("PL"),
    "standings_league": _sql("SELECT * FROM l_final", **LEAGUE),
    "standings_explained": _sql(f"SELECT competition_id, season_id, position, team_id, points, rule_id, '{SD.TIE_BREAKS['LIGA'].explanation}' AS explanation FROM l_final", **LEAGUE),
    "groups": _sql("SELECT * FROM groups", True, edges=EDGES, reach=REACH, groups=GROUPS),
    "season_tables": _sql(SEASON_TABLES, True, **LEAGUE, **GROUP_CTES, cover=COVER.format(r="results_match")),
    "season_notes": _sql(SEASON_NOTES, **LEAGUE, pl_part=PL_PART, cover=COVER.format(r="results_match"), cover_pl=COVER.format(r="pl_part")),
}
