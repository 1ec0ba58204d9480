"""Registered queries: team metrics, pass networks, timelines, match clock."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import metrics as ME
from touchline.operators import network as NW
from touchline.operators import timeline as TL
from touchline.plans import corrections as C
from touchline.plans.fixture import half_up, long, micro, table, with_views


def team_metrics(spark, d):
    return ME.team_metrics(C.effective(spark, d), C.sides(spark, d))


def progressive(spark, d):
    from touchline.functions import pitch as P

    e = table(spark, d, "match_events").filter(P.is_pass())
    return e.select("match_id", "event_id", P.progressive().alias("progressive"),
                    F.round(P.distance_to_goal("x", "y"), 6).alias("distance"))


def _passes(spark, d):
    return NW.counted_passes(table(spark, d, "match_events"))


def pass_nodes(spark, d):
    return NW.nodes(_passes(spark, d))


def pass_edges(spark, d):
    p = _passes(spark, d)
    return NW.edges(p, NW.nodes(p))


def timeline(spark, d):
    t = TL.timeline(table(spark, d, "match_events").withColumn("sub_player", F.concat(F.lit("Player "), F.col("sub_player_id").cast("string"))))
    return t.drop("idx").withColumn("xg", F.round("xg", 6))


def corrected_timeline(spark, d):
    t = TL.in_order(TL.corrected_timeline(table(spark, d, "match_events"), table(spark, d, "corrections"), C.verdicts(spark, d), C.sides(spark, d)))
    return t.withColumns({"xg": F.round("xg", 6), "corrected_at": F.coalesce("corrected_at", F.lit(-1)),
                          "home": F.col("home").cast("string"), "synthesised": F.col("synthesised").cast("string")})


def shot_map(spark, d):
    return TL.shot_map(table(spark, d, "match_events"), C.verdicts(spark, d), C.sides(spark, d))


def schedule(spark, d):
    return TL.schedule(table(spark, d, "match_events"), table(spark, d, "corrections"))


def glossary(spark, d):
    """Metric glosses beside the archive-wide average of each metric."""
    m = team_metrics(spark, d).agg(*[N_avg(c) for c in ME.GLOSSARY])
    return ME.glossary(m).join(m.unpivot([], list(ME.GLOSSARY), "metric", "average"), "metric")


def N_avg(c):
    from touchline.functions.numeric import exact_avg

    return exact_avg(c, 3).alias(c)


QUERIES = {
    "team_metrics": team_metrics,
    "progressive_pass": progressive,
    "first_substitution": lambda s, d: NW.first_substitution(table(s, d, "match_events")),
    "pass_nodes": pass_nodes,
    "pass_edges": pass_edges,
    "pass_network_coverage": lambda s, d: NW.coverage(table(s, d, "match_events"), C.sides(s, d)),
    "timeline": timeline,
    "timeline_corrected": corrected_timeline,
    "shot_map": shot_map,
    "period_starts": lambda s, d: TL.period_starts(table(s, d, "match_events")),
    "match_schedule": schedule,
    "metric_glossary": glossary,
}

DONE = "type = 'Pass' AND pass_outcome = 'Complete'"
DIST = "sqrt((120 - {x}) * (120 - {x}) + (40 - {y}) * (40 - {y}))"
D0, D1 = DIST.format(x="x", y="y"), DIST.format(x="end_x", y="end_y")
PROG = f"(({D0} > 0 AND {D1} <= 0.75e0 * {D0}) OR (end_x >= 102 AND end_y BETWEEN 18 AND 62))"
n = C.n


def _metrics_sql():
    cond = {
        "touches": "TRUE", "shots": "type = 'Shot'",
        "shots_on_target": "shot_outcome IN ('Goal', 'Saved', 'Saved to Post', 'Goal (disallowed)')",
        "big_chances": "shot_xg >= 0.3", "passes": "type = 'Pass'", "passes_completed": DONE,
        "corners": "pass_type = 'Corner'", "final_third_passes": f"{DONE} AND end_x >= 80", "progressive_passes": f"{DONE} AND {PROG}",
        "defensive_actions_high": "x >= 48 AND (type IN ('Interception', 'Foul Committed', 'Dribbled Past') OR duel_type = 'Tackle')",
        "fouls": "type = 'Foul Committed'", "yellow_cards": "card = 'Yellow Card'", "red_cards": "card IN ('Red Card', 'Second Yellow')",
    }
    own = ", ".join(f"{n(f'{c} AND mine')} AS {k}" for k, c in cond.items())
    return f"""SELECT match_id, side, own_id AS team_id, {own},
      {n("(mine AND type = 'Shot' AND shot_outcome = 'Goal') OR (NOT mine AND type = 'Own Goal Against')")} AS goals,
      {n("NOT mine AND type = 'Pass' AND x < 72 AND coalesce(pass_type, '') NOT IN ('Kick Off', 'Goal Kick', 'Throw-in', 'Corner', 'Free Kick')")} AS opponent_passes_deep,
      coalesce(sum({micro('shot_xg')}) FILTER (WHERE mine), 0) / 1e6 AS xg0,
      {n(f'{DONE} AND NOT mine AND end_x >= 80')} AS other_third, {n('NOT mine')} AS other_touches
      FROM (SELECT e.*, s.side, s.own_id, e.team_id = s.own_id AS mine FROM effective e JOIN
            (SELECT match_id, 'home' AS side, home_id AS own_id FROM matches UNION ALL SELECT match_id, 'away', away_id FROM matches) s USING (match_id)
            WHERE e.period <> 5) GROUP BY match_id, side, own_id"""


def _share(a, b):
    # the away share is one minus the home share, as printed
    h = f"CASE WHEN side = 'home' THEN {a} ELSE {b} END"
    r = f"coalesce(({h}) / nullif({a} + {b}, 0), 0.5)"
    return half_up(f"CASE WHEN side = 'home' THEN {r} ELSE 1 - {r} END", 3)


METRICS = f"""SELECT * EXCLUDE (xg0, other_third, other_touches), {half_up('xg0', 2)} AS xg,
  {half_up('coalesce(passes_completed / nullif(passes, 0), 0)', 3)} AS pass_accuracy,
  {_share('touches', 'other_touches')} AS possession, {_share('final_third_passes', 'other_third')} AS field_tilt,
  {half_up('opponent_passes_deep / nullif(defensive_actions_high, 0)', 2)} AS ppda FROM ({_metrics_sql()})"""
CUT = "SELECT match_id, team_id, min(minute) AS first_sub FROM match_events WHERE type = 'Substitution' GROUP BY match_id, team_id"
PASSES = f"""SELECT e.* FROM match_events e LEFT JOIN cut USING (match_id, team_id) WHERE {DONE} AND period <= 2 AND pass_recipient_id IS NOT NULL
  AND (first_sub IS NULL OR minute < first_sub)"""
_mx, _my = (half_up(f"sum({micro(c)}) / count(*) / 1e6", 1) for c in "xy")
NODES = f"""SELECT match_id, team_id, player_id, max(name) AS name, {_mx} AS x, {_my} AS y, count(*) AS touches FROM (
  SELECT match_id, team_id, player_id, player AS name, x, y FROM passes UNION ALL
  SELECT match_id, team_id, pass_recipient_id, NULL, end_x, end_y FROM passes) GROUP BY match_id, team_id, player_id HAVING count(*) >= 5"""
EDGES = """SELECT match_id, team_id, a, b, passes FROM (
   SELECT match_id, team_id, least(player_id, pass_recipient_id) AS a, greatest(player_id, pass_recipient_id) AS b, count(*) AS passes FROM passes GROUP BY ALL HAVING count(*) >= 3)
   WHERE (match_id, team_id, a) IN (SELECT (match_id, team_id, player_id) FROM nodes) AND (match_id, team_id, b) IN (SELECT (match_id, team_id, player_id) FROM nodes)"""


def _timeline(sub):
    return f"""SELECT match_id, event_id, period, minute, second, team_id, team, player,
  CASE WHEN period = 5 THEN 'shootout' WHEN shot_outcome = 'Goal' THEN 'goal' WHEN shot_type = 'Penalty' THEN 'penalty_miss' ELSE 'big_chance' END AS kind,
  CASE WHEN period = 5 THEN CASE WHEN shot_outcome = 'Goal' THEN 'scored' ELSE lower(shot_outcome) END WHEN shot_outcome = 'Goal' THEN shot_type ELSE shot_outcome END AS detail,
  CASE WHEN period < 5 THEN round(shot_xg, 6) END AS xg
  FROM match_events WHERE type = 'Shot' AND (period = 5 OR shot_outcome = 'Goal' OR shot_type = 'Penalty' OR shot_xg >= 0.3)
  UNION ALL SELECT match_id, event_id, period, minute, second, team_id, team, player, 'own_goal', '', NULL FROM match_events WHERE type = 'Own Goal Against'
  UNION ALL SELECT match_id, event_id, period, minute, second, team_id, team, player, 'card', card, NULL FROM match_events WHERE card IS NOT NULL
  UNION ALL SELECT match_id, event_id, period, minute, second, team_id, team, player, 'sub', {sub}, NULL FROM match_events WHERE type = 'Substitution'"""


NOMINAL = "CASE period WHEN 1 THEN 0 WHEN 2 THEN 2700 WHEN 3 THEN 5400 WHEN 4 THEN 6300 WHEN 5 THEN 7200 ELSE 0 END"
STARTS = f"""SELECT match_id, period, {long("coalesce(sum(len) OVER (PARTITION BY match_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")} AS starts_at,
  {long("sum(len) OVER (PARTITION BY match_id)")} AS match_length
  FROM (SELECT match_id, period, greatest(max(minute * 60 + second) - {NOMINAL}, 0) + 60 AS len FROM match_events GROUP BY match_id, period)"""
ORACLE = {
    "team_metrics": C.sql(METRICS),
    "progressive_pass": with_views(f"SELECT match_id, event_id, {PROG} AS progressive, round({D0}, 6) AS distance FROM match_events WHERE type = 'Pass'", "match_events"),
    "first_substitution": with_views("SELECT * FROM cut", "match_events", cut=CUT),
    "pass_nodes": with_views("SELECT * FROM nodes", "match_events", cut=CUT, passes=PASSES, nodes=NODES),
    "pass_edges": with_views(EDGES, "match_events", cut=CUT, passes=PASSES, nodes=NODES),
    "pass_network_coverage": with_views(
        """SELECT match_id, team_id, coalesce(first_sub, 90) AS until_minute,
           concat('Completed passes between players who started, up to the first substitution (', coalesce(first_sub, 90), '''').') AS note
           FROM (SELECT match_id, home_id AS team_id FROM matches UNION ALL SELECT match_id, away_id FROM matches) LEFT JOIN cut USING (match_id, team_id)""".replace("'''').'", "''').'"),
        "match_events", "matches", cut=CUT),
    "timeline": with_views(_timeline("concat('Player ', sub_player_id)"), "match_events"),
    "timeline_corrected": C.sql(f"""SELECT t.match_id, kind, period, minute, second, CAST(team_id = home_id AS VARCHAR) AS home, team, player, detail, CAST(event_id AS VARCHAR) AS event_id, xg,
        coalesce(disallowed AND kind = 'goal', FALSE) AS disallowed, CASE WHEN disallowed AND kind = 'goal' THEN reason END AS correction_reason,
        CASE WHEN disallowed AND kind = 'goal' THEN decided_at_minute ELSE -1 END AS corrected_at,
        NULL AS correction_kind, NULL AS authority, NULL AS supersedes, NULL AS synthesised
        FROM ({_timeline("''")}) t LEFT JOIN verdicts USING (match_id, event_id) JOIN (SELECT match_id, home_id FROM matches) s ON s.match_id = t.match_id
        UNION ALL SELECT match_id, 'correction', period, decided_at_minute, 59, NULL, '', '', reason, correction_id, NULL, FALSE, NULL, -1, kind, authority, CAST(supersedes AS VARCHAR), CAST(synthesised AS VARCHAR) FROM corrections"""),
    "shot_map": C.sql(f"""SELECT e.match_id, event_id, period, minute, second, team_id = home_id AS home, team, player_id, player, {half_up('x', 1)} AS x, {half_up('y', 1)} AS y,
        {half_up('end_x', 1)} AS end_x, {half_up('end_y', 1)} AS end_y, {half_up('shot_xg', 4)} AS xg, shot_outcome AS outcome, shot_type AS type, shot_body_part AS body_part,
        shot_outcome = 'Goal' AS goal, coalesce(disallowed, FALSE) AS disallowed, period = 5 AS shootout
        FROM match_events e LEFT JOIN verdicts USING (match_id, event_id) WHERE type = 'Shot' AND x IS NOT NULL"""),
    "period_starts": with_views(STARTS, "match_events"),
    "match_schedule": with_views(f"""SELECT match_id, {long(f"coalesce(starts_at, tail) + greatest(minute * 60 + second - {NOMINAL}, 0)")} AS at, kind, record_id, period, minute, second, idx
        FROM (SELECT match_id, 'event' AS kind, CAST(event_id AS VARCHAR) AS record_id, period, minute, second, idx FROM match_events
              UNION ALL SELECT match_id, 'correction', correction_id, period, decided_at_minute, 30, 0 FROM corrections)
        LEFT JOIN starts USING (match_id, period) LEFT JOIN (SELECT match_id, max(match_length) AS tail FROM starts GROUP BY match_id) USING (match_id)""",
        "match_events", "corrections", starts=STARTS),
    "metric_glossary": C.sql(" UNION ALL ".join(
        "SELECT '{m}' AS metric, '{g}' AS gloss, {v} AS average FROM tm".format(
            m=m, g=g.replace("'", "''"), v=half_up(f"sum({micro(m)}) / count({m}) / 1e6", 3)) for m, g in ME.GLOSSARY.items()), tm=METRICS),
}
