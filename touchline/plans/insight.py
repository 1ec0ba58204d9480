"""Registered queries: expected threat, expected assists, possession chains, packing, facts from several feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import chains as CN
from touchline.operators import conflicts as CF
from touchline.operators import creation as CR
from touchline.operators import log as LG
from touchline.operators import packing as PK
from touchline.operators import shots as SH
from touchline.operators import threat as TH
from touchline.plans import archive as A
from touchline.plans import corrections as C
from touchline.plans import ingest as IN
from touchline.plans.fixture import half_up, long, micro, once, table, with_views
from touchline.sources import api_football as AF
from touchline.sources import football_data as FD


# ---- expected threat
def xt_grid(spark, d):
    return TH.grid(TH.counts(table(spark, d, "ball_events")))


def xt_players(spark, d):
    e = table(spark, d, "ball_events")
    return TH.players(e, TH.grid(TH.counts(e)))


ZONE = "CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN CAST(greatest(least(floor({x} * 16 / 120e0), 15), 0) * 12 + greatest(least(floor({y} * 12 / 80e0), 11), 0) AS INT) END"
MOVED = "(type = 'Pass' AND pass_outcome = 'Complete' OR type = 'Carry')"


def _xt(query):
    ctes = {
        "acts": f"""SELECT * FROM (SELECT *, {ZONE.format(x='x', y='y')} AS zone, CASE WHEN {MOVED} THEN {ZONE.format(x='end_x', y='end_y')} END AS "to" FROM ball_events WHERE period < 5 AND type IN ('Pass', 'Carry', 'Shot'))
            WHERE zone IS NOT NULL AND ("to" IS NOT NULL OR NOT {MOVED})""",
        "base": "SELECT zone, count(*) AS actions, count(*) FILTER (WHERE type = 'Shot') AS shots, count(*) FILTER (WHERE type = 'Shot' AND shot_outcome = 'Goal') AS goals FROM acts GROUP BY zone",
        "steps": 'SELECT zone, "to", count(*) AS n FROM acts WHERE "to" IS NOT NULL GROUP BY ALL',
        "worths": f"""SELECT 0 AS r, zone, CAST(0 AS BIGINT) AS v FROM base UNION ALL
            SELECT now.r + 1, b.zone, CAST((CAST(any_value(b.goals) AS HUGEINT) * {TH.UNIT} + coalesce(sum(CAST(s.n AS HUGEINT) * w.v), 0)) // any_value(b.actions) AS BIGINT)
            FROM (SELECT DISTINCT r FROM worths) now JOIN base b ON now.r < {TH.ROUNDS} LEFT JOIN steps s ON s.zone = b.zone LEFT JOIN worths w ON w.zone = s."to" GROUP BY now.r, b.zone""",
        "grid": f"""SELECT CAST(z AS INT) AS zone, {', '.join(long(f'coalesce({c}, 0)') + f' AS {c}' for c in ('actions', 'shots', 'goals'))}, coalesce(v, 0) AS value
            FROM range(0, {TH.COLUMNS * TH.ROWS}) g(z) LEFT JOIN base ON base.zone = z LEFT JOIN (SELECT zone, v FROM worths WHERE r = {TH.ROUNDS}) w ON w.zone = z""",
    }
    return with_views(query, "ball_events", recursive=True, **ctes)


# ---- expected assists
def _created(spark, d):
    return CR.created_shots(LG.effective_events(table(spark, d, "ball_events"), C.verdicts(spark, d)))


MADE = f"""SELECT s.match_id, s.event_id, p.player_id AS passer_id, coalesce({micro('s.shot_xg')}, 0) AS xg, s.shot_outcome = 'Goal' AS goal
  FROM effective s JOIN ball_events b USING (match_id, event_id) LEFT JOIN effective p ON p.match_id = s.match_id AND p.event_id = b.shot_key_pass_id AND p.type = 'Pass'
  WHERE s.type = 'Shot' AND s.period < 5 AND b.shot_key_pass_id IS NOT NULL"""

# ---- possession chains
CHAINS = f"""SELECT match_id, chain, period, possession, own_team AS team_id, count(*) AS events, {{n("type = 'Pass' AND pass_outcome = 'Complete'")}} AS passes, {{n("type = 'Shot'")}} AS shots,
   {{n("type = 'Shot' AND shot_outcome = 'Goal'")}} AS goals, coalesce(sum({micro('shot_xg')}) FILTER (WHERE team_id = own_team AND type = 'Shot'), 0) / 1e6 AS xg0,
   min(clock) AS start, max(clock) - min(clock) AS seconds, coalesce(max(o) FILTER (WHERE team_id = own_team) = max(o) FILTER (WHERE team_id = own_team AND type = 'Shot'), FALSE) AS ends_in_shot
   FROM owned GROUP BY ALL"""


def _chains_sql(query):
    order = "minute, second, idx, event_id"
    n = lambda cond: f"count(*) FILTER (WHERE team_id = own_team AND {cond})"
    body = CHAINS
    for cond in ("type = 'Pass' AND pass_outcome = 'Complete'", "type = 'Shot'", "type = 'Shot' AND shot_outcome = 'Goal'"):
        body = body.replace('{n("' + cond + '")}', n(cond))
    return with_views(query, "match_events",
        flagged=f"SELECT *, CASE WHEN lag(possession) OVER (PARTITION BY match_id, period ORDER BY {order}) IS DISTINCT FROM possession THEN 1 ELSE 0 END AS b FROM match_events WHERE possession IS NOT NULL AND period < 5",
        numbered=f"SELECT *, {long('sum(b) OVER (PARTITION BY match_id ORDER BY period, ' + order + ')')} AS chain, CAST(minute * 60 + second AS BIGINT) AS clock, CAST(minute * 60 + second AS BIGINT) * 4294967296 + idx AS o FROM flagged",
        owned="SELECT *, first_value(team_id) OVER (PARTITION BY match_id, chain ORDER BY o, team_id) AS own_team FROM numbered WHERE team_id IS NOT NULL",
        chains=f"SELECT * EXCLUDE (xg0), {half_up('xg0', 4)} AS xg FROM ({body})")


# ---- packing
def _packing(spark, d):
    e, f = table(spark, d, "ball_events"), table(spark, d, "frames")
    return PK.packing(PK.with_frames(e, f))


def packing(spark, d):
    unknown = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return _packing(spark, d).select("match_id", "event_id", "team_id", "player_id", unknown("packed"), unknown("through"))


T = "least(greatest(((f.x - e.x) * (e.end_x - e.x) + (f.y - e.y) * (e.end_y - e.y)) / ((e.end_x - e.x) * (e.end_x - e.x) + (e.end_y - e.y) * (e.end_y - e.y)), 0e0), 1e0)"
OX, OY = f"(f.x - e.x - {T} * (e.end_x - e.x))", f"(f.y - e.y - {T} * (e.end_y - e.y))"
OUT = "e.pass_outcome = 'Complete' AND NOT f.teammate AND NOT f.keeper AND f.x > e.x AND f.x <= e.end_x"
PACKED = f"""SELECT e.match_id, e.event_id, e.team_id, e.player_id, CASE WHEN count(f.slot) = 0 THEN -1 ELSE count(*) FILTER (WHERE {OUT}) END AS packed,
  CASE WHEN count(f.slot) = 0 THEN -1 ELSE count(*) FILTER (WHERE {OUT} AND {OX} * {OX} + {OY} * {OY} <= 9e0) END AS through
  FROM ball_events e LEFT JOIN frames f USING (match_id, event_id) WHERE e.type = 'Pass' GROUP BY ALL"""


# ---- facts from several feeds
ROLES = {FD.FEED: CF.OFFICIAL, "statsbomb": CF.DEEP, AF.FEED: CF.OTHER}


def _sheets(spark, d, feed):
    """Starters of each match; the second feed misses some, and is later in every second match."""
    p = table(spark, d, "match_events").groupBy("match_id", "player_id").agg((F.min("idx") < 60).alias("started"))
    p = p.join(table(spark, d, "matches").select("match_id", "match_date"), "match_id")
    if feed == AF.FEED:
        p = p.filter("player_id % 11 <> match_id % 11")
        hour = F.when(F.col("match_id") % 2 == 0, " 11:00:00").otherwise(" 09:00:00")
    else:
        hour = F.lit(" 10:00:00")
    return p.withColumn("updated_at", F.concat("match_date", hour).cast("timestamp"))


def _facts(spark, d) -> DataFrame:
    m, sides = table(spark, d, "matches"), table(spark, d, "matches").select("match_id", *[F.col(c).cast("string").alias(c) for c in ("home_id", "away_id")])
    official, other = IN.raw_matches(spark, d), IN.raw_api_football(spark, d)
    text = C.effective(spark, d).withColumn("team_id", F.col("team_id").cast("string"))
    local = F.concat("match_date", F.lit("T"), "kick_off", F.when(F.col("match_id") % 3 == 0, "-01:00").otherwise("Z"))
    return once(spark, d, "feed-facts", lambda: reduce(DataFrame.unionByName, [
        CF.score_facts(FD.events(official), sides, FD.FEED), CF.score_facts(text, sides, "statsbomb"),
        CF.score_facts(AF.events(other), sides, AF.FEED, AF.corrections(other).select("match_id", F.col("supersedes").alias("event_id"))),
        CF.kickoff_facts(official.withColumnRenamed("id", "match_id"), F.col("utcDate"), FD.FEED), CF.kickoff_facts(m, local, "statsbomb"),
        CF.lineup_facts(_sheets(spark, d, "statsbomb"), "statsbomb"), CF.lineup_facts(_sheets(spark, d, AF.FEED), AF.FEED)]))


def _settled(spark, d):
    return CF.settled(CF.standing(_facts(spark, d), ROLES))


def _log(spark, d):
    said = CF.standing(_facts(spark, d), ROLES)
    return CF.conflicts(said, CF.settled(said))


AFK = """SELECT v.i, v.match_id, arg_max(g.event_id, g.idx) AS event_id FROM afr v JOIN afe g ON g.match_id = v.match_id AND g.team_id = CAST(v.team_id AS VARCHAR)
  AND g.shot_outcome = 'Goal' AND g.idx < v.i AND g.minute <= v.minute WHERE v.kind = 'Var' AND v.detail = 'Goal cancelled' GROUP BY v.i, v.match_id"""


def _score(feed, rows):
    h, a = "CAST(team_id AS VARCHAR) = CAST(m.home_id AS VARCHAR)", "CAST(team_id AS VARCHAR) <> CAST(m.home_id AS VARCHAR)"
    g, o = "e.type = 'Shot' AND e.shot_outcome = 'Goal'", "e.type = 'Own Goal Against'"
    return f"""SELECT CAST(match_id AS BIGINT) AS match_id, 'score' AS fact, '{feed}' AS feed, concat(count(*) FILTER (WHERE ({g} AND {h}) OR ({o} AND {a})), '-', count(*) FILTER (WHERE ({g} AND {a}) OR ({o} AND {h}))) AS value,
      CAST(NULL AS TIMESTAMP) AS updated_at FROM {rows} e JOIN matches m USING (match_id) GROUP BY match_id"""


def _sheet(feed, keep, hour):
    return f"""SELECT CAST(match_id AS BIGINT), 'lineup', '{feed}', string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY CAST(player_id AS VARCHAR)), CAST(concat(any_value(match_date), {hour}) AS TIMESTAMP)
      FROM (SELECT match_id, player_id FROM match_events GROUP BY ALL HAVING min(idx) < 60) p JOIN matches m USING (match_id) WHERE {keep} GROUP BY match_id"""


def _facts_sql(query):
    return C.sql(query, afr=IN.AFSQL, afe=IN.AFE, afk=AFK,
        facts=f"""{_score(FD.FEED, f"(SELECT * FROM match_events WHERE ({IN.GOALW}) OR card IS NOT NULL OR type = 'Substitution')")}
          UNION ALL {_score('statsbomb', '(SELECT * EXCLUDE (home_id, away_id) FROM effective WHERE period < 5)')}
          UNION ALL {_score(AF.FEED, '(SELECT * FROM afe WHERE event_id NOT IN (SELECT event_id FROM afk))')}
          UNION ALL SELECT CAST(match_id AS BIGINT), 'kickoff', '{FD.FEED}', concat(match_date, ' ', left(kick_off, 5)), NULL FROM matches
          UNION ALL SELECT CAST(match_id AS BIGINT), 'kickoff', 'statsbomb', strftime(CAST(concat(match_date, ' ', kick_off) AS TIMESTAMP) + CASE WHEN match_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M'), NULL FROM matches
          UNION ALL {_sheet('statsbomb', 'TRUE', "' 10:00:00'")}
          UNION ALL {_sheet(AF.FEED, 'player_id % 11 <> match_id % 11', "CASE WHEN match_id % 2 = 0 THEN ' 11:00:00' ELSE ' 09:00:00' END")}""",
        best=f"""SELECT *, row_number() OVER (PARTITION BY match_id, fact ORDER BY CASE WHEN fact = 'lineup' THEN 0 WHEN feed = '{FD.FEED}' THEN 0 WHEN feed = 'statsbomb' THEN 1 ELSE 2 END, updated_at DESC NULLS LAST, feed) AS place,
          count(*) OVER (PARTITION BY match_id, fact) AS feeds FROM facts""",
        believed="SELECT b.match_id, b.fact, b.feed, b.value, b.feeds, (SELECT count(DISTINCT value) FROM facts f WHERE f.match_id = b.match_id AND f.fact = b.fact) AS \"values\" FROM best b WHERE place = 1",
        lost="SELECT f.match_id, f.fact, f.feed, f.value, k.feed AS kept_feed, k.value AS kept FROM facts f JOIN believed k USING (match_id, fact) WHERE f.value <> k.value")


QUERIES = {
    "xt_grid": xt_grid,
    "xt_players": xt_players,
    "xa_players": lambda s, d: CR.players(_created(s, d)),
    "xa_balance": lambda s, d: CR.balance(_created(s, d)),
    "possession_chains": lambda s, d: CN.chains(table(s, d, "match_events")),
    "chain_teams": lambda s, d: CN.teams(CN.chains(table(s, d, "match_events"))),
    "packing": packing,
    "packing_players": lambda s, d: PK.players(_packing(s, d)),
    "feed_facts": _settled,
    "feed_conflicts": lambda s, d: CF.counted(_log(s, d)),
    "feed_conflict_log": _log,
    "event_log_player": lambda s, d: SH.event_page(table(s, d, "match_events"), player_id=103, period=2, limit=200).select(*A.PAGE_COLS),
}

ORACLE = {
    "xt_grid": _xt("SELECT * FROM grid"),
    "xt_players": _xt(f"""SELECT player_id, count(*) AS moves, {half_up('CAST(sum(CAST(b.value - a.value AS HUGEINT)) AS DOUBLE) / 1e9', 6)} AS xt,
        {half_up('CAST(sum(CAST(greatest(b.value - a.value, 0) AS HUGEINT)) AS DOUBLE) / 1e9', 6)} AS xt_gained
        FROM acts JOIN grid a ON a.zone = acts.zone JOIN grid b ON b.zone = acts."to" WHERE player_id IS NOT NULL GROUP BY player_id"""),
    "xa_players": C.sql(f"SELECT passer_id AS player_id, count(*) AS chances, count(*) FILTER (WHERE goal) AS assists, {half_up('sum(xg) / 1e6', 4)} AS xa FROM ({MADE}) WHERE passer_id IS NOT NULL GROUP BY 1", "ball_events"),
    "xa_balance": C.sql(f"""SELECT count(passer_id) AS attributed, count(*) - count(passer_id) AS unattributed, CAST(sum(xg) AS BIGINT) AS xg_micro,
        CAST(coalesce(sum(xg) FILTER (WHERE passer_id IS NOT NULL), 0) AS BIGINT) AS xa_micro, CAST(coalesce(sum(xg) FILTER (WHERE passer_id IS NULL), 0) AS BIGINT) AS nobody_micro FROM ({MADE})""", "ball_events"),
    "possession_chains": _chains_sql("SELECT * FROM chains"),
    "chain_teams": _chains_sql(f"""SELECT team_id, count(*) AS chains, count(*) FILTER (WHERE ends_in_shot) AS ending_in_shot, {half_up('count(*) FILTER (WHERE ends_in_shot) / count(*)', 4)} AS share,
        {half_up('sum(passes) / count(*)', 3)} AS passes_per_chain FROM chains GROUP BY team_id"""),
    "packing": with_views(PACKED, "ball_events", "frames"),
    "packing_players": with_views(f"""SELECT player_id, count(*) AS passes_seen, CAST(sum(packed) AS BIGINT) AS packed, CAST(sum(through) AS BIGINT) AS through, {half_up('sum(packed) / count(*)', 3)} AS per_pass
        FROM ({PACKED}) WHERE packed >= 0 AND player_id IS NOT NULL GROUP BY player_id""", "ball_events", "frames"),
    "feed_facts": _facts_sql('SELECT *, "values" > 1 AS conflict FROM believed'),
    "feed_conflicts": _facts_sql("SELECT fact, kept_feed, feed, count(*) AS conflicts, count(DISTINCT match_id) AS matches FROM lost GROUP BY ALL"),
    "feed_conflict_log": _facts_sql("SELECT * FROM lost"),
    "event_log_player": with_views(f"SELECT {', '.join(A.PAGE_COLS)} FROM match_events WHERE player_id = 103 AND period = 2 ORDER BY match_id, idx LIMIT 200", "match_events"),
}
