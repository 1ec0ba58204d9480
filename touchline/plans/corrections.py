"""Registered queries: the log, corrections and match state."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import pitch as P
from touchline.operators import log as LG
from touchline.operators import state as ST
from touchline.plans.fixture import half_up, long, micro, table, with_views


def _inputs(spark, d):
    return table(spark, d, "match_events"), table(spark, d, "corrections"), table(spark, d, "matches")


def verdicts(spark, d):
    return LG.resolve(LG.distinct_corrections(table(spark, d, "corrections")))


def corrected(spark, d):
    return LG.corrected_events(table(spark, d, "match_events"), verdicts(spark, d))


def effective(spark, d):
    return LG.effective_events(table(spark, d, "match_events"), verdicts(spark, d))


def sides(spark, d):
    return ST.sides_for(table(spark, d, "match_events"), table(spark, d, "matches"))


# ---- checking SQL shared with later phases
CK = "(period, decided_at_minute, correction_id)"
AM = "kind IN ('reassign', 'amend')"
VERDICTS = f"""SELECT match_id, supersedes AS event_id,
  coalesce(arg_max(kind = 'disallow', {CK}) FILTER (WHERE kind IN ('disallow', 'reinstate')), FALSE) AS disallowed,
  arg_max(kind, {CK}) AS last_kind, arg_max(reason, {CK}) AS reason, arg_max(authority, {CK}) AS authority,
  arg_max(decided_at_minute, {CK}) AS decided_at_minute, bool_or(synthesised) AS synthesised, count(*) AS n_corrections,
  arg_max(new_player_id, {CK}) FILTER (WHERE {AM} AND new_player_id IS NOT NULL) AS new_player_id,
  arg_max(new_player, {CK}) FILTER (WHERE {AM} AND new_player_id IS NOT NULL) AS new_player,
  arg_max(new_team_id, {CK}) FILTER (WHERE {AM} AND new_team_id IS NOT NULL) AS new_team_id,
  arg_max(new_minute, {CK}) FILTER (WHERE {AM} AND new_minute IS NOT NULL) AS new_minute,
  arg_max(new_xg, {CK}) FILTER (WHERE {AM} AND new_xg IS NOT NULL) AS new_xg
  FROM corrections GROUP BY match_id, supersedes"""
CORRECTED = """SELECT e.* REPLACE (coalesce(v.new_player_id, e.player_id) AS player_id,
    CASE WHEN v.new_player_id IS NOT NULL THEN v.new_player ELSE e.player END AS player,
    CASE WHEN type = 'Shot' AND v.new_xg IS NOT NULL THEN v.new_xg ELSE e.shot_xg END AS shot_xg),
  e.minute AS order_minute, coalesce(v.disallowed, FALSE) AS disallowed, v.last_kind AS correction_kind,
  v.reason AS correction_reason, v.authority AS correction_authority, v.decided_at_minute AS corrected_at,
  coalesce(v.synthesised, FALSE) AS correction_synthesised
  FROM match_events e LEFT JOIN verdicts v USING (match_id, event_id)"""
EFFECTIVE = """SELECT * REPLACE (CASE WHEN disallowed AND type = 'Shot' AND shot_outcome = 'Goal' THEN 'Goal (disallowed)' ELSE shot_outcome END AS shot_outcome) FROM corrected"""


def sql(query, *more, **extra):
    """Checking SQL over the corrected log."""
    return with_views(query, "match_events", "corrections", "matches", *more,
                      verdicts=VERDICTS, corrected=CORRECTED, effective=EFFECTIVE, **extra)


def _twice(df):
    return df.unionByName(df)


def log_union(spark, d):
    e, k, _ = _inputs(spark, d)
    return LG.log_records(e, k).groupBy("match_id", "kind_of_record").agg(F.count(F.lit(1)).alias("n"))


def log_dedup(spark, d):
    """Everything delivered twice, in another order: the same set of records."""
    e, k, _ = _inputs(spark, d)
    e2, k2 = LG.distinct_events(_twice(e)), LG.distinct_corrections(_twice(k))
    return LG.log_records(e2, k2).groupBy("match_id", "kind_of_record").agg(F.count(F.lit(1)).alias("n"))


def log_size(spark, d):
    e, k, _ = _inputs(spark, d)
    return LG.log_size(LG.distinct_events(_twice(e)), _twice(k))


def resolve(spark, d):
    v = LG.resolve(LG.distinct_corrections(_twice(table(spark, d, "corrections"))))
    return v.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("new_player_id", "new_team_id", "new_minute")})


def correction_history(spark, d):
    return LG.history(LG.distinct_corrections(_twice(table(spark, d, "corrections"))))


EFF_COLS = ["match_id", "event_id", "type", "team_id", "player_id", "player", "minute", "order_minute", "shot_xg", "shot_outcome", "disallowed"]


def canonical_order(spark, d):
    """Position of every scoring event in match order (47' of the first half
    comes before 45' of the second)."""
    from pyspark.sql import Window

    e = table(spark, d, "match_events").filter(P.is_shot() | P.is_own_goal())
    w = Window.partitionBy("match_id").orderBy(*P.EVENT_ORDER)
    return e.select("match_id", "event_id", "period", "minute", F.row_number().over(w).alias("n"))


def canonical_sort(spark, d):
    e = table(spark, d, "match_events")
    return e.orderBy("match_id", *P.EVENT_ORDER).select("match_id", *P.EVENT_ORDER, "type")


def match_state(spark, d):
    return ST.match_state(corrected(spark, d), sides(spark, d))


SCORE_COLS = ["match_id", "home_id", "away_id", "home_score", "away_score", "home_half_time", "away_half_time", "shootout",
              "home_shootout", "away_shootout", "home_red_cards", "away_red_cards", "scoreline"]
CLOCK_COLS = ["match_id", "period", "minute", "second", "status", "clock"]
STAT_COLS = ["match_id"] + [f"{s}_{c}" for c in (*ST.STATS, "xg", "pass_accuracy") for s in ("home", "away")]


def team_stats(spark, d):
    st = match_state(spark, d).select(*STAT_COLS)
    for s in ("home", "away"):
        st = st.withColumns({f"{s}_xg": F.round(f"{s}_xg", 6), f"{s}_pass_accuracy": _r(f"{s}_pass_accuracy", 4)})
    return st


def _r(c, n):
    from touchline.functions.numeric import half_up as h

    return h(c, n)


def possession(spark, d):
    return match_state(spark, d).select("match_id", _r("possession_home", 4).alias("possession_home"))


def live_status(spark, d):
    """Clock and status part-way through: the log cut at the first-half whistle."""
    e, k, m = _inputs(spark, d)
    e, k = LG.as_of(e, k, 1, 47)
    c = LG.corrected_events(e, LG.resolve(LG.distinct_corrections(k)))
    return ST.match_state(c, ST.sides_for(e, m)).select(*CLOCK_COLS)


def scheduled(spark, d):
    e, k, m = _inputs(spark, d)
    c = LG.corrected_events(e.filter(F.col("match_id") % 3 != 0), LG.resolve(k))
    st = ST.match_state(c, ST.sides_for(e, m))
    return ST.scheduled(m, st).select("match_id", "status", "home_score", "away_score")


GOAL_COLS = ["match_id", "event_id", "period", "minute", "second", "team_id", "home", "scorer", "scorer_id", "shot_type", "own_goal",
             "disallowed", "correction_reason", "correction_authority", "corrected_at", "correction_synthesised"]


def goals(spark, d):
    g = ST.goals(corrected(spark, d), sides(spark, d))
    g = g.withColumn("corrected_at", F.coalesce("corrected_at", F.lit(-1)))
    return g.select(*GOAL_COLS, F.round("xg", 6).alias("xg"))


def cards(spark, d):
    return ST.cards(corrected(spark, d), sides(spark, d))


def card_corrections(spark, d):
    """A disallowed card is left out of the list."""
    e, k, m = _inputs(spark, d)
    ruled = e.filter(F.col("card").isNotNull() & (F.col("event_id") % 2 == 0)).select(
        F.concat(F.lit("card-"), F.col("event_id").cast("string")).alias("correction_id"), "match_id",
        F.col("event_id").alias("supersedes"), F.lit("disallow").alias("kind"), F.lit("Mistaken identity").alias("reason"),
        F.lit("referee").alias("authority"), "period", F.col("minute").alias("decided_at_minute"), F.lit(False).alias("synthesised"))
    both = k.unionByName(ruled, allowMissingColumns=True)
    c = LG.corrected_events(e, LG.resolve(LG.distinct_corrections(both)))
    return ST.cards(c, ST.sides_for(e, m))


def named_results(spark, d):
    st = match_state(spark, d).select("match_id", "home_score", "away_score", "status")
    return ST.with_names(st, table(spark, d, "matches")).select(
        "match_id", "home_score", "away_score", "status", "home", "away", "match_date", "stage", "season_id")


def _changes(spark, d):
    e, k, m = _inputs(spark, d)
    return ST.score_changes(e, LG.distinct_corrections(k), ST.sides_for(e, m))


def score_at_fold(spark, d):
    """State at (2, 60') by folding the log cut there."""
    e, k, m = _inputs(spark, d)
    e, k = LG.as_of(e, k, 2, 60)
    c = LG.corrected_events(e, LG.resolve(LG.distinct_corrections(k)))
    return ST.match_state(c, ST.sides_for(e, m)).select("match_id", "home_score", "away_score", "scoreline")


def archived_score_at(spark, d):
    return ST.archived_score_at(ST.goals(corrected(spark, d), sides(spark, d)), 2, 60)


QUERIES = {
    "log_union": log_union,
    "log_dedup": log_dedup,
    "log_version": log_size,
    "resolve": resolve,
    "correction_history": correction_history,
    "superseded": lambda s, d: LG.superseded(verdicts(s, d)),
    "corrected_events": lambda s, d: corrected(s, d).select(*EFF_COLS),
    "effective_events": lambda s, d: effective(s, d).select(*EFF_COLS),
    "canonical_order": canonical_order,
    "canonical_sort": canonical_sort,
    "sides_discovered": lambda s, d: ST.discover_sides(table(s, d, "match_events")),
    "sides_without_lineups": lambda s, d: ST.discover_sides(table(s, d, "match_events").filter("type <> 'Starting XI'")),
    "match_score": lambda s, d: match_state(s, d).select(*SCORE_COLS),
    "match_clock_status": lambda s, d: match_state(s, d).select(*CLOCK_COLS),
    "match_status_half_time": live_status,
    "match_status_scheduled": scheduled,
    "match_team_stats": team_stats,
    "match_possession": possession,
    "match_goals": goals,
    "match_cards": cards,
    "match_cards_corrected": card_corrections,
    "match_named_results": named_results,
    "score_changes": _changes,
    "score_at": lambda s, d: ST.score_at(_changes(s, d), 2, 60),
    "score_at_fold": score_at_fold,
    "score_at_archived": archived_score_at,
    "score_ever": lambda s, d: ST.ever(_changes(s, d), 2, 1),
}

# ---- checking SQL
SIDES = "(SELECT match_id, home_id AS h, away_id AS a FROM matches)"
DEF = ", ".join(f"'{t}'" for t in ST.DEFENSIVE)
PLAY = "NOT (type = 'Shot' AND period = 5)"
OK_GOAL = "type = 'Shot' AND shot_outcome = 'Goal' AND period <> 5 AND NOT disallowed"
OK_OWN = "type = 'Own Goal Against' AND NOT disallowed"


def n(cond):
    return f"count(*) FILTER (WHERE {cond})"


STATE = f"""SELECT c.match_id, min(c.home_id) AS home_id, min(c.away_id) AS away_id,
  {n(f"({OK_GOAL} AND team_id = home_id) OR ({OK_OWN} AND team_id <> home_id)")} AS home_score,
  {n(f"({OK_GOAL} AND team_id = away_id) OR ({OK_OWN} AND team_id = home_id)")} AS away_score,
  {n(f"period = 1 AND (({OK_GOAL} AND team_id = home_id) OR ({OK_OWN} AND team_id <> home_id))")} AS home_half_time,
  {n(f"period = 1 AND (({OK_GOAL} AND team_id <> home_id) OR ({OK_OWN} AND team_id = home_id))")} AS away_half_time,
  {n("type = 'Shot' AND period = 5")} > 0 AS shootout,
  {n("type = 'Shot' AND period = 5 AND shot_outcome = 'Goal' AND team_id = home_id")} AS home_shootout,
  {n("type = 'Shot' AND period = 5 AND shot_outcome = 'Goal' AND team_id = away_id")} AS away_shootout,
  {n(f"card IN ('Red Card', 'Second Yellow') AND NOT disallowed AND team_id = home_id")} AS home_red_cards,
  {n(f"card IN ('Red Card', 'Second Yellow') AND NOT disallowed AND team_id = away_id")} AS away_red_cards,
  max((period, order_minute, second, idx, event_id, minute, type)) AS last,
  max((period, order_minute, second, idx, event_id, type)) FILTER (WHERE (type = 'Half End' AND period = 1) OR type = 'Half Start') AS marker
  FROM corrected c GROUP BY c.match_id"""
SCORELINE = """concat(home_score, '-', away_score, CASE WHEN home_shootout > 0 OR away_shootout > 0 THEN concat(' (', home_shootout, '-', away_shootout, ' on penalties)') ELSE '' END)"""
LAST = """arg_max(period, o) AS period, arg_max(minute, o) AS minute, arg_max(second, o) AS second,
  CASE WHEN arg_max(type, o) = 'Half End' AND arg_max(period, o) >= 2 THEN 'finished'
       WHEN arg_max(type, o) FILTER (WHERE (type = 'Half End' AND period = 1) OR type = 'Half Start') = 'Half End' THEN 'half_time' ELSE 'live' END AS status,
  CASE WHEN arg_max(period, o) = 5 THEN 'PENS' ELSE concat(arg_max(minute, o), '''') END AS clock"""

CLOCKS = f"SELECT match_id, {LAST} FROM (SELECT *, (period, order_minute, second, idx, event_id) AS o FROM corrected) GROUP BY match_id"


def _side_stats(side, test):
    cond = {
        "shots": f"type = 'Shot' AND {PLAY}",
        "on_target": f"type = 'Shot' AND {PLAY} AND shot_outcome IN ('Goal', 'Saved', 'Saved to Post')",
        "passes": "type = 'Pass'", "passes_completed": "type = 'Pass' AND pass_outcome = 'Complete'",
        "final_third_passes": "type = 'Pass' AND end_x >= 80",
        "defensive_actions_opp_half": f"type IN ({DEF}) AND x >= 48",
        "corners": "type = 'Pass' AND pass_type = 'Corner'", "fouls": "type = 'Foul Committed'",
        "yellows": "card = 'Yellow Card' AND NOT disallowed", "reds": "card IN ('Red Card', 'Second Yellow') AND NOT disallowed",
    }
    parts = [f"{n(f'{test} AND {c}')} AS {side}_{k}" for k, c in cond.items()]
    sxg = micro("shot_xg")
    parts.append(f"round(coalesce(sum({sxg}) FILTER (WHERE {test} AND type = 'Shot' AND {PLAY}), 0) / 1e6, 6) AS {side}_xg")
    comp, allp = n(f"{test} AND {cond['passes_completed']}"), n(f"{test} AND {cond['passes']}")
    parts.append(f"{half_up(f'coalesce({comp} / nullif({allp}, 0), 0)', 4)} AS {side}_pass_accuracy")
    return ", ".join(parts)


GOALS = """SELECT match_id, event_id, period, minute, second, order_minute, idx, CASE WHEN type = 'Shot' THEN team_id WHEN team_id = home_id THEN away_id ELSE home_id END AS team_id,
  (CASE WHEN type = 'Shot' THEN team_id WHEN team_id = home_id THEN away_id ELSE home_id END) = home_id AS home,
  player AS scorer, player_id AS scorer_id, CASE WHEN type = 'Shot' THEN shot_type ELSE 'Own Goal' END AS shot_type, type <> 'Shot' AS own_goal,
  disallowed, correction_reason, correction_authority, corrected_at, correction_synthesised, CASE WHEN type = 'Shot' THEN round(shot_xg, 6) END AS xg
  FROM corrected WHERE (type = 'Shot' AND shot_outcome = 'Goal' AND period <> 5) OR type = 'Own Goal Against'"""
# every minute of every match, folded afresh: the slow but obvious way
MOMENTS = """SELECT DISTINCT match_id, period, minute FROM match_events
  UNION SELECT match_id, period, decided_at_minute FROM corrections"""
AS_OF = """SELECT t.match_id, t.period, t.minute,
   count(*) FILTER (WHERE (g.own AND g.team_id <> g.home_id) OR (NOT g.own AND g.team_id = g.home_id)) AS home,
   count(*) FILTER (WHERE (g.own AND g.team_id = g.home_id) OR (NOT g.own AND g.team_id = g.away_id)) AS away
  FROM moments t LEFT JOIN (
    SELECT match_id, event_id, period, minute, team_id, home_id, away_id, type <> 'Shot' AS own FROM match_events
    WHERE (type = 'Shot' AND shot_outcome = 'Goal' AND period <> 5) OR type = 'Own Goal Against') g
   ON g.match_id = t.match_id AND (g.period, g.minute) <= (t.period, t.minute) AND NOT coalesce((
      SELECT arg_max(k.kind = 'disallow', (k.period, k.decided_at_minute, k.correction_id)) FROM corrections k
      WHERE k.match_id = g.match_id AND k.supersedes = g.event_id AND k.kind IN ('disallow', 'reinstate')
        AND (k.period, k.decided_at_minute) <= (t.period, t.minute)), FALSE)
  GROUP BY t.match_id, t.period, t.minute"""
CHANGES = """SELECT match_id, period, minute, home, away FROM (
   SELECT *, lag(home, 1, 0) OVER w AS ph, lag(away, 1, 0) OVER w AS pa FROM as_of WINDOW w AS (PARTITION BY match_id ORDER BY period, minute))
  WHERE home <> ph OR away <> pa"""


def _moments(q):
    return sql(q, moments=MOMENTS, as_of=AS_OF, changes=CHANGES)


COUNT_BY = """SELECT match_id, 'event' AS kind_of_record, count(*) AS n FROM match_events GROUP BY match_id
  UNION ALL SELECT match_id, 'correction', count(*) FROM corrections GROUP BY match_id"""
_EFF = ", ".join(EFF_COLS)
_CARDS = "SELECT match_id, event_id, period, minute, team_id, team_id = home_id AS home, player, card, card <> 'Yellow Card' AS is_red FROM corrected WHERE card IS NOT NULL"
ORACLE = {
    "log_union": sql(COUNT_BY),
    "log_dedup": sql(COUNT_BY),
    "log_version": sql(f"""SELECT e.match_id, e.n + 2 * coalesce(k.n, 0) AS version, 2 * coalesce(k.n, 0) AS n_corrections, coalesce(g.n, 0) AS n_superseded
      FROM (SELECT match_id, count(*) AS n FROM match_events GROUP BY match_id) e
      LEFT JOIN (SELECT match_id, count(*) AS n FROM corrections GROUP BY match_id) k USING (match_id)
      LEFT JOIN (SELECT match_id, {n('disallowed')} AS n FROM verdicts GROUP BY match_id) g USING (match_id)"""),
    "resolve": sql("""SELECT * REPLACE (coalesce(new_player_id, -1) AS new_player_id, coalesce(new_team_id, -1) AS new_team_id, coalesce(new_minute, -1) AS new_minute),
       CAST(NULL AS VARCHAR) AS new_team FROM verdicts"""),
    "correction_history": sql("SELECT match_id, supersedes AS event_id, period, decided_at_minute, correction_id, kind, reason, authority, synthesised FROM corrections"),
    "superseded": sql("SELECT match_id, event_id FROM verdicts WHERE disallowed"),
    "corrected_events": sql(f"SELECT {_EFF} FROM corrected"),
    "effective_events": sql(f"SELECT {_EFF} FROM effective"),
    "canonical_order": sql("""SELECT match_id, event_id, period, minute, CAST(row_number() OVER (PARTITION BY match_id ORDER BY period, minute, second, idx, event_id) AS INT) AS n
       FROM match_events WHERE type IN ('Shot', 'Own Goal Against')"""),
    "canonical_sort": sql("SELECT match_id, period, minute, second, idx, event_id, type FROM match_events"),
    "sides_discovered": sql("SELECT match_id, home_id, away_id FROM matches"),
    "sides_without_lineups": sql("""SELECT match_id, max(team_id) FILTER (WHERE r = 1) AS home_id, max(team_id) FILTER (WHERE r = 2) AS away_id FROM (
       SELECT match_id, team_id, row_number() OVER (PARTITION BY match_id ORDER BY k) AS r FROM (
         SELECT match_id, team_id, min((period, minute, second, idx, event_id)) AS k FROM match_events WHERE type <> 'Starting XI' GROUP BY match_id, team_id)) GROUP BY match_id"""),
    "match_score": sql(f"SELECT {', '.join(SCORE_COLS[:-1])}, {SCORELINE} AS scoreline FROM state", state=STATE),
    "match_clock_status": sql(CLOCKS),
    "match_status_half_time": sql(f"SELECT match_id, {LAST} FROM (SELECT *, (period, order_minute, second, idx, event_id) AS o FROM corrected WHERE period = 1) GROUP BY match_id"),
    "match_status_scheduled": sql("""SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'scheduled' ELSE status END AS status,
       CASE WHEN match_id % 3 = 0 THEN 0 ELSE home_score END AS home_score, CASE WHEN match_id % 3 = 0 THEN 0 ELSE away_score END AS away_score FROM state JOIN clocks USING (match_id)""", state=STATE, clocks=CLOCKS),
    "match_team_stats": sql(f"SELECT match_id, {_side_stats('home', 'team_id = home_id')}, {_side_stats('away', 'team_id <> home_id')} FROM corrected GROUP BY match_id"),
    "match_possession": sql(f"SELECT match_id, {half_up('count(*) FILTER (WHERE team_id = home_id) / count(team_id)', 4)} AS possession_home FROM corrected GROUP BY match_id"),
    "match_goals": sql(f"SELECT {', '.join(GOAL_COLS)}, xg FROM (SELECT * REPLACE (coalesce(corrected_at, -1) AS corrected_at) FROM goals)", goals=GOALS),
    "match_cards": sql(_CARDS),
    "match_cards_corrected": sql(_CARDS + " AND event_id % 2 <> 0"),
    "match_named_results": sql("SELECT match_id, home_score, away_score, status, home, away, match_date, stage, season_id FROM state JOIN clocks USING (match_id) JOIN matches USING (match_id)", state=STATE, clocks=CLOCKS),
    "score_changes": _moments("SELECT * FROM changes"),
    "score_at": _moments("""SELECT match_id, arg_max(home, (period, minute)) AS home, arg_max(away, (period, minute)) AS away FROM changes
       WHERE (period, minute) <= (2, 60) GROUP BY match_id"""),
    "score_at_fold": _moments("""SELECT match_id, home AS home_score, away AS away_score, concat(home, '-', away) AS scoreline FROM (
       SELECT match_id, arg_max(home, (period, minute)) AS home, arg_max(away, (period, minute)) AS away FROM as_of WHERE (period, minute) <= (2, 60) GROUP BY match_id)"""),
    "score_at_archived": sql(f"""SELECT match_id, {n('(period, minute) <= (2, 60) AND NOT disallowed AND home')} AS home,
       {n('(period, minute) <= (2, 60) AND NOT disallowed AND NOT home')} AS away, {n('(period, minute) <= (2, 60)')} AS goals_so_far FROM goals GROUP BY match_id""", goals=GOALS),
    "score_ever": _moments("""SELECT match_id, arg_min(period, (period, minute)) AS period, arg_min(minute, (period, minute)) AS minute
       FROM changes WHERE home = 2 AND away = 1 GROUP BY match_id"""),
}
