"""Registered queries: moments, reports, change messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import prose
from touchline.operators import changes as CH
from touchline.operators import log as LG
from touchline.operators import moments as MO
from touchline.operators import report as RP
from touchline.operators import features as FT
from touchline.operators import model as MD
from touchline.operators import state as ST
from touchline.operators import timeline as TL
from touchline.plans import corrections as C
from touchline.plans import match as M
from touchline.plans import probability as PR
from touchline.plans.fixture import half_up, once, table
from touchline.session import cut


def winners(spark, d):
    return once(spark, d, "winners", lambda: MO.winner(C.match_state(spark, d), table(spark, d, "matches")))


def _series(spark, d):
    return PR.series(spark, d)


def candidates(spark, d):
    return once(spark, d, "candidates", lambda: MO.candidates(
        table(spark, d, "match_events"), table(spark, d, "corrections"), _series(spark, d), winners(spark, d)))


def moments(spark, d):
    return MO.suppress_duplicates(MO.choose(candidates(spark, d)))


CAND = ["match_id", "event_id", "kind", "period", "minute", "home_after", "away_after", "mandatory", "shot_type", "detail", "synthesised"]


def _shown(m):
    return m.select(*CAND, F.coalesce("ruled_out_at", F.lit(-1)).alias("ruled_out_at"), F.round("swing", 4).alias("swing"))


def chosen(spark, d):
    return _shown(MO.choose(candidates(spark, d)))


def event_probabilities(spark, d):
    e = table(spark, d, "match_events").filter("type = 'Shot'").select("match_id", "event_id", "minute")
    return MO.with_probabilities(e, _series(spark, d))


def no_series(spark, d):
    """Without a series every event is bracketed by a third each."""
    e = table(spark, d, "match_events").filter("type = 'Shot'").select("match_id", "event_id", "minute")
    j = MO.with_probabilities(e, _series(spark, d).filter("match_id % 2 = 0"))
    return j.filter("match_id % 2 = 1").select("match_id", "event_id", *[F.round(f"{w}_{c}", 6).alias(f"{w}_{c}") for w in ("before", "after") for c in MD.CLASSES])


def _goals(spark, d):
    return ST.goals(C.corrected(spark, d), C.sides(spark, d))


def running_score(spark, d):
    return RP.running_score(_goals(spark, d)).select("match_id", "event_id", "period", "minute", "home_now", "away_now")


def _matches(spark, d):
    return table(spark, d, "matches").withColumn("competition", F.lit("La Liga"))


def reports(spark, d):
    w = winners(spark, d)
    m = cut(moments(spark, d), "moments")
    return RP.reports(w, _goals(spark, d), m, table(spark, d, "corrections"), _matches(spark, d))


def report_table(spark, d):
    r = reports(spark, d)
    return r.withColumns({"lines": F.array_join("lines", "\n"), "notes": F.array_join("notes", "\n"), "biggest_swing": F.round("biggest_swing", 4)})


def headlines(spark, d):
    w = winners(spark, d).join(_matches(spark, d).select("match_id", "competition", "match_date"), "match_id")
    return w.select("match_id", prose.headline().alias("headline"))


def candidate_lines(spark, d):
    """The sentence of every candidate, before any is dropped."""
    return RP.lines(candidates(spark, d)).select("match_id", "event_id", "kind", "line")


def live_ledes(spark, d):
    """Ledes written at 60' of the second half."""
    e, k, m = C._inputs(spark, d)
    e, k = LG.as_of(e, k, 2, 60)
    c = LG.corrected_events(e, LG.resolve(LG.distinct_corrections(k)))
    st = MO.winner(ST.match_state(c, ST.sides_for(e, m)), m)
    g = ST.goals(c, ST.sides_for(e, m))
    return RP.live_ledes(st, RP.ledes(g, st))


def notes(spark, d):
    return RP.notes(candidates(spark, d), table(spark, d, "corrections")).withColumn("notes", F.array_join("notes", "\n"))


def correction_headlines(spark, d):
    k = table(spark, d, "corrections")
    return k.select("match_id", "correction_id", prose.correction_headline(F.col("kind"), F.col("authority"), F.col("reason")).alias("headline"))


def _projection(spark, d, upto=None):
    """State, corrections, goals, timeline, series and report at one moment."""
    e, k, m = C._inputs(spark, d)
    if upto:
        e, k = LG.as_of(e, k, *upto)
    sd = ST.sides_for(e, m)
    v = LG.resolve(LG.distinct_corrections(k))
    c = LG.corrected_events(e, v)
    st = cut(MO.winner(ST.match_state(c, sd), m), "state")
    eff = LG.effective_events(e, v)
    f = FT.feature_rows(FT.minute_state(FT.minute_increments(eff, sd), sd))
    s = cut(MD.stand_in_series(f), "series")
    g = cut(ST.goals(c, sd), "goals")
    mo = cut(MO.suppress_duplicates(MO.choose(cut(MO.candidates(e, k, s, st), "moments"))), "moments")
    r = RP.reports(st, g, mo, k, _matches(spark, d))
    return {"state": st, "corrections": k, "goals": g, "timeline": TL.corrected_timeline(e, k, v, sd), "series": s, "report": r}


def change_messages(spark, d):
    """All messages between the log at the first-half whistle and the whole log."""
    b, a = _projection(spark, d, (1, 47)), _projection(spark, d)
    msgs = CH.corrections_applied(b["corrections"], a["corrections"], a["goals"], a["state"])
    for more in (CH.items_appended(b["timeline"], a["timeline"]), CH.states_changed(b["state"], a["state"]),
                 CH.probability_updated(b["state"], b["series"], a["state"], a["series"]), CH.reports_regenerated(b["report"], a["report"])):
        msgs = msgs.unionByName(more)
    return msgs


def _two_states(spark, d):
    e, k, m = C._inputs(spark, d)
    e1, k1 = LG.as_of(e, k, 1, 47)
    c1 = LG.corrected_events(e1, LG.resolve(LG.distinct_corrections(k1)))
    return ST.match_state(c1, ST.sides_for(e1, m)), C.match_state(spark, d), k1, k


def diff_corrections(spark, d):
    _, after, k1, k = _two_states(spark, d)
    return CH.corrections_applied(k1, k, _goals(spark, d), after).drop("rank")


def diff_timeline(spark, d):
    e, k, _ = C._inputs(spark, d)
    e1, _ = LG.as_of(e, k, 1, 47)
    return CH.items_appended(TL.timeline(e1), TL.timeline(e)).drop("rank")


def diff_state(spark, d):
    before, after, _, _ = _two_states(spark, d)
    return CH.states_changed(before, after).select("match_id", "type", "text")


def score_feed(spark, d):
    before, after, _, _ = _two_states(spark, d)
    return CH.score_feed(before, after)


QUERIES = {
    "winner": lambda s, d: winners(s, d).select("match_id", "winner", "winner_name"),
    "event_probabilities": event_probabilities,
    "event_probabilities_missing": no_series,
    "moment_candidates": lambda s, d: _shown(candidates(s, d)),
    "moments_chosen": chosen,
    "moments": lambda s, d: _shown(moments(s, d)),
    "biggest_swing": lambda s, d: MO.biggest_swing(candidates(s, d)).select("match_id", "event_id", "kind", "minute", F.round("swing", 4).alias("swing")),
    "running_score": running_score,
    "comeback": lambda s, d: RP.comeback(_goals(s, d), winners(s, d)),
    "lede": lambda s, d: RP.ledes(_goals(s, d), winners(s, d)).select("match_id", "lede"),
    "lede_live": live_ledes,
    "headline": headlines,
    "report_lines": candidate_lines,
    "report_closing": lambda s, d: RP.closing(candidates(s, d)).select("match_id", "closing"),
    "report_notes": notes,
    "report": report_table,
    "correction_headline": correction_headlines,
    "diff_corrections": diff_corrections,
    "diff_timeline": diff_timeline,
    "diff_state": diff_state,
    "score_feed": score_feed,
    "change_messages": change_messages,
}

O = "period, minute, second, idx, event_id"
WINNERS = """SELECT s.*, m.home, m.away, CASE WHEN shootout AND home_shootout > away_shootout THEN 0 WHEN shootout AND away_shootout > home_shootout THEN 2
   WHEN home_score > away_score THEN 0 WHEN away_score > home_score THEN 2 ELSE 1 END AS winner,
   CASE WHEN (shootout AND away_shootout > home_shootout) OR (NOT (shootout AND home_shootout > away_shootout) AND away_score > home_score) THEN m.away ELSE m.home END AS winner_name
   FROM state s JOIN matches m USING (match_id)"""
LASTK = f"""SELECT match_id, supersedes AS event_id, arg_max(kind, {C.CK}) AS k_kind, arg_max(reason, {C.CK}) AS k_reason, arg_max(decided_at_minute, {C.CK}) AS k_minute,
   arg_max(synthesised, {C.CK}) AS k_synth FROM corrections GROUP BY match_id, supersedes"""
BR = "SELECT match_id, minute AS mm, " + ", ".join(
    f"{c} AS before_{c}, coalesce(lead({c}) OVER (PARTITION BY match_id ORDER BY minute), {c}) AS after_{c}" for c in MD.CLASSES) + " FROM series"
_W = lambda p: f"CASE winner WHEN 0 THEN {p}_p_home WHEN 1 THEN {p}_p_draw ELSE {p}_p_away END"
CANDS = f"""SELECT q.* EXCLUDE (k), before_p_home, after_p_home, CASE WHEN k = 'goal' AND coalesce(k_kind = 'disallow', FALSE) THEN 'disallowed_goal' ELSE k END AS kind,
   {_W('before')} AS wb, {_W('after')} AS wa, abs({_W('after')} - ({_W('before')})) AS swing,
   k <> 'big_chance' AS mandatory, CASE WHEN own THEN 'Own Goal' WHEN k = 'red_card' THEN '' ELSE shot_type END AS stype,
   CASE WHEN k = 'goal' THEN coalesce(k_reason, '') WHEN k = 'red_card' THEN card ELSE shot_outcome END AS detail,
   CASE WHEN k = 'goal' AND k_kind = 'disallow' THEN k_minute ELSE -1 END AS ruled_out_at, k = 'goal' AND coalesce(k_synth, FALSE) AS synthesised,
   count(*) FILTER (WHERE k = 'goal' AND coalesce(k_kind <> 'disallow', TRUE) AND own <> (team_id = home_id)) OVER o AS home_after,
   count(*) FILTER (WHERE k = 'goal' AND coalesce(k_kind <> 'disallow', TRUE) AND own = (team_id = home_id)) OVER o AS away_after
   FROM (SELECT e.*, w.winner, w.winner_name, type = 'Own Goal Against' AS own, CASE WHEN (type = 'Shot' AND shot_outcome = 'Goal') OR type = 'Own Goal Against' THEN 'goal'
       WHEN card IN ('Red Card', 'Second Yellow') THEN 'red_card' WHEN type = 'Shot' AND shot_type = 'Penalty' THEN 'penalty_miss' WHEN shot_xg >= 0.3 THEN 'big_chance' END AS k
     FROM match_events e JOIN (SELECT match_id, winner, winner_name FROM winners) w USING (match_id) WHERE period <> 5) q
   LEFT JOIN lastk USING (match_id, event_id) LEFT JOIN br ON br.match_id = q.match_id AND br.mm = least(greatest(minute, 0), 90)
   WHERE k IS NOT NULL WINDOW o AS (PARTITION BY q.match_id ORDER BY {O})"""
CHOSEN = """SELECT * FROM cands WHERE mandatory UNION ALL SELECT * EXCLUDE (r, n_must) FROM (
   SELECT c.*, row_number() OVER (PARTITION BY c.match_id ORDER BY swing DESC, period, minute, second, idx, event_id) AS r, coalesce(n_must, 0) AS n_must FROM cands c
   LEFT JOIN (SELECT match_id, count(*) AS n_must FROM cands WHERE mandatory GROUP BY match_id) USING (match_id) WHERE NOT mandatory) WHERE r <= 8 - n_must"""
RUN = f"""SELECT *, count(*) FILTER (WHERE home) OVER w AS home_now, count(*) FILTER (WHERE NOT home) OVER w AS away_now FROM goals WHERE NOT disallowed AND period <= 4 WINDOW w AS (PARTITION BY match_id ORDER BY {O})"""
COMEBACK = f"""SELECT match_id, {C.long('coalesce(sum(minute) FILTER (WHERE lead >= 0 AND was < 0), 0) - coalesce(sum(minute) FILTER (WHERE lead < 0 AND was >= 0), 0) + CASE WHEN count(*) FILTER (WHERE lead < 0 AND was >= 0) > count(*) FILTER (WHERE lead >= 0 AND was < 0) THEN coalesce(arg_max(minute, (period, minute, second, idx, event_id)) FILTER (WHERE lead < 0 AND was >= 0), 0) ELSE 0 END')} AS trailed,
   coalesce(arg_max(minute, (period, minute, second, idx, event_id)) FILTER (WHERE lead = 1 AND own), 0) AS decisive FROM (
   SELECT *, coalesce(lag(lead) OVER (PARTITION BY match_id ORDER BY {O}), 0) AS was FROM (
     SELECT r.*, home = (home_score > away_score) AS own, CASE WHEN home_score > away_score THEN home_now - away_now ELSE away_now - home_now END AS lead
     FROM run r JOIN (SELECT match_id, home_score, away_score FROM winners) USING (match_id))) GROUP BY match_id"""
_S = "concat(home_score, '-', away_score)"


def _tpl(t, **v):
    """The SQL twin of prose.fill."""
    parts, rest = [], t
    q = lambda x: "'" + x.replace("'", "''") + "'"
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [q(text)] * bool(text) + [v[name]]
    return f"concat({', '.join(parts + [q(rest)] * bool(rest))})"


_lv = dict(winner="winner_name", score=_S, home="home", away="away", trailing="coalesce(trailed, 0)")
LEDE = "CASE WHEN shootout THEN {shootout} WHEN home_score = 0 AND away_score = 0 THEN {goalless} WHEN home_score = away_score THEN {draw} WHEN coalesce(trailed, 0) <> 0 THEN {comeback} WHEN abs(home_score - away_score) >= 3 THEN {comfortable} WHEN coalesce(decisive, 0) >= 80 THEN {late} WHEN abs(home_score - away_score) = 2 THEN {comfortable} ELSE {narrow} END".format(
    **{k: _tpl(t, **_lv) for k, t in prose.LEDES.items()})
LEDES = f"SELECT match_id, {LEDE} AS lede FROM winners LEFT JOIN comeback USING (match_id)"
PCT = lambda p: f"CAST(round_even({p} * 100, 0) AS INT)"
VERB = f"""CASE WHEN stype = 'Own Goal' THEN '{prose.VERB_OWN}' WHEN stype = 'Penalty' THEN '{prose.VERB_PENALTY}' WHEN {M.D0} >= 25 THEN '{prose.VERB_FAR}'
   WHEN shot_xg >= 0.4 THEN '{prose.VERB_CLOSE}' WHEN shot_xg <= 0.06 THEN '{prose.VERB_UNLIKELY}' WHEN stype = 'Free Kick' THEN '{prose.VERB_FREE_KICK}' ELSE '{prose.VERB_PLAIN}' END"""
CHANCE = "CASE detail " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prose.CHANCE.items()) + f" ELSE '{prose.CHANCE_OTHER}' END"
LINE = f"""SELECT match_id, event_id, kind, trim(concat(CASE kind
   WHEN 'goal' THEN concat(minute, ''' - ', player, ' ', {VERB}, ' to make it ', home_after, '-', away_after, '.')
   WHEN 'disallowed_goal' THEN concat(minute, ''' - ', player, ' put the ball in the net for ', team, ', but it was ruled out', CASE WHEN ruled_out_at > 0 THEN concat(' at ', ruled_out_at, '''') ELSE '' END, ': ', lower(detail), '. The score stayed ', home_after, '-', away_after, '.')
   WHEN 'red_card' THEN concat(minute, ''' - ', player, ' was sent off for ', team, CASE WHEN detail = 'Second Yellow' THEN ', a second yellow.' ELSE ', a straight red.' END)
   WHEN 'penalty_miss' THEN concat(minute, ''' - ', player, CASE WHEN contains(detail, 'Saved') THEN ' saved' ELSE ' missed' END, ' a penalty for ', team, '.')
   ELSE concat(minute, ''' - ', player, ' ', {CHANCE}, ' from a chance worth ', printf('%.2f', {half_up('shot_xg', 2)}), ' expected goals - the best ', team, ' had created.') END, ' ',
   CASE WHEN kind = 'disallowed_goal' OR abs(wa * 100 - wb * 100) < 3 THEN '' ELSE concat('That moved ', winner_name, ' from ', {PCT('wb')}, '% to ', {PCT('wa')}, '% to win.') END)) AS line FROM cands"""
LONG_DATE = "strftime(CAST(match_date AS DATE), '%-d %B %Y')"
HEADLINE = f"""SELECT match_id, concat(home, ' ', {_S}, ' ', away, CASE WHEN shootout THEN concat(' (', winner_name, ' win ', home_shootout, '-', away_shootout, ' on penalties)') ELSE '' END,
   ' - La Liga, ', {LONG_DATE}) AS headline FROM winners JOIN (SELECT match_id, match_date FROM matches) USING (match_id)"""
HEADK = "concat(CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prose.CORRECTION_VERB.items()) + " END, ' by ', CASE authority " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in prose.AUTHORITY.items()) + " END, ' - ', reason)"
NOTES = f"""SELECT match_id, concat_ws(chr(10), CASE WHEN late THEN '{prose.NOTE_EXTRA_TIME}' END, CASE WHEN fixed THEN '{prose.NOTE_CORRECTED}' END, CASE WHEN made_up THEN '{prose.NOTE_SYNTHESISED}' END) AS notes
   FROM (SELECT match_id, bool_or(period >= 3) AS late FROM cands GROUP BY match_id) FULL JOIN (SELECT match_id, TRUE AS fixed, bool_or(synthesised) AS made_up FROM corrections GROUP BY match_id) USING (match_id)"""
BIG = "SELECT c.* FROM cands c JOIN (SELECT match_id, arg_min(event_id, (-swing, period, minute, second, idx, event_id)) AS event_id FROM cands GROUP BY match_id) USING (match_id, event_id)"
CTES = dict(state=C.STATE, winners=WINNERS, lastk=LASTK, br=BR, cands=CANDS, goals=C.GOALS, run=RUN, comeback=COMEBACK)


def sql(q, **extra):
    return PR.sql(q, **CTES, **extra)


_C1 = C.CORRECTED.replace("FROM match_events e LEFT JOIN verdicts", "FROM (SELECT * FROM match_events WHERE {e}) e LEFT JOIN v1")
_V1 = C.VERDICTS.replace("FROM corrections", "FROM (SELECT * FROM corrections WHERE {k})")


def _as_of(p, m):
    return dict(v1=_V1.format(k=f"(period, decided_at_minute) <= ({p}, {m})"), c1=_C1.format(e=f"(period, minute) <= ({p}, {m})"),
                state1=C.STATE.replace("FROM corrected c", "FROM c1 c"), clocks1=C.CLOCKS.replace("FROM corrected)", "FROM c1)"), clocks=C.CLOCKS)


_STATUS = "(SELECT s.match_id, s.home_score, s.away_score, c.status, c.period, c.minute, c.second, c.clock FROM state{x} s JOIN clocks{x} c USING (match_id))"
_LIVE = f"""SELECT match_id, c.status, CASE WHEN c.status = 'finished' THEN l.lede WHEN w.home_score = w.away_score THEN concat(w.home, ' and ', w.away, ' are level at ', w.home_score, '-', w.away_score, ' ', wh, '.')
   ELSE concat(CASE WHEN w.home_score > w.away_score THEN w.home ELSE w.away END, ' lead ', CASE WHEN w.home_score > w.away_score THEN w.away ELSE w.home END, ' ',
     greatest(w.home_score, w.away_score), '-', least(w.home_score, w.away_score), ' ', wh, '.') END AS lede
   FROM (SELECT s.match_id, s.home_score, s.away_score, m.home, m.away FROM state1 s JOIN matches m USING (match_id)) w
   JOIN (SELECT *, CASE WHEN status = 'half_time' THEN 'at half-time' ELSE concat('after ', minute, ' minutes') END AS wh FROM clocks1) c USING (match_id) LEFT JOIN ledes l USING (match_id)"""
#: The ledes as the whole log has them.
LIVE_NOW = sql(f"SELECT match_id, lede, CAST(0 AS BIGINT) AS repeats FROM ({_LIVE})", **_as_of(9, 9999), ledes=LEDES)
_CAND_SQL = "match_id, event_id, kind, period, minute, home_after, away_after, mandatory, stype AS shot_type, detail, synthesised, ruled_out_at, round(swing, 4) AS swing"
_PROB = ", ".join(f"{w}_{c}" for w in ("before", "after") for c in MD.CLASSES)
ORACLE = {
    "winner": sql("SELECT match_id, winner, winner_name FROM winners"),
    "event_probabilities": sql(f"SELECT e.match_id, event_id, minute, {_PROB} FROM match_events e JOIN br ON br.match_id = e.match_id AND br.mm = least(e.minute, 90) WHERE type = 'Shot'"),
    "event_probabilities_missing": sql("SELECT match_id, event_id, " + ", ".join(f"0.333333e0 AS {w}_{c}" for w in ("before", "after") for c in MD.CLASSES) + " FROM match_events WHERE type = 'Shot' AND match_id % 2 = 1"),
    "moment_candidates": sql(f"SELECT {_CAND_SQL} FROM cands"),
    "moments_chosen": sql(f"SELECT {_CAND_SQL} FROM chosen", chosen=CHOSEN),
    "biggest_swing": sql(f"SELECT match_id, event_id, kind, minute, round(swing, 4) AS swing FROM ({BIG})"),
    "running_score": sql("SELECT match_id, event_id, period, minute, home_now, away_now FROM run"),
    "comeback": sql("SELECT * FROM comeback"),
    "lede": sql(LEDES),
    "lede_live": sql(_LIVE, **_as_of(2, 60), ledes=LEDES),
    "headline": sql(HEADLINE),
    "report_lines": sql(LINE),
    "report_closing": sql(f"""SELECT match_id, CASE WHEN abs(after_p_home - before_p_home) * 100 < 3 THEN '' ELSE concat('The single biggest swing of the match came in the ', minute, 'th minute, worth ',
       CAST(round_even(abs(after_p_home - before_p_home) * 100, 0) AS INT), ' percentage points.') END AS closing FROM ({BIG})"""),
    "report_notes": sql(NOTES),
    "correction_headline": sql(f"SELECT match_id, correction_id, {HEADK} AS headline FROM corrections"),
    "diff_corrections": sql(f"""SELECT k.match_id, 'correction_applied' AS type, correction_id AS ref,
       CASE WHEN kind = 'disallow' AND scorer IS NOT NULL THEN concat('Goal disallowed - ', scorer, '''s goal at ', gm, ''' has been ruled out (', lower(reason), '). The score is now ', {_S}, '.')
            WHEN kind = 'reinstate' AND scorer IS NOT NULL THEN concat('Goal reinstated - ', scorer, '''s goal stands after all. The score is now ', {_S}, '.')
            ELSE concat({HEADK}, '. The score is unchanged.') END AS text
       FROM corrections k LEFT JOIN (SELECT match_id, event_id AS supersedes, scorer, minute AS gm FROM goals) USING (match_id, supersedes) JOIN state USING (match_id)
       WHERE (k.period, decided_at_minute) > (1, 47)"""),
    "diff_timeline": sql("SELECT match_id, 'event_appended' AS type, CAST(event_id AS VARCHAR) AS ref, kind AS text FROM tl WHERE (period, minute) > (1, 47)", tl=M._timeline("''")),
    "diff_state": sql(f"""SELECT a.match_id, 'state_changed' AS type, concat(a.home_score, '-', a.away_score, ' ', a.status, ' ', a.clock) AS text
       FROM {_STATUS.format(x='')} a LEFT JOIN {_STATUS.format(x='1')} b USING (match_id)
       WHERE (a.home_score, a.away_score, a.status, a.period, a.minute, a.second) IS DISTINCT FROM (b.home_score, b.away_score, b.status, b.period, b.minute, b.second)""", **_as_of(1, 47)),
    "score_feed": sql("SELECT match_id, a.home_score, a.away_score FROM state a LEFT JOIN state1 b USING (match_id) WHERE (a.home_score, a.away_score) IS DISTINCT FROM (b.home_score, b.away_score)", **_as_of(1, 47)),
}
