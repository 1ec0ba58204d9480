"""Registered queries: cards, catalogs, listings, search, fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import catalog as CA
from touchline.operators import fixtures as FX
from touchline.operators import leaderboard as LB
from touchline.operators import metrics as ME
from touchline.operators import report as RP
from touchline.plans import archive as A
from touchline.plans import corrections as C
from touchline.plans import match as M
from touchline.plans import narrative as NA
from touchline.plans.fixture import half_up, micro, once, table


def _cards(spark, d):
    """Cards whose biggest swing is taken over all candidates, so that plain SQL
    can follow; `match_cards_full` uses the final moments."""
    return once(spark, d, "cards", lambda: _build_cards(spark, d))


def _build_cards(spark, d):
    w = NA.winners(spark, d)
    m = NA._matches(spark, d)
    big = RP.closing(NA.candidates(spark, d)).select("match_id", "biggest_swing")
    rp = (w.join(m.select("match_id", "competition", "match_date"), "match_id").select("match_id", NA.prose.headline().alias("headline"))
          .join(RP.ledes(NA._goals(spark, d), w), "match_id", "left").join(big, "match_id", "left"))
    return CA.cards(m, w, ME.team_metrics(C.effective(spark, d), C.sides(spark, d)), rp)


def cards_full(spark, d):
    m = NA._matches(spark, d)
    c = CA.cards(m, C.match_state(spark, d), ME.team_metrics(C.effective(spark, d), C.sides(spark, d)), NA.reports(spark, d))
    return c.withColumn("tags", F.array_join("tags", ","))


CARD = ["match_id", "competition_id", "season_id", "match_date", "kick_off", "stage", "home_id", "away_id", "home", "away", "home_score", "away_score",
        "shootout", "status", "home_xg", "away_xg", "headline", "standfirst", "biggest_swing", "has_freeze_frames"]


def cards(spark, d):
    return _cards(spark, d).select(*CARD, F.array_join("tags", ",").alias("tags"))


def _tags(df):
    return df.select("match_id", F.explode("tags").alias("tag"))


def competition_catalog(spark, d):
    c = CA.competition_catalog(_cards(spark, d)).select("competition_id", "competition", F.col("matches").alias("total"), F.posexplode("seasons"))
    return c.select("competition_id", "competition", "total", (F.col("pos") + 1).alias("n"), "col.season_id", "col.matches", "col.from", "col.to")


def _stats(spark, d):
    return CA.archive_stats(LB.archive_size(table(spark, d, "match_events")), _cards(spark, d))


def front_page(spark, d):
    c = _cards(spark, d)
    return CA.front_page(c, CA.collections(c), _stats(spark, d))


def _listed(spark, d):
    """Matches that have a card, without what only cards tell: names and dates don't wait for probabilities and stories."""
    unknown = {f"{s}_{c}": F.lit(None).cast(t) for s in ("home", "away") for c, t in (("score", "long"), ("xg", "double"))}
    return NA._matches(spark, d).join(C.corrected(spark, d).select("match_id").distinct(), "match_id", "left_semi").withColumns(unknown)


def _index(spark, d):
    c = _listed(spark, d)
    # names with accents, so that folding matters
    players = LB.players_catalog(A._rollup(spark, d)).withColumn("name", F.regexp_replace("name", "Player ", "Jugadór Núm "))
    return CA.search_index(CA.competition_catalog(c), CA.team_catalog(c), players)


def match_index(spark, d):
    """All matches with their competition, in global date order."""
    return table(spark, d, "matches").orderBy("match_date", "kick_off", "match_id")


# ---- fixtures, from the orders table
NOW = "1997-06-15 12:00:00"
SHORT = ["Man City", "Man United", "Tottenham", "Arsenal", "Liverpool", "Barça", "Atleti", "Real Madrid", "Bayern", "PSG", "Inter", "Milan", "Juventus"]
FULL = ["Manchester City FC", "Manchester United FC", "Tottenham Hotspur FC", "Arsenal FC", "Liverpool FC", "FC Barcelona", "Club Atlético de Madrid",
        "Real Madrid CF", "FC Bayern München", "Paris Saint-Germain FC", "FC Internazionale Milano", "AC Milan", "Juventus FC"]


def fixtures(spark, d):
    o = table(spark, d, "orders")

    def pick(names, i):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (i % len(names) + 1).cast("int"))

    h, a = F.col("o_custkey"), F.col("o_custkey") + 1 + F.col("o_orderkey") % 12
    code = F.element_at(F.array(*[F.lit(c) for c in (*FX.PRIORITY, "ZZ", "")]), (F.col("o_orderkey") % 15 + 1).cast("int"))
    status = F.when(F.col("o_orderkey") % 997 == 0, "live").when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("postponed")
    return o.select(
        F.concat(F.lit("fd-"), F.col("o_orderkey").cast("string")).alias("id"), code.alias("code"),
        F.when(code != "", F.concat(F.lit("Competition "), code)).otherwise("").alias("competition"),
        (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 24 * 3600).cast("timestamp").alias("kickoff"), status.alias("status"),
        pick(SHORT, h).alias("home_name"), pick(FULL, h).alias("home_full"), pick(SHORT, a).alias("away_name"), pick(FULL, a).alias("away_full"))


def _now():
    return F.lit(NOW).cast("timestamp")


def fixtures_window(spark, d):
    f, today = fixtures(spark, d), F.to_date(F.lit(NOW))
    main = FX.in_window(F.col("kickoff"), today)
    return f.filter(main | FX.ahead(F.col("kickoff"), today)).select("id", F.when(main, "main").otherwise("ahead").alias("window"))


def fixtures_snapshot(spark, d):
    """Main window, far window and the next round of a league, without repeats."""
    f, today = fixtures(spark, d), F.to_date(F.lit(NOW))
    main = f.filter(FX.in_window(F.col("kickoff"), today)).withColumn("from_list", F.lit("main"))
    far = f.filter(FX.ahead(F.col("kickoff"), today)).withColumn("from_list", F.lit("ahead"))
    nxt = f.filter((F.col("code") == "PL") & (F.col("kickoff") >= _now())).withColumn("from_list", F.lit("round"))
    return FX.listed(FX.merge(main, far, nxt)).select("id", "code", "from_list")


def fixtures_relevant(spark, d):
    return FX.relevant(fixtures(spark, d), _now()).select("id", "code", "status", "priority", F.round("distance", 0).cast("long").alias("distance"))


def competitions_active(spark, d):
    """Each competition's orders give its season; one has no end."""
    c = fixtures(spark, d).filter("code <> ''").groupBy("code").agg(F.date_format(F.min("kickoff"), "yyyy-MM-dd").alias("season_start"),
                                                                    F.date_format(F.max("kickoff"), "yyyy-MM-dd").alias("season_end"))
    c = c.withColumn("season_end", F.when(F.col("code") == "PL", F.lit(None)).otherwise(F.col("season_end")))
    return FX.active(c, F.lit("1998-08-01")).select("code")


def fixtures_stale(spark, d):
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return e.select("event_id", FX.stale(F.col("at"), F.lit(1706000000.0)).alias("stale"))


def team_aliases(spark, d):
    f = fixtures(spark, d)
    t = FX.team_aliases(f.select(F.col("home_name").alias("name"), F.col("home_full").alias("full_name")))
    return t.withColumn("aliases", F.array_join("aliases", "|"))


def topic_aliases(spark, d):
    return FX.topic_aliases(fixtures(spark, d), _now())


QUERIES = {
    "match_cards": cards,
    "match_cards_full": cards_full,
    "story_tags": lambda s, d: _tags(_cards(s, d)),
    "team_catalog": lambda s, d: CA.team_catalog(_cards(s, d)).withColumn("competitions", F.array_join("competitions", ",")),
    "competition_catalog": competition_catalog,
    "archive_stats": _stats,
    "feed": lambda s, d: CA.feed(_cards(s, d), limit=5).select("match_id", "match_date"),
    "feed_next_page": lambda s, d: CA.feed(_cards(s, d), before=("2024-01-20", 13), limit=5).select("match_id", "match_date"),
    "feed_tag": lambda s, d: CA.feed(_cards(s, d), tag="knockout").select("match_id", "match_date"),
    "team_matches": lambda s, d: CA.team_matches(_cards(s, d)).select("team_id", "match_id", "match_date").orderBy("team_id", F.col("match_date").desc(), F.col("match_id").desc()),
    "matches_on_date": lambda s, d: CA.matches_on(_cards(s, d), "2024-01-01").select("match_id"),
    "season_matches": lambda s, d: CA.season_matches(_cards(s, d), 11, 0).select("match_id", "match_date"),
    "collections": lambda s, d: CA.collections(_cards(s, d)),
    "front_page": front_page,
    "search_index": _index,
    "search": lambda s, d: CA.search(_index(s, d), "num 1"),
    "search_word": lambda s, d: CA.search(_index(s, d), "TEAM"),
    "match_index": match_index,
    "fixtures_window": fixtures_window,
    "fixtures_snapshot": fixtures_snapshot,
    "fixtures_relevant": fixtures_relevant,
    "competitions_active": competitions_active,
    "fixtures_stale": fixtures_stale,
    "team_aliases": team_aliases,
    "topic_aliases": topic_aliases,
}

TAGLIST = """[t FOR t IN [CASE WHEN shootout THEN 'penalties' END, CASE WHEN swing0 >= 0.4 THEN 'turnaround' END, CASE WHEN home_score + away_score >= 5 THEN 'goal-fest' END,
  CASE WHEN (home_score > away_score AND home_xg < away_xg - 0.8e0) OR (away_score > home_score AND away_xg < home_xg - 0.8e0) THEN 'smash-and-grab' END,
  CASE WHEN home_score = 0 AND away_score = 0 THEN 'stalemate' END, CASE WHEN stage NOT IN ('Regular Season', 'Group Stage', '') THEN 'knockout' END] IF t IS NOT NULL]"""
CARDS = f"""SELECT *, {half_up('swing0', 3)} AS biggest_swing, {TAGLIST} AS tags FROM (
  SELECT m.match_id, m.competition_id, m.season_id, m.match_date, m.kick_off, m.stage, m.home_id, m.away_id, m.home, m.away, w.home_score, w.away_score, w.shootout, k.status,
   h.xg AS home_xg, a.xg AS away_xg, hl.headline, l.lede AS standfirst, coalesce(round(b.swing, 4), 0) AS swing0, FALSE AS has_freeze_frames, 'La Liga' AS competition
  FROM matches m JOIN winners w USING (match_id) JOIN clocks k USING (match_id) JOIN headlines hl USING (match_id) JOIN ledes l USING (match_id) LEFT JOIN big b USING (match_id)
  LEFT JOIN (SELECT match_id, xg FROM tm WHERE side = 'home') h USING (match_id) LEFT JOIN (SELECT match_id, xg FROM tm WHERE side = 'away') a USING (match_id))"""
CT = dict(clocks=C.CLOCKS, headlines=NA.HEADLINE, ledes=NA.LEDES, big=NA.BIG, tm=M.METRICS, cards=CARDS)


def sql(q, **extra):
    return NA.sql(q, **CT, **extra)


SIDES2 = """(SELECT match_id, match_date, competition, home_id AS team_id, home AS name, home_score AS gf, away_score AS ga, home_xg AS xf, away_xg AS xa FROM cards UNION ALL
   SELECT match_id, match_date, competition, away_id, away, away_score, home_score, away_xg, home_xg FROM cards)"""
TEAMS = f"""SELECT team_id, arg_max(name, (match_date, match_id)) AS name, count(*) AS matches, count(*) FILTER (WHERE gf > ga) AS won, count(*) FILTER (WHERE gf = ga) AS drawn,
   count(*) FILTER (WHERE gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against, {half_up(f"sum({micro('xf')}) / 1e6", 1)} AS xg_for,
   {half_up(f"sum({micro('xa')}) / 1e6", 1)} AS xg_against, array_to_string(list_sort(list(DISTINCT competition)), ',') AS competitions, min(match_date) AS first, max(match_date) AS last FROM {SIDES2} GROUP BY team_id"""
STATS = """SELECT 'events' AS key, CAST(count(*) AS VARCHAR) AS value FROM match_events UNION ALL SELECT 'matches', CAST(count(DISTINCT match_id) AS VARCHAR) FROM match_events
   UNION ALL SELECT 'players', CAST(count(DISTINCT player_id) AS VARCHAR) FROM match_events UNION ALL SELECT 'competitions', CAST(count(DISTINCT competition_id) AS VARCHAR) FROM cards
   UNION ALL SELECT 'seasons', CAST(count(DISTINCT (competition_id, season_id)) AS VARCHAR) FROM cards UNION ALL SELECT 'from', min(match_date) FROM cards UNION ALL SELECT 'to', max(match_date) FROM cards"""
_top = lambda name, cond, value, n: f"(SELECT '{name}' AS collection, match_id, CAST({value} AS DOUBLE) AS value, NULL AS date FROM cards WHERE {cond} ORDER BY value DESC NULLS LAST, match_id LIMIT {n})"
COLLECTIONS = " UNION ALL ".join([
    _top("turnarounds", "list_contains(tags, 'turnaround')", "biggest_swing", 12),
    "SELECT 'finals', match_id, NULL, match_date FROM cards WHERE stage = 'Final'",
    _top("goal_fests", "home_score + away_score >= 5", "home_score + away_score", 12),
    _top("smash_and_grab", "list_contains(tags, 'smash-and-grab')", "abs(home_xg - away_xg)", 12),
    "(SELECT 'shootouts', match_id, NULL, match_date FROM cards WHERE stage NOT IN ('Regular Season', 'Group Stage', '') AND shootout ORDER BY match_date DESC, match_id LIMIT 24)",
    _top("highest_xg", "TRUE", "home_xg + away_xg", 12)])
INDEX = """SELECT 'competition' AS kind, CAST(competition_id AS VARCHAR) AS id, competition AS name, '' AS subtitle, 10000 + count(*) AS weight FROM cards GROUP BY competition_id, competition
   UNION ALL SELECT 'team', CAST(team_id AS VARCHAR), name, competitions, 1000 + matches FROM teams
   UNION ALL SELECT 'player', CAST(player_id AS VARCHAR), replace(max(player), 'Player ', 'Jugadór Núm '), min(team), count(DISTINCT match_id) FROM match_events GROUP BY player_id"""
SEARCH = """SELECT kind, id, name, subtitle, weight, tier FROM (SELECT *, CASE WHEN f = '{q}' THEN 0 WHEN len([w FOR w IN string_split_regex(f, '\\s+') IF starts_with(w, '{q}')]) > 0 THEN 1 ELSE 2 END AS tier
   FROM (SELECT *, lower(strip_accents(name)) AS f FROM idx) WHERE contains(f, '{q}')) ORDER BY tier, weight DESC, kind, id LIMIT 20"""
_arr = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
FIX = f"""SELECT concat('fd-', o_orderkey) AS id, {_arr((*FX.PRIORITY, 'ZZ', ''))}[o_orderkey % 15 + 1] AS code, CASE WHEN code <> '' THEN concat('Competition ', code) ELSE '' END AS competition,
   CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INT)) AS kickoff,
   CASE WHEN o_orderkey % 997 = 0 THEN 'live' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'O' THEN 'scheduled' ELSE 'postponed' END AS status,
   {_arr(SHORT)}[o_custkey % 13 + 1] AS home_name, {_arr(FULL)}[o_custkey % 13 + 1] AS home_full,
   {_arr(SHORT)}[(o_custkey + 1 + o_orderkey % 12) % 13 + 1] AS away_name, {_arr(FULL)}[(o_custkey + 1 + o_orderkey % 12) % 13 + 1] AS away_full FROM orders"""
RANKED = f"""SELECT *, CASE WHEN status IN ('live', 'half_time') THEN 0 ELSE 1 END AS not_live, coalesce(list_position({_arr(FX.PRIORITY)}, code) - 1, 99) AS priority,
   abs(epoch(kickoff) - epoch(TIMESTAMP '{NOW}')) AS distance FROM fx"""
PICKED = "SELECT * FROM ranked WHERE not_live = 0 OR (status IN ('scheduled', 'finished') AND distance <= 129600) ORDER BY not_live, priority, distance, id LIMIT 10"
TODAY = "DATE '1997-06-15'"
MAINW, AHEADW = f"CAST(kickoff AS DATE) BETWEEN {TODAY} - 3 AND {TODAY} + 6", f"CAST(kickoff AS DATE) BETWEEN {TODAY} + 7 AND {TODAY} + 16"
KNOWN = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), a.replace("'", "''")) for k, v in FX.TEAM_ALIASES.items() for a in v) + ") t(k, a)"
NAMES = "SELECT DISTINCT name, full_name, lower(strip_accents(name)) AS short, lower(strip_accents(full_name)) AS fll, trim(regexp_replace(lower(strip_accents(full_name)), '(?i)\\b(fc|cf|afc|sc|ac|ssc|as|cd|ud|sd|rc|fk|sk|bk|if)\\b', '', 'g')) AS bare FROM (SELECT home_name AS name, home_full AS full_name FROM fx UNION SELECT away_name, away_full FROM fx)"
ALIAS = """SELECT DISTINCT name, full_name, a FROM (SELECT name, full_name, short AS a FROM tnames UNION ALL SELECT name, full_name, fll FROM tnames UNION ALL SELECT name, full_name, bare FROM tnames
   UNION ALL SELECT name, full_name, known.a FROM tnames JOIN known ON k = short OR k = bare) WHERE length(a) >= 2"""
FXC = dict(fx=FIX, ranked=RANKED, picked=PICKED, known=KNOWN, tnames=NAMES, talias=ALIAS)
COMPA = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, v in FX.COMPETITION_ALIASES.items() for a in v) + ") t(c, a)"
STRONG = f"alias NOT IN ({', '.join(repr(w) for w in FX.WEAK)}) AS strong"


def fsql(q, **extra):
    from touchline.plans.fixture import with_views

    return with_views(q, **FXC, **extra)


_card = ", ".join(CARD)
ORACLE = {
    "match_cards": sql(f"SELECT {_card}, array_to_string(tags, ',') AS tags FROM cards"),
    "story_tags": sql("SELECT match_id, unnest(tags) AS tag FROM cards"),
    "team_catalog": sql(TEAMS),
    "competition_catalog": sql("""SELECT competition_id, competition, CAST(sum(matches) OVER (PARTITION BY competition_id) AS BIGINT) AS total, CAST(row_number() OVER (PARTITION BY competition_id ORDER BY "to" DESC, season_id DESC) AS INT) AS n,
       season_id, matches, "from", "to" FROM (SELECT competition_id, competition, season_id, count(*) AS matches, min(match_date) AS "from", max(match_date) AS "to" FROM cards GROUP BY ALL)"""),
    "archive_stats": sql(STATS),
    "feed": sql("SELECT match_id, match_date FROM cards ORDER BY match_date DESC, match_id DESC LIMIT 5"),
    "feed_next_page": sql("SELECT match_id, match_date FROM cards WHERE (match_date, match_id) < ('2024-01-20', 13) ORDER BY match_date DESC, match_id DESC LIMIT 5"),
    "feed_tag": sql("SELECT match_id, match_date FROM cards WHERE list_contains(tags, 'knockout') ORDER BY match_date DESC, match_id DESC LIMIT 30"),
    "team_matches": sql(f"SELECT team_id, match_id, match_date FROM {SIDES2}"),
    "matches_on_date": sql("SELECT match_id FROM cards WHERE match_date = '2024-01-01'"),
    "season_matches": sql("SELECT match_id, match_date FROM cards WHERE competition_id = 11 AND season_id = 0"),
    "collections": sql(COLLECTIONS),
    "front_page": sql("""SELECT 'latest' AS block, CAST(match_id AS VARCHAR) AS key, match_date AS value FROM (SELECT match_id, match_date FROM cards ORDER BY match_date DESC, match_id DESC LIMIT 18)
       UNION ALL SELECT concat('collection:', collection), CAST(match_id AS VARCHAR), CAST(n AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY value DESC NULLS LAST, date DESC NULLS LAST, match_id) AS n FROM coll) WHERE n <= 8
       UNION ALL SELECT 'archive', key, value FROM stats""", coll=COLLECTIONS, stats=STATS),
    "search_index": sql("SELECT * FROM idx", teams=TEAMS, idx=INDEX),
    "search": sql(SEARCH.format(q="num 1"), teams=TEAMS, idx=INDEX),
    "search_word": sql(SEARCH.format(q="team"), teams=TEAMS, idx=INDEX),
    "match_index": C.sql("SELECT * FROM matches"),
    "fixtures_window": fsql(f"SELECT id, CASE WHEN {MAINW} THEN 'main' ELSE 'ahead' END AS \"window\" FROM fx WHERE {MAINW} OR {AHEADW}"),
    "fixtures_snapshot": fsql(f"""SELECT id, code, CASE WHEN {MAINW} THEN 'main' WHEN {AHEADW} THEN 'ahead' ELSE 'round' END AS from_list FROM fx
       WHERE {MAINW} OR {AHEADW} OR (code = 'PL' AND kickoff >= TIMESTAMP '{NOW}')"""),
    "fixtures_relevant": fsql("SELECT id, code, status, CAST(priority AS INT) AS priority, CAST(round(distance) AS BIGINT) AS distance FROM picked"),
    "competitions_active": fsql("""SELECT code FROM (SELECT code, strftime(min(kickoff), '%Y-%m-%d') AS s, CASE WHEN code = 'PL' THEN '9999' ELSE strftime(max(kickoff), '%Y-%m-%d') END AS e FROM fx WHERE code <> '' GROUP BY code)
       WHERE s <= '1998-08-01' AND '1998-08-01' <= e"""),
    "fixtures_stale": "SELECT event_id, 1706000000 - epoch(ts) > 300 AS stale FROM events",
    "team_aliases": fsql("SELECT name, full_name, string_agg(a, '|' ORDER BY a) AS aliases FROM talias GROUP BY name, full_name HAVING (name, full_name) IN (SELECT (home_name, home_full) FROM fx)"),
    "topic_aliases": fsql(f"""SELECT *, {STRONG} FROM (SELECT id AS topic, 'fixture' AS kind, code, side, a AS alias FROM (
         SELECT id, code, 'home' AS side, home_name AS name, home_full AS full_name FROM picked UNION ALL SELECT id, code, 'away', away_name, away_full FROM picked) JOIN talias USING (name, full_name)
       UNION ALL SELECT DISTINCT code, 'competition', code, 'name', a FROM (SELECT code, lower(concat('Competition ', code)) AS a FROM fx WHERE code <> ''
         UNION ALL SELECT f.code, lower(strip_accents(compa.a)) FROM (SELECT DISTINCT code FROM fx) f JOIN compa ON compa.c = f.code))""", compa=COMPA),
}
