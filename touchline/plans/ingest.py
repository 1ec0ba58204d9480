"""Registered queries: feeds and storage.  Raw payloads are shaped by Spark from
the driver's tables, then read back through the feed's own schema."""

from __future__ import annotations

from pyspark.sql import functions as F


from touchline.operators import network as NW
from touchline.operators import standings as SD
from touchline.operators import timeline as TL
from touchline.plans import archive as A
from touchline.plans import corrections as C
from touchline.plans import narrative as NA
from touchline.plans import probability as PR
from touchline.plans import tables as TB
from touchline.plans.fixture import long, table, with_views
from touchline.session import scratch
from touchline.sources import api_football as AF
from touchline.sources import capabilities as CP
from touchline.sources import football_data as FD
from touchline.sources import records as RC
from touchline.sources import social as SS
from touchline.sources import statsbomb as SB


def _ref(i, n):
    return F.struct(i.cast("long").alias("id"), n.alias("name"))


def _named(c):
    return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("name")))


def _pl(c):
    return F.when(F.col(c).isNotNull(), _ref(F.col(c), F.concat(F.lit("Player "), F.col(c).cast("string"))))


def raw_statsbomb(spark, d):
    """match_id and the raw JSON text of every event."""
    e = table(spark, d, "match_events")
    shot = F.when(F.col("type") == "Shot", F.struct(
        F.col("shot_xg").alias("statsbomb_xg"), _named("shot_outcome").alias("outcome"), _named("shot_type").alias("type"), _named("shot_body_part").alias("body_part"),
        F.array("end_x", "end_y", F.lit(1.5)).alias("end_location"),
        F.array(F.struct(F.array("y", "x").alias("location"), F.lit(True).alias("teammate"), F.struct(F.lit("Goalkeeper").alias("name")).alias("position"),
                         F.struct(F.col("player").alias("name")).alias("player")),
                F.struct(F.array("x").alias("location"), F.lit(False).alias("teammate"), F.lit(None).cast("struct<name:string>").alias("position"),
                         F.lit(None).cast("struct<name:string>").alias("player"))).alias("freeze_frame")))
    yes = lambda c: F.when(F.col(c), F.lit(True))  # noqa: E731 - the feed sends only true flags
    pas = F.when(F.col("type") == "Pass", F.struct(
        _pl("pass_recipient_id").alias("recipient"), F.array("end_x", "end_y").alias("end_location"), _named("pass_type").alias("type"),
        F.when(F.col("pass_outcome") != "Complete", F.struct(F.col("pass_outcome").alias("name"))).alias("outcome"), yes("pass_shot_assist").alias("shot_assist"), yes("pass_goal_assist").alias("goal_assist")))
    body = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("idx").alias("index"), "period", "minute", "second", F.struct(F.col("type").alias("name")).alias("type"),
        _ref(F.col("team_id"), F.col("team")).alias("team"), _ref(F.col("player_id"), F.col("player")).alias("player"), _named("position").alias("position"), "possession",
        F.array("x", "y").alias("location"), yes("under_pressure").alias("under_pressure"), shot.alias("shot"), pas.alias("pass"),
        F.when(F.col("card").isNotNull(), F.struct(_named("card").alias("card"))).alias("bad_behaviour"),
        F.when(F.col("duel_type").isNotNull(), F.struct(_named("duel_type").alias("type"))).alias("duel"),
        F.when(F.col("sub_player_id").isNotNull(), F.struct(_pl("sub_player_id").alias("replacement"))).alias("substitution"))
    return e.select("match_id", F.to_json(body).alias("raw"))


def statsbomb(spark, d, names=None):
    raw = raw_statsbomb(spark, d).select(F.col("match_id").cast("long").alias("match_id"), F.from_json("raw", SB.RAW).alias("r")).select("match_id", "r.*")
    return SB.normalise(raw, names)


SB_COLS = ["match_id", "event_id", "idx", "period", "minute", "second", "type", "team_id", "team", "player_id", "player", "position", "possession", "x", "y", "end_x", "end_y", "under_pressure",
           "pass_outcome", "pass_type", "pass_recipient_id", "shot_outcome", "shot_type", "shot_body_part", "card", "duel_type", "sub_player_id"]


def statsbomb_events(spark, d):
    e = statsbomb(spark, d)
    return e.select(*SB_COLS, F.round("shot_xg", 6).alias("shot_xg"), F.coalesce("pass_shot_assist", F.lit(False)).alias("pass_shot_assist"),
                    F.coalesce("pass_goal_assist", F.lit(False)).alias("pass_goal_assist"))


def freeze_frames(spark, d):
    """Visible players at the instant of each shot, through the shot map."""
    e = statsbomb(spark, d)
    m = TL.shot_map(e, C.verdicts(spark, d).withColumn("event_id", F.col("event_id").cast("string")), table(spark, d, "matches").select("match_id", F.col("home_id").cast("string").alias("home_id")))
    return m.select("match_id", "event_id", F.explode("freeze").alias("a")).select("match_id", "event_id", "a.x", "a.y", "a.teammate", "a.keeper", "a.name")


def nicknamed(spark, d):
    names = table(spark, d, "match_events").filter("player_id % 2 = 0").select(F.col("player_id").cast("string").alias("player_id")).distinct().withColumn("nickname", F.concat(F.lit("Nick "), F.col("player_id")))
    return statsbomb(spark, d, names).select("match_id", "event_id", "player_id", "player", "sub_player_id", "sub_player")


def lineups(spark, d):
    e = table(spark, d, "match_events")
    p = e.groupBy("match_id", "team_id", "team", "player_id", "player", "position").agg(F.min("idx").alias("first"))
    one = F.struct("player_id", F.col("player").alias("player_name"), F.when(F.col("player_id") % 3 == 0, F.concat(F.lit("N"), F.col("player_id").cast("string"))).alias("player_nickname"),
                   F.when(F.col("player_id") % 4 != 0, F.col("player_id") % 30).cast("int").alias("jersey_number"),
                   F.array(F.struct("position", F.when(F.col("first") < 60, "Starting XI").otherwise("Substitution").alias("start_reason"))).alias("positions"))
    raw = p.groupBy("match_id", "team_id", "team").agg(F.to_json(F.collect_list(one)).alias("j"))
    parsed = raw.select(F.col("match_id").cast("long").alias("match_id"), F.col("team_id").cast("long").alias("team_id"), F.col("team").alias("team_name"),
                        F.from_json("j", "array<struct<player_id:bigint,player_name:string,player_nickname:string,jersey_number:int,country:struct<name:string>,positions:array<struct<position:string,start_reason:string>>>>").alias("lineup"))
    out = SB.lineups(parsed, table(spark, d, "matches").select("match_id", F.col("home_id").cast("long").alias("home_id")))
    return out.withColumn("number", F.coalesce("number", F.lit(-1)))


# ---- football-data
def raw_matches(spark, d):
    e = table(spark, d, "match_events")
    team = _ref(F.col("team_id"), F.col("team"))
    added = F.when(F.col("minute") > 90, F.col("minute") - 90)
    at = [F.least("minute", F.lit(90)).alias("minute"), added.alias("injuryTime")]
    player = _ref(F.col("player_id"), F.col("player"))
    srt = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["e"])
    key = F.col("event_id").alias("k")
    goal = F.when((F.col("type") == "Shot") & (F.col("shot_outcome") == "Goal") & (F.col("period") < 5) | (F.col("type") == "Own Goal Against"), F.struct(key, F.struct(
        *at, F.when(F.col("type") != "Shot", "OWN").when(F.col("shot_type") == "Penalty", "PENALTY").otherwise("REGULAR").alias("type"), team.alias("team"), player.alias("scorer")).alias("e")))
    book = F.when(F.col("card").isNotNull(), F.struct(key, F.struct(*at, team.alias("team"), player.alias("player"), F.when(F.col("card") == "Yellow Card", "YELLOW").when(
        F.col("card") == "Red Card", "RED").otherwise("YELLOW_RED").alias("card")).alias("e")))
    sub = F.when(F.col("type") == "Substitution", F.struct(key, F.struct(*at, team.alias("team"), player.alias("playerOut"), _pl("sub_player_id").alias("playerIn")).alias("e")))
    a = e.groupBy("match_id").agg(srt(goal).alias("goals"), srt(book).alias("bookings"), srt(sub).alias("substitutions"))
    m = table(spark, d, "matches")
    side = lambda i, n: F.struct(F.col(i).cast("long").alias("id"), F.concat(F.col(n), F.lit(" FC")).alias("name"), F.col(n).alias("shortName"))
    code = F.element_at(F.array(*[F.lit(c) for c in ("PD", "PL", "CL", "SA")]), F.col("match_id") % 4 + 1)
    st = F.element_at(F.array(*[F.lit(c) for c in (*FD.STATUS, "NEW")]), F.col("match_id") % 10 + 1)
    body = F.struct(F.col("match_id").alias("id"), F.concat("match_date", F.lit("T"), "kick_off", F.lit("Z")).alias("utcDate"), st.alias("status"), (F.col("match_id") % 20).alias("matchday"),
                    F.lit("GROUP_STAGE").alias("stage"), F.struct(F.col("competition_id").alias("id"), F.concat(F.lit("Official "), code).alias("name"), code.alias("code")).alias("competition"),
                    side("home_id", "home").alias("homeTeam"), side("away_id", "away").alias("awayTeam"), "goals", "bookings", "substitutions")
    return a.join(m, "match_id").select(F.from_json(F.to_json(body), FD.MATCH).alias("r")).select("r.*")


def fd_events(spark, d):
    e = FD.events(raw_matches(spark, d))
    return e.select("match_id", "event_id", "idx", "period", "minute", "type", "team_id", "player_id", "player", "shot_outcome", "shot_type", "card", "sub_player_id")


def fixture_cards(spark, d):
    return FD.fixture_cards(raw_matches(spark, d)).select("id", "code", "competition", "kickoff", "status", "matchday", "stage", "home_id", "home_name", "home_full", "away_name")


def current_standings(spark, d):
    t = SD.standings(table(spark, d, "results_region"), ["region_id", "season_id"], "PL")
    row = F.struct("position", F.struct(F.col("team_id").cast("long").alias("id"), F.concat(F.lit("Nation "), F.col("team_id").cast("string")).alias("name")).alias("team"), F.col("played").alias("playedGames"),
                   "won", F.col("drawn").alias("draw"), "lost", F.col("goals_for").alias("goalsFor"), F.col("goals_against").alias("goalsAgainst"), F.col("goal_difference").alias("goalDifference"), "points")
    g = t.groupBy("region_id", "season_id").agg(F.array_sort(F.collect_list(row)).alias("table"))
    both = F.array(F.struct(F.lit("TOTAL").alias("type"), F.lit("REGULAR_SEASON").alias("stage"), "table"), F.struct(F.lit("HOME").alias("type"), F.lit("REGULAR_SEASON").alias("stage"), "table"))
    body = F.struct(F.concat_ws("-", F.col("region_id").cast("string"), F.col("season_id").cast("string")).alias("code"), F.struct(F.lit(3).alias("currentMatchday")).alias("season"), both.alias("standings"))
    raw = g.select(F.from_json(F.to_json(body), FD.STANDINGS).alias("r")).select("r.*")
    return FD.standings(raw).drop("form", "group")


def current_scorers(spark, d):
    from touchline.plans.archive import _leaderboard

    lb = _leaderboard("goals")(spark, d)
    one = F.struct(-F.col("value"), "player_id", F.struct(F.struct(F.col("player").alias("name")).alias("player"), F.struct(F.col("team").alias("name")).alias("team"), F.col("matches").alias("playedMatches"), F.col("value").alias("goals")).alias("s"))
    body = lb.groupBy(F.lit("PD").alias("code")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["s"]).alias("scorers"))
    raw = body.select(F.from_json(F.to_json(F.struct("*")), FD.SCORERS).alias("r")).select("r.*")
    return FD.scorers(raw).select("code", "n", "player", "team", "played", "goals")


def current_competitions(spark, d):
    o = table(spark, d, "results_region").groupBy("region_id").agg(F.min("kickoff").alias("a"), F.max("kickoff").alias("b"))
    code = F.element_at(F.array(*[F.lit(c) for c in ("PD", "PL", "CL", "SA", "BSA")]), F.col("region_id") % 5 + 1)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    body = F.struct(code.alias("code"), F.col("region_id").alias("id"), F.lit("Official").alias("name"), F.lit("LEAGUE").alias("type"), F.struct(day("a").alias("startDate"), day("b").alias("endDate")).alias("currentSeason"))
    raw = o.select(F.from_json(F.to_json(body), FD.COMPETITION).alias("r")).select("r.*")
    return FD.competitions(raw).select("code", "id", "name", "type", "season_start", "season_end")


# ---- API-Football
def raw_api_football(spark, d):
    """Goals, cards, changes and cancelled goals per match, in feed order; every
    fourth goal is reported late, so the two orders differ."""
    e = table(spark, d, "match_events").filter("(type = 'Shot' AND shot_outcome = 'Goal' AND period < 5) OR type IN ('Own Goal Against', 'Substitution') OR card IS NOT NULL")
    kind = F.when(F.col("type").isin("Shot", "Own Goal Against"), "Goal").when(F.col("type") == "Substitution", "subst").otherwise("Card")
    detail = F.when(F.col("type") == "Own Goal Against", "Own Goal").when(F.col("shot_type") == "Penalty", "Penalty").when(F.col("type") == "Shot", "Normal Goal").when(
        F.col("card") == "Second Yellow", "Second Yellow card").otherwise(F.coalesce("card", F.lit("Substitution 1")))
    late = F.when((F.col("type") == "Shot") & (F.col("event_id") % 4 == 0), 60).otherwise(0)
    player = _ref(F.col("player_id"), F.col("player"))
    ev = e.select("match_id", (F.col("idx") + late).alias("o"), F.col("event_id").alias("k"), F.struct(F.struct(F.col("minute").alias("elapsed")).alias("time"), _ref(F.col("team_id"), F.col("team")).alias("team"), player.alias("player"),
                  _pl("sub_player_id").alias("assist"), kind.alias("type"), detail.alias("detail"), F.lit(None).cast("string").alias("comments")).alias("e"))
    k = table(spark, d, "corrections").filter("kind = 'disallow'").join(table(spark, d, "match_events").select("match_id", F.col("event_id").alias("supersedes"), "team_id", "team", "idx", "minute"), ["match_id", "supersedes"])
    nobody = F.lit(None).cast("struct<id:bigint,name:string>")
    var = k.select("match_id", (F.col("idx") + 70).alias("o"), F.col("supersedes").alias("k"), F.struct(F.struct((F.col("minute") + 3).alias("elapsed")).alias("time"), _ref(F.col("team_id"), F.col("team")).alias("team"), nobody.alias("player"), nobody.alias("assist"),
                   F.lit("Var").alias("type"), F.when(F.col("supersedes") % 2 == 0, "Goal cancelled").otherwise("Penalty confirmed").alias("detail"), F.lit(None).cast("string").alias("comments")).alias("e"))
    all_ = ev.unionByName(var).groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "k", "e"))), lambda s: s["e"]).alias("response"))
    return all_.select(F.from_json(F.to_json(F.struct("match_id", "response")), AF.EVENTS).alias("r")).select("r.*")


def af_events(spark, d):
    return AF.events(raw_api_football(spark, d)).select("match_id", "event_id", "idx", "period", "minute", "type", "team_id", "player_id", "shot_outcome", "shot_type", "card", "sub_player_id")


def af_corrections(spark, d):
    return AF.corrections(raw_api_football(spark, d))


# ---- social
def _social_base(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.concat(F.lit("u"), (F.col("doc_id") % 9).cast("string")).alias("user"))
    return docs.withColumn("at", F.concat(F.lit("2024-01-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("T10:00:00Z")))


def social_posts(spark, d):
    b, i = _social_base(spark, d), F.col("id")
    sid = i.cast("string")
    parse = lambda df, body, schema: df.select(F.from_json(F.to_json(body), schema).alias("r")).select("r.*")
    mast = parse(b.filter("id % 4 = 0"), F.struct(
        F.concat(F.lit("https://m.example/"), sid).alias("uri"), F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("</p>")).alias("content"), F.col("at").alias("created_at"),
        F.col("lang").alias("language"), (i % 8 == 4).alias("sensitive"), F.lit("public").alias("visibility"), F.struct(F.col("user").alias("acct")).alias("account"), i.alias("favourites_count")), SS.MASTODON)
    blue = parse(b.filter("id % 4 = 1"), F.struct(
        F.concat(F.lit("at://did/post/"), sid).alias("uri"), F.struct(F.col("user").alias("handle")).alias("author"), F.struct("text", F.col("at").alias("createdAt"), F.array("lang").alias("langs")).alias("record"),
        F.array(F.struct(F.when(i % 8 == 5, "gore").otherwise("ok").alias("val"))).alias("labels"), i.alias("likeCount")), SS.BLUESKY)
    red = parse(b.filter("id % 4 = 2"), F.struct(sid.alias("id"), F.concat(F.lit("Title "), sid).alias("title"), F.col("text").alias("selftext"), F.col("user").alias("author"), F.lit("/r/x").alias("permalink"),
                                                 (i * 1000.0).alias("created_utc"), (i % 8 == 6).alias("over_18"), i.alias("score")), SS.REDDIT)
    xs = parse(b.filter("id % 4 = 3"), F.struct(sid.alias("id"), "text", F.col("at").alias("created_at"), "lang", (i % 8 == 7).alias("possibly_sensitive"), F.struct(F.col("user").alias("username")).alias("user"),
                                                F.struct(i.alias("like_count")).alias("public_metrics")), SS.X)
    out = SS.mastodon(mast).unionByName(SS.bluesky(blue)).unionByName(SS.reddit(red)).unionByName(SS.x(xs))
    return out


def social_normalised(spark, d):
    return social_posts(spark, d).select("id", "network", "author_handle", "created_at", "lang", "likes", F.round("ts", 0).alias("ts"))


def reddit_atom(spark, d):
    """The public feed's entries as XML, one a page."""
    p = table(spark, d, "pages")
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<entry><id>t3_"), F.col("page_id").cast("string"), F.lit("</id><title> Page "), F.col("page_id").cast("string"), F.lit(' </title><link href="'), esc(F.col("url")), F.lit('"/><author><name>/u/a'),
                   (F.col("page_id") % 7).cast("string"), F.lit("</name></author><published>2024-01-02T00:00:00+00:00</published><content>&lt;a href=&quot;"), esc(F.col("url")), F.lit("&quot;&gt;x&lt;/a&gt;</content></entry>"))
    raw = p.select(F.from_xml(xml, SS.ATOM).alias("r")).select("r.*")
    return SS.reddit_atom(raw).select("id", "url", "author_handle", "text", "ts")


# ---- records and documents
def codec(spark, d):
    """Events and corrections through JSON and back."""
    e, k = table(spark, d, "match_events").drop("match_day"), table(spark, d, "corrections")
    recs = RC.encode(e, "event").unionByName(RC.encode(k, "correction"))
    e2, k2 = RC.decode(recs, "event", e.schema), RC.decode(recs, "correction", k.schema)
    cols = lambda df, i: df.select(F.col(i).cast("string").alias("id"), "match_id", "period", F.round(F.coalesce("shot_xg" if i == "event_id" else "new_xg", F.lit(0.0)), 6).alias("xg"))
    return cols(e2, "event_id").unionByName(cols(k2, "correction_id"))


def log_append(spark, d):
    """The same batch appended twice, and an overlapping one: no repeats."""
    e = table(spark, d, "match_events").select("match_id", "event_id", "type", "minute")
    root = scratch(spark, "log")
    RC.append_log(e.filter("match_id % 2 = 0"), root)
    RC.append_log(e.filter("match_id % 2 = 0"), root)
    RC.append_log(e, root)
    return RC.read_log(spark, root, e.schema).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


def documents(spark, d):
    """Match documents written in parts and read back."""
    root = scratch(spark, "documents")
    p = NW.counted_passes(table(spark, d, "match_events"))
    parts = {"state": NA.winners(spark, d), "report": RC_report(spark, d), "series": PR.series(spark, d),
             "shots": TL.shot_map(table(spark, d, "match_events"), C.verdicts(spark, d), C.sides(spark, d)), "network": NW.nodes(p)}
    RC.write_documents(parts, root)
    return RC.document_index({n: RC.read_part(spark, root, n) for n in RC.PARTS})


def RC_report(spark, d):
    from touchline.operators import report as RP

    return RP.ledes(NA._goals(spark, d), NA.winners(spark, d))


#: The feed of a derived match, and its short state there.
FEED_OF = "CASE match_id % 3 WHEN 0 THEN 'statsbomb' WHEN 1 THEN 'football-data' ELSE 'api-football' END"
SHORT = ("1H", "HT", "2H", "ET", "P", "LIVE", "BT", "FT", "AET", "PEN", "NS", "TBD", "PST")
SHORT_OF = "CASE " + " ".join(f"WHEN match_id % {len(SHORT)} = {i} THEN '{s}'" for i, s in enumerate(SHORT)) + " END"


def feed_gaps(spark, d):
    """What the feed of each match doesn't provide, in words."""
    return CP.missing(table(spark, d, "matches").select("match_id", F.expr(FEED_OF).alias("feed")))


def api_football_status(spark, d):
    return table(spark, d, "matches").select("match_id", F.expr(SHORT_OF).alias("short")).withColumn("status", AF.status(F.col("short")))


def _gaps_sql() -> str:
    sentence = lambda name, what: (CP.MISSING % (name, what)).replace("'", "''")
    rows = [(f[0], c, sentence(f[1], CP.CALLED[c])) for f in CP.FEEDS for c, has in zip(CP.CALLED, f[2:]) if not has]
    values = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows)
    return f"SELECT match_id, feed, capability, explanation FROM (SELECT match_id, {FEED_OF} AS feed FROM matches) JOIN (VALUES {values}) v(feed, capability, explanation) USING (feed)"


QUERIES = {
    "feed_gaps": feed_gaps,
    "api_football_status": api_football_status,
    "statsbomb_events": statsbomb_events,
    "statsbomb_freeze_frames": freeze_frames,
    "nicknames": nicknamed,
    "lineups": lineups,
    "football_data_events": fd_events,
    "fixture_cards": fixture_cards,
    "current_standings": current_standings,
    "current_scorers": current_scorers,
    "current_competitions": current_competitions,
    "api_football_events": af_events,
    "api_football_corrections": af_corrections,
    "social_normalised": social_normalised,
    "social_reddit_atom": reddit_atom,
    "codec_roundtrip": codec,
    "log_append": log_append,
    "documents_parts": documents,
}

_S = lambda c: f"CAST({c} AS VARCHAR) AS {c}"
_sb = ", ".join(_S(c) if c in ("event_id", "team_id", "player_id", "pass_recipient_id", "sub_player_id") else ("CAST(match_id AS BIGINT) AS match_id" if c == "match_id" else c) for c in SB_COLS)
_MM = "CASE WHEN minute <= 90 THEN minute ELSE 90 END"
_AD = "CASE WHEN minute > 90 THEN minute - 90 ELSE 0 END"
_PER = "CASE WHEN {m} <= 45 THEN 1 WHEN {m} <= 90 THEN 2 WHEN {m} <= 105 THEN 3 ELSE 4 END"


def _fd(kind, where, typ, so, st, card, sub):
    return f"""SELECT CAST(match_id AS BIGINT) AS match_id, concat('fd-', match_id, '-{kind}-', {_MM}, '-', {_AD}, '-', player_id) AS event_id, {_MM} * 100 + {_AD} AS idx, {_PER.format(m=_MM)} AS period, minute, {typ} AS type,
      CAST(team_id AS VARCHAR) AS team_id, CAST(player_id AS VARCHAR) AS player_id, player, {so} AS shot_outcome, {st} AS shot_type, {card} AS card, {sub} AS sub_player_id FROM match_events WHERE {where}"""


GOALW = "(type = 'Shot' AND shot_outcome = 'Goal' AND period < 5) OR type = 'Own Goal Against'"
AFSQL = """SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY o, k) - 1 AS INT) AS i, * EXCLUDE (match_id) FROM (
   SELECT match_id, idx + CASE WHEN type = 'Shot' AND event_id % 4 = 0 THEN 60 ELSE 0 END AS o, event_id AS k, CASE WHEN type IN ('Shot', 'Own Goal Against') THEN 'Goal' WHEN type = 'Substitution' THEN 'subst' ELSE 'Card' END AS kind,
     type, minute, team_id, player_id, shot_type, card, sub_player_id, NULL AS detail FROM match_events WHERE (type = 'Shot' AND shot_outcome = 'Goal' AND period < 5) OR type IN ('Own Goal Against', 'Substitution') OR card IS NOT NULL
   UNION ALL SELECT k.match_id, e.idx + 70, k.supersedes, 'Var', NULL, e.minute + 3, e.team_id, NULL, NULL, NULL, NULL, CASE WHEN k.supersedes % 2 = 0 THEN 'Goal cancelled' ELSE 'Penalty confirmed' END
     FROM corrections k JOIN match_events e ON e.match_id = k.match_id AND e.event_id = k.supersedes WHERE k.kind = 'disallow')"""
AFE = f"""SELECT CAST(match_id AS BIGINT) AS match_id, concat('af-', match_id, '-', i, '-', kind, '-', minute, '-', player_id) AS event_id, i AS idx, {_PER.format(m='minute')} AS period, minute,
   CASE WHEN kind = 'Goal' THEN type WHEN kind = 'Card' THEN 'Bad Behaviour' ELSE 'Substitution' END AS type, CAST(team_id AS VARCHAR) AS team_id, CAST(player_id AS VARCHAR) AS player_id,
   CASE WHEN type = 'Shot' THEN 'Goal' END AS shot_outcome, CASE WHEN type = 'Shot' THEN shot_type END AS shot_type, CASE WHEN kind = 'Card' THEN card END AS card, CAST(CASE WHEN kind = 'subst' THEN sub_player_id END AS VARCHAR) AS sub_player_id FROM afr WHERE kind <> 'Var'"""


def _me(q, *views, **ctes):
    return with_views(q, "match_events", *views, **ctes)


ORACLE = {
    "feed_gaps": with_views(_gaps_sql(), "matches"),
    "api_football_status": with_views(f"""SELECT match_id, short, CASE WHEN short IN ('1H', '2H', 'ET', 'P', 'LIVE', 'BT') THEN 'live' WHEN short = 'HT' THEN 'half_time'
        WHEN short IN ('FT', 'AET', 'PEN') THEN 'finished' ELSE 'scheduled' END AS status FROM (SELECT match_id, {SHORT_OF} AS short FROM matches)""", "matches"),
    "statsbomb_events": _me(f"SELECT {_sb}, round(shot_xg, 6) AS shot_xg, pass_shot_assist, pass_goal_assist FROM match_events"),
    "statsbomb_freeze_frames": _me("SELECT CAST(match_id AS BIGINT) AS match_id, CAST(event_id AS VARCHAR) AS event_id, y AS x, x AS y, TRUE AS teammate, TRUE AS keeper, player AS name FROM match_events WHERE type = 'Shot'"),
    "nicknames": _me("""SELECT CAST(match_id AS BIGINT) AS match_id, CAST(event_id AS VARCHAR) AS event_id, CAST(player_id AS VARCHAR) AS player_id, CASE WHEN player_id % 2 = 0 THEN concat('Nick ', player_id) ELSE player END AS player,
       CAST(sub_player_id AS VARCHAR) AS sub_player_id, CASE WHEN sub_player_id IN (SELECT player_id FROM match_events WHERE player_id % 2 = 0) THEN concat('Nick ', sub_player_id) WHEN sub_player_id IS NOT NULL THEN concat('Player ', sub_player_id) END AS sub_player FROM match_events"""),
    "lineups": _me("""SELECT CAST(match_id AS BIGINT) AS match_id, CASE WHEN team_id = home_id THEN 'home' ELSE 'away' END AS side, CAST(player_id AS VARCHAR) AS player_id, CASE WHEN player_id % 3 = 0 THEN concat('N', player_id) ELSE player END AS name,
       CASE WHEN player_id % 4 <> 0 THEN player_id % 30 ELSE -1 END AS number, position, min(idx) < 60 AS started, '' AS country FROM match_events GROUP BY match_id, team_id, home_id, player_id, player, position"""),
    "football_data_events": _me(" UNION ALL ".join([
        _fd("goals", GOALW, "type", "CASE WHEN type = 'Shot' THEN 'Goal' END", "CASE WHEN type = 'Shot' THEN shot_type END", "NULL", "NULL"),
        _fd("bookings", "card IS NOT NULL", "'Bad Behaviour'", "NULL", "NULL", "card", "NULL"),
        _fd("substitutions", "type = 'Substitution'", "'Substitution'", "NULL", "NULL", "NULL", "CAST(sub_player_id AS VARCHAR)")])),
    "fixture_cards": _me("""SELECT concat('fd-', match_id) AS id, ['PD', 'PL', 'CL', 'SA'][match_id % 4 + 1] AS code, ['La Liga', 'Official PL', 'Champions League', 'Official SA'][match_id % 4 + 1] AS competition, concat(match_date, 'T', kick_off, 'Z') AS kickoff,
       ['scheduled', 'scheduled', 'live', 'half_time', 'finished', 'finished', 'postponed', 'suspended', 'cancelled', 'scheduled'][match_id % 10 + 1] AS status, match_id % 20 AS matchday, 'Group Stage' AS stage,
       CAST(home_id AS VARCHAR) AS home_id, home AS home_name, concat(home, ' FC') AS home_full, away AS away_name FROM matches""", "matches"),
    "current_standings": with_views("""SELECT concat(region_id, '-', season_id) AS code, 3 AS matchday, 'Regular Season' AS stage, position, CAST(team_id AS VARCHAR) AS team_id, concat('Nation ', team_id) AS team,
       CAST(played AS INT) AS played, CAST(won AS INT) AS won, CAST(drawn AS INT) AS drawn, CAST(lost AS INT) AS lost, CAST(goals_for AS INT) AS goals_for, CAST(goals_against AS INT) AS goals_against,
       CAST(goal_difference AS INT) AS goal_difference, CAST(points AS INT) AS points FROM t_final""", "results_region", h2h=TB.h2h_sql("results_region", TB.BY), **TB.standings_ctes("t", "h2h", TB.BY, "PL")),
    "current_scorers": f"""SELECT 'PD' AS code, CAST(row_number() OVER (ORDER BY value DESC, player_id) AS INT) AS n, player, team, CAST(matches AS INT) AS played, CAST(value AS INT) AS goals FROM ({A._leaderboard_sql('goals')})""",
    "current_competitions": with_views("""SELECT ['PD', 'PL', 'CL', 'SA', 'BSA'][region_id % 5 + 1] AS code, CAST(region_id AS VARCHAR) AS id, ['La Liga', 'Official', 'Champions League', 'Official', 'Brasileirão'][region_id % 5 + 1] AS name, 'LEAGUE' AS type,
       strftime(min(kickoff), '%Y-%m-%d') AS season_start, strftime(max(kickoff), '%Y-%m-%d') AS season_end FROM results_region GROUP BY region_id""", "results_region"),
    "api_football_events": _me("SELECT * FROM afe", "corrections", afr=AFSQL, afe=AFE),
    "api_football_corrections": _me("""SELECT concat('af-var-', match_id, '-', i) AS correction_id, match_id, supersedes, 'disallow' AS kind, 'Goal cancelled' AS reason, 'VAR' AS authority, period, greatest(vm, gm) AS decided_at_minute, FALSE AS synthesised FROM (
       SELECT v.i, v.minute AS vm, CAST(v.match_id AS BIGINT) AS match_id, arg_max(g.event_id, g.idx) AS supersedes, arg_max(g.period, g.idx) AS period, arg_max(g.minute, g.idx) AS gm FROM afr v JOIN afe g ON g.match_id = v.match_id AND g.team_id = CAST(v.team_id AS VARCHAR)
         AND g.shot_outcome = 'Goal' AND g.idx < v.i AND g.minute <= v.minute WHERE v.kind = 'Var' AND v.detail = 'Goal cancelled' GROUP BY v.i, v.minute, v.match_id)""", "corrections", afr=AFSQL, afe=AFE),
    "codec_roundtrip": _me("""SELECT CAST(event_id AS VARCHAR) AS id, match_id, period, round(coalesce(shot_xg, 0), 6) AS xg FROM match_events UNION ALL SELECT correction_id, match_id, period, round(coalesce(new_xg, 0), 6) FROM corrections""", "corrections"),
    "log_append": _me("SELECT match_id, count(*) AS n FROM match_events GROUP BY match_id"),
}
