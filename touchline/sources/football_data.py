"""Current-season feed: matches with goals, bookings and changes; fixture cards,
tables, scorers and competitions.  It sends no coordinates and no xG."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch as P

FEED = "football-data"
# The feed's words in ours.
STATUS = {"SCHEDULED": "scheduled", "TIMED": "scheduled", "IN_PLAY": "live", "PAUSED": "half_time", "FINISHED": "finished", "AWARDED": "finished",
          "POSTPONED": "postponed", "SUSPENDED": "suspended", "CANCELLED": "cancelled"}
NAMES = {"PD": "La Liga", "BSA": "Brasileirão", "CL": "Champions League", "EC": "European Championship", "WC": "World Cup", "CLI": "Copa Libertadores"}
CARDS = {"YELLOW": "Yellow Card", "YELLOW_RED": "Second Yellow", "RED": "Red Card"}

_P = "struct<id:bigint,name:string>"
_TEAM = "struct<id:bigint,name:string,shortName:string,tla:string>"
_HA = "struct<home:int,away:int>"
MATCH = (f"id bigint, utcDate string, status string, matchday int, stage string, competition struct<id:bigint,name:string,code:string>, homeTeam {_TEAM}, awayTeam {_TEAM}, "
         f"score struct<fullTime:{_HA},halfTime:{_HA}>, goals array<struct<minute:int,injuryTime:int,type:string,team:{_P},scorer:{_P}>>, "
         f"bookings array<struct<minute:int,injuryTime:int,team:{_P},player:{_P},card:string>>, "
         f"substitutions array<struct<minute:int,injuryTime:int,team:{_P},playerOut:{_P},playerIn:{_P}>>")
STANDINGS = (f"code string, season struct<currentMatchday:int>, standings array<struct<type:string,stage:string,`group`:string,table:array<struct<position:int,team:{_TEAM},"
             "playedGames:int,won:int,draw:int,lost:int,goalsFor:int,goalsAgainst:int,goalDifference:int,points:int,form:string>>>>")
SCORERS = f"code string, scorers array<struct<player:struct<name:string,nationality:string>,team:{_TEAM},playedMatches:int,goals:int,assists:int,penalties:int>>"
COMPETITION = "code string, id bigint, name string, type string, area struct<name:string>, currentSeason struct<startDate:string,endDate:string,currentMatchday:int>"


def lookup(c: Column, mapping: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), other)


def _title(c: str) -> Column:
    return F.initcap(F.translate(F.coalesce(c, F.lit("")), "_", " "))


def _kind(m: DataFrame, kind: str, who: Column, extra: dict[str, Column]) -> DataFrame:
    """One of the three arrays as canonical rows."""
    e = m.select(F.col("id").alias("match_id"), F.posexplode(kind).alias("i", "e"))
    minute, added = F.coalesce("e.minute", F.lit(0)), F.coalesce("e.injuryTime", F.lit(0))
    ref = F.coalesce(who["id"].cast("string"), F.col("i").cast("string"))
    eid = F.concat_ws("-", F.lit("fd"), F.col("match_id").cast("string"), F.lit(kind), minute.cast("string"), added.cast("string"), ref)
    return e.select("match_id", eid.alias("event_id"), (minute * 100 + added).alias("idx"), P.period_from_minute(minute).alias("period"),
                    (minute + added).alias("minute"), F.lit(0).alias("second"), F.col("e.team.id").cast("string").alias("team_id"), F.col("e.team.name").alias("team"),
                    who["id"].cast("string").alias("player_id"), who["name"].alias("player"), F.lit(FEED).alias("source_feed"), eid.alias("source_event_id"),
                    *[v.alias(k) for k, v in extra.items()])


def events(matches: DataFrame) -> DataFrame:
    """Goals, bookings and changes of every match, with ids derived from what
    the feed does send: the same payload gives the same id."""
    own, null = F.col("e.type") == "OWN", F.lit(None).cast("string")
    goals = _kind(matches, "goals", F.col("e.scorer"), {
        "type": F.when(own, "Own Goal Against").otherwise("Shot"), "shot_outcome": F.when(F.coalesce(own, F.lit(False)), null).otherwise("Goal"),
        "shot_type": F.when(F.coalesce(own, F.lit(False)), null).when(F.col("e.type") == "PENALTY", "Penalty").otherwise("Open Play")})
    cards = _kind(matches, "bookings", F.col("e.player"), {"type": F.lit("Bad Behaviour"), "card": lookup(F.col("e.card"), CARDS, null)})
    subs = _kind(matches, "substitutions", F.col("e.playerOut"), {
        "type": F.lit("Substitution"), "sub_player_id": F.col("e.playerIn.id").cast("string"), "sub_player": F.col("e.playerIn.name")})
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (goals, cards, subs))


def _team(c: str) -> list[Column]:
    side = c.removesuffix("Team")
    return [F.col(f"{c}.id").cast("string").alias(f"{side}_id"), F.coalesce(f"{c}.shortName", f"{c}.name", F.lit("TBC")).alias(f"{side}_name"),
            F.coalesce(f"{c}.name", F.lit("")).alias(f"{side}_full"), F.coalesce(f"{c}.tla", F.lit("")).alias(f"{side}_code")]


def fixture_cards(matches: DataFrame) -> DataFrame:
    """A match as a display-ready fixture."""
    code = F.coalesce("competition.code", F.lit(""))
    return matches.select(
        F.concat(F.lit("fd-"), F.col("id").cast("string")).alias("id"), F.lit(FEED).alias("source"), code.alias("code"),
        lookup(code, NAMES, F.coalesce("competition.name", F.lit(""))).alias("competition"), F.coalesce("utcDate", F.lit("")).alias("kickoff"),
        lookup(F.coalesce("status", F.lit("")), STATUS, F.lit("scheduled")).alias("status"), "matchday", _title("stage").alias("stage"),
        *_team("homeTeam"), *_team("awayTeam"), F.col("score.fullTime.home").alias("home_score"), F.col("score.fullTime.away").alias("away_score"),
        F.col("score.halfTime.home").alias("home_half_time"), F.col("score.halfTime.away").alias("away_half_time"))


def standings(raw: DataFrame) -> DataFrame:
    """Current tables, totals only, one row per team."""
    t = raw.select("code", F.col("season.currentMatchday").alias("matchday"), F.explode("standings").alias("s")).filter("s.type = 'TOTAL'")
    r = t.select("code", "matchday", _title("s.stage").alias("stage"), F.coalesce("s.group", F.lit("")).alias("group"), F.explode("s.table").alias("r"))
    return r.select("code", "matchday", "stage", "group", F.col("r.position").alias("position"), F.col("r.team.id").cast("string").alias("team_id"),
                    F.coalesce("r.team.shortName", "r.team.name", F.lit("TBC")).alias("team"), F.col("r.playedGames").alias("played"), F.col("r.won").alias("won"),
                    F.col("r.draw").alias("drawn"), F.col("r.lost").alias("lost"), F.col("r.goalsFor").alias("goals_for"), F.col("r.goalsAgainst").alias("goals_against"),
                    F.col("r.goalDifference").alias("goal_difference"), F.col("r.points").alias("points"), F.col("r.form").alias("form"))


def scorers(raw: DataFrame) -> DataFrame:
    s = raw.select("code", F.posexplode("scorers").alias("n", "s"))
    return s.select("code", (F.col("n") + 1).alias("n"), F.coalesce("s.player.name", F.lit("")).alias("player"), F.coalesce("s.player.nationality", F.lit("")).alias("nationality"),
                    F.coalesce("s.team.shortName", "s.team.name", F.lit("TBC")).alias("team"), F.col("s.playedMatches").alias("played"),
                    F.coalesce("s.goals", F.lit(0)).alias("goals"), F.col("s.assists").alias("assists"), F.col("s.penalties").alias("penalties"))


def competitions(raw: DataFrame) -> DataFrame:
    code = F.coalesce("code", F.lit(""))
    return raw.select(code.alias("code"), F.col("id").cast("string").alias("id"), lookup(code, NAMES, F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("type", F.lit("")).alias("type"),
                      F.coalesce("area.name", F.lit("")).alias("area"), F.coalesce("currentSeason.startDate", F.lit("")).alias("season_start"),
                      F.col("currentSeason.endDate").alias("season_end"), F.col("currentSeason.currentMatchday").alias("matchday"))
