"""Raw event JSON of the deep feed -> canonical events.

A field the feed does not send stays null; nothing is invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "statsbomb"
_REF = "struct<id:bigint,name:string>"
RAW = (
    f"id string, index int, period int, timestamp string, minute int, second int, type {_REF}, team {_REF}, player {_REF}, position {_REF}, "
    f"possession int, possession_team {_REF}, play_pattern {_REF}, location array<double>, duration double, under_pressure boolean, "
    "counterpress boolean, out boolean, related_events array<string>, "
    f"shot struct<statsbomb_xg:double,outcome:{_REF},type:{_REF},body_part:{_REF},technique:{_REF},end_location:array<double>,key_pass_id:string,"
    f"first_time:boolean,one_on_one:boolean,freeze_frame:array<struct<location:array<double>,teammate:boolean,position:{_REF},player:{_REF}>>>, "
    f"pass struct<recipient:{_REF},length:double,angle:double,height:{_REF},end_location:array<double>,body_part:{_REF},type:{_REF},outcome:{_REF},"
    "technique:" + _REF + ",cross:boolean,cut_back:boolean,switch:boolean,through_ball:boolean,shot_assist:boolean,goal_assist:boolean>, "
    f"carry struct<end_location:array<double>>, foul_committed struct<card:{_REF}>, bad_behaviour struct<card:{_REF}>, duel struct<type:{_REF}>, substitution struct<replacement:{_REF}>, tactics string"
)
LINEUP = ("team_id bigint, team_name string, lineup array<struct<player_id:bigint,player_name:string,player_nickname:string,jersey_number:int,"
          "country:struct<name:string>,positions:array<struct<position:string,start_reason:string>>>>")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per match file, named by the match id."""
    raw = spark.read.schema(RAW).option("multiLine", True).json(path)
    return raw.withColumn("match_id", F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("long"))


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(LINEUP).option("multiLine", True).json(path)
    return raw.withColumn("match_id", F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("long"))


def _at(c: str, i: int) -> Column:
    return F.try_element_at(F.col(c), F.lit(i))


def _flag(c: str, block: str) -> Column:
    return F.when(F.col(block).isNotNull(), F.coalesce(c, F.lit(False)))


def normalise(raw: DataFrame, nicknames: DataFrame | None = None) -> DataFrame:
    """Parsed raw rows (`match_id` + RAW) as flat canonical events."""
    sid = lambda c: F.col(f"{c}.id").cast("string")
    loc = F.size("location") >= 2
    end = F.when(F.col("pass").isNotNull(), F.col("pass.end_location")).otherwise(F.coalesce("carry.end_location", "shot.end_location"))
    seen = F.filter(F.coalesce("shot.freeze_frame", F.array()), lambda a: F.size(a["location"]) >= 2)
    frame = F.transform(seen, lambda a: F.struct(a["location"][0].alias("x"), a["location"][1].alias("y"), F.coalesce(a["teammate"], F.lit(False)).alias("teammate"),
                                                 F.coalesce(a["position"]["name"] == "Goalkeeper", F.lit(False)).alias("keeper"), F.coalesce(a["player"]["name"], F.lit("")).alias("name")))
    out = raw.select(
        "match_id", F.col("id").alias("event_id"), F.coalesce("index", F.lit(0)).alias("idx"), F.coalesce("period", F.lit(1)).alias("period"),
        F.coalesce("timestamp", F.lit("00:00:00.000")).alias("timestamp"), F.coalesce("minute", F.lit(0)).alias("minute"), F.coalesce("second", F.lit(0)).alias("second"),
        F.col("type.name").alias("type"), F.col("play_pattern.name").alias("play_pattern"), F.coalesce("possession", F.lit(0)).alias("possession"),
        sid("team").alias("team_id"), F.col("team.name").alias("team"), sid("player").alias("player_id"), F.col("player.name").alias("player"),
        F.col("position.name").alias("position"), F.when(loc, _at("location", 1)).alias("x"), F.when(loc, _at("location", 2)).alias("y"),
        F.try_element_at(end, F.lit(1)).alias("end_x"), F.try_element_at(end, F.lit(2)).alias("end_y"),
        F.coalesce("under_pressure", F.lit(False)).alias("under_pressure"), "duration", F.coalesce("counterpress", F.lit(False)).alias("counterpress"),
        F.coalesce("out", F.lit(False)).alias("out"), "related_events",
        F.when(F.col("pass").isNotNull(), F.coalesce("pass.outcome.name", F.lit("Complete"))).alias("pass_outcome"),
        F.col("pass.type.name").alias("pass_type"), F.col("pass.length").alias("pass_length"), F.col("pass.recipient.id").cast("string").alias("pass_recipient_id"),
        F.col("pass.recipient.name").alias("pass_recipient"),
        *[_flag(f"pass.{c}", "pass").alias(f"pass_{c}") for c in ("cross", "through_ball", "shot_assist", "goal_assist", "cut_back", "switch")],
        F.col("shot.statsbomb_xg").alias("shot_xg"), F.col("shot.outcome.name").alias("shot_outcome"), F.col("shot.type.name").alias("shot_type"),
        F.col("shot.body_part.name").alias("shot_body_part"), F.col("shot.technique.name").alias("shot_technique"), F.col("shot.key_pass_id").alias("shot_key_pass_id"),
        F.when(F.col("shot").isNotNull(), frame).alias("freeze"), F.coalesce("foul_committed.card.name", "bad_behaviour.card.name").alias("card"),
        F.col("duel.type.name").alias("duel_type"), F.col("substitution.replacement.id").cast("string").alias("sub_player_id"),
        F.col("substitution.replacement.name").alias("sub_player"), "tactics", F.lit(FEED).alias("source_feed"), F.col("id").alias("source_event_id"))
    return out if nicknames is None else with_nicknames(out, nicknames)


def nicknames(lineups: DataFrame) -> DataFrame:
    """player_id -> the name a broadcaster would use, per match."""
    p = lineups.select("match_id", F.explode("lineup").alias("p")).filter(F.coalesce("p.player_nickname", F.lit("")) != "")
    return p.groupBy("match_id", F.col("p.player_id").cast("string").alias("player_id")).agg(F.max("p.player_nickname").alias("nickname"))


def with_nicknames(events: DataFrame, names: DataFrame) -> DataFrame:
    """Players and incoming substitutes by nickname where there is one."""
    key = [c for c in ("match_id",) if c in names.columns]
    for c, n in (("player_id", "player"), ("sub_player_id", "sub_player")):
        if c in events.columns:
            nick = names.select(*key, F.col("player_id").alias(c), F.col("nickname").alias("__nick"))
            events = events.join(nick, [*key, c], "left").withColumn(n, F.coalesce("__nick", n)).drop("__nick")
    return events


def lineups(raw: DataFrame, matches: DataFrame) -> DataFrame:
    """Line-ups: starters first, then by shirt; an unknown number sorts as 99."""
    j = raw.join(matches.select("match_id", "home_id"), "match_id")
    first = F.try_element_at("p.positions", F.lit(1))
    rows = j.select("match_id", F.when(F.col("team_id") == F.col("home_id"), "home").otherwise("away").alias("side"), F.explode("lineup").alias("p")).select(
        "match_id", "side", F.col("p.player_id").cast("string").alias("player_id"), F.coalesce("p.player_nickname", "p.player_name").alias("name"),
        F.col("p.jersey_number").alias("number"), F.coalesce(first["position"], F.lit("")).alias("position"),
        F.coalesce(first["start_reason"] == "Starting XI", F.lit(False)).alias("started"), F.coalesce("p.country.name", F.lit("")).alias("country"))
    return rows.orderBy("match_id", "side", ~F.col("started"), F.coalesce("number", F.lit(99)), "player_id")
