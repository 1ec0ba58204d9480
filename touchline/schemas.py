"""Fixed schemas.  Readers always pass one; nothing is inferred or merged."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


L, I, S, D, B = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType()

#: The flat archive row (fixed column list), plus the two Hive partition columns
#: and the ids that corrections and pressing metrics need.
ARCHIVE = _struct(
    match_id=L, match_date=S, idx=I, period=I, minute=I, second=I, type=S, play_pattern=S,
    possession=I, team_id=S, team=S, player_id=S, player=S, position=S, x=D, y=D, end_x=D,
    end_y=D, under_pressure=B, pass_outcome=S, pass_type=S, pass_length=D, pass_recipient_id=S,
    pass_cross=B, pass_through_ball=B, pass_shot_assist=B, pass_goal_assist=B, shot_xg=D,
    shot_outcome=S, shot_type=S, shot_body_part=S, card=S, source_feed=S,
    event_id=S, duel_type=S, competition_id=I, season_id=I,
)

FREEZE = T.ArrayType(_struct(x=D, y=D, teammate=B, keeper=B, name=S))

#: Canonical events: the archive row plus what only the match layer reads.
CANONICAL = T.StructType(
    [f for f in ARCHIVE.fields if f.name not in ("match_date", "competition_id", "season_id")]
    + _struct(
        timestamp=S, possession_team_id=S, possession_team=S, duration=D, counterpress=B, out=B,
        related_events=T.ArrayType(S), pass_recipient=S, pass_angle=D, pass_height=S,
        pass_body_part=S, pass_technique=S, pass_cut_back=B, pass_switch=B, shot_technique=S,
        shot_key_pass_id=S, shot_first_time=B, shot_one_on_one=B, freeze=FREEZE,
        sub_player_id=S, sub_player=S, tactics=S, source_event_id=S,
    ).fields
)

#: A correction record.  The payload is typed: only these four keys are honoured.
CORRECTION = _struct(
    correction_id=S, match_id=L, supersedes=S, kind=S, reason=S, authority=S, period=I,
    decided_at_minute=I, synthesised=B, new_player_id=S, new_player=S, new_team_id=S,
    new_team=S, new_minute=I, new_xg=D,
)

#: What a replayed or live feed carries: one JSON body per record, and its place
#: in the feed where the feed has one.
STREAM_RECORD = _struct(kind=S, match_id=L, body=S, seq=L)

POST = _struct(
    id=S, network=S, url=S, author_name=S, author_handle=S, author_avatar=S, author_url=S,
    text=S, created_at=S, ts=D, lang=S, likes=L, reposts=L, replies=L,
    media=T.ArrayType(_struct(thumb=S, alt=S)),
)
