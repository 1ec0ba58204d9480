import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

EVENT = ("event_id string, match_id long, idx int, period int, minute int, second int, type string, team_id string, team string, player_id string, player string, "
         "shot_xg double, shot_outcome string, shot_type string, card string, x double, y double, end_x double, end_y double, pass_outcome string, pass_type string, "
         "pass_recipient_id string, duel_type string")
FIELDS = [f.strip().split(" ")[0] for f in EVENT.split(",")]
CORRECTION = ("correction_id string, match_id long, supersedes string, kind string, reason string, authority string, period int, decided_at_minute int, synthesised boolean, "
              "new_player_id string, new_player string, new_team_id string, new_team string, new_minute int, new_xg double")
C_FIELDS = [f.strip().split(" ")[0] for f in CORRECTION.split(",")]


@pytest.fixture(scope="session")
def spark():
    from touchline.session import build

    s = build("tests", **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
                          "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def event(eid, minute, type_="Pass", team="H", period=1, second=0, idx=None, **kw):
    row = dict.fromkeys(FIELDS)
    row.update(event_id=eid, match_id=1, idx=minute if idx is None else idx, period=period, minute=minute, second=second, type=type_, team_id=team, team=team,
               player_id=f"{team}1", player=f"{team}-one")
    row.update(kw)
    return row


def goal(eid, minute, team="H", period=1, **kw):
    return event(eid, minute, "Shot", team, period, shot_outcome="Goal", shot_type=kw.pop("shot_type", "Open Play"), shot_xg=kw.pop("xg", 0.2), **kw)


def correction(cid, event_id, kind, minute, period=1, **kw):
    row = dict.fromkeys(C_FIELDS)
    row.update(correction_id=cid, match_id=1, supersedes=event_id, kind=kind, reason="Offside", authority="VAR", period=period, decided_at_minute=minute, synthesised=False)
    row.update(kw)
    return row


def starting_log():
    return [event("xi-h", 0, "Starting XI", "H", idx=0), event("xi-a", 0, "Starting XI", "A", idx=1), goal("g1", 20), goal("g2", 40), goal("g3", 62, "A", 2)]


def frames(spark, events, corrections=()):
    e = spark.createDataFrame([[r[f] for f in FIELDS] for r in events], EVENT)
    k = spark.createDataFrame([[r[f] for f in C_FIELDS] for r in corrections], CORRECTION)
    return e, k


def state_of(spark, events, corrections=()):
    from touchline.operators import log as LG
    from touchline.operators import state as ST

    e, k = frames(spark, events, corrections)
    e, k = LG.distinct_events(e), LG.distinct_corrections(k)
    return ST.match_state(LG.corrected_events(e, LG.resolve(k)), ST.discover_sides(e)).first()
