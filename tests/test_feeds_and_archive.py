"""Feeds, archive layouts, metrics on small hand-made logs, the live log."""

import json

from pyspark.sql import functions as F

from tests.conftest import correction, event, frames, goal, starting_log
from touchline.operators import leaderboard as LB
from touchline.operators import metrics as ME
from touchline.operators import network as NW
from touchline.operators import timeline as TL
from touchline.session import scratch
from touchline.sources import api_football as AF
from touchline.sources import archive as AR
from touchline.sources import football_data as FD
from touchline.sources import statsbomb as SB
from touchline.streaming import live as LV


def parse(spark, rows, schema):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.from_json("j", schema).alias("r")).select("r.*")


def test_cancelled_goal_takes_the_latest_earlier_one(spark):
    t = lambda m, team, typ, det: {"time": {"elapsed": m}, "team": {"id": team, "name": "T"}, "player": {"id": 9, "name": "P"}, "type": typ, "detail": det}
    resp = [t(10, 1, "Goal", "Normal Goal"), t(30, 1, "Goal", "Normal Goal"), t(25, 1, "Goal", "Normal Goal"), t(28, 1, "Var", "Goal cancelled"), t(29, 2, "Var", "Goal cancelled"),
            t(40, 1, "Var", "Penalty confirmed"), t(50, 1, "Goal", "Missed Penalty"), t(51, 1, "Var", "Goal Disallowed - offside")]
    raw = parse(spark, [{"match_id": 7, "response": resp}], AF.EVENTS)
    got = {r["correction_id"]: (r["supersedes"], r["decided_at_minute"]) for r in AF.corrections(raw).collect()}
    assert got == {"af-var-7-3": ("af-7-2-Goal-25-9", 28), "af-var-7-7": ("af-7-2-Goal-25-9", 51)}


def test_football_data_shapes(spark):
    m = {"id": 5, "status": "PAUSED", "competition": {"id": 1, "code": "PD", "name": "Primera"}, "homeTeam": {"id": 1, "name": "A FC", "shortName": "A"}, "awayTeam": {"id": 2, "name": "B"},
         "goals": [{"minute": 45, "injuryTime": 2, "type": "PENALTY", "team": {"id": 1, "name": "A"}, "scorer": {"id": 8, "name": "S"}}, {"minute": 91, "type": "OWN", "team": {"id": 2, "name": "B"}, "scorer": None}],
         "bookings": [{"minute": 60, "team": {"id": 2, "name": "B"}, "player": {"id": 3, "name": "C"}, "card": "YELLOW_RED"}], "substitutions": []}
    raw = parse(spark, [m], FD.MATCH)
    ev = {r["event_id"]: r for r in FD.events(raw).collect()}
    assert set(ev) == {"fd-5-goals-45-2-8", "fd-5-goals-91-0-1", "fd-5-bookings-60-0-3"}
    assert (ev["fd-5-goals-45-2-8"]["period"], ev["fd-5-goals-45-2-8"]["minute"], ev["fd-5-goals-45-2-8"]["shot_type"]) == (1, 47, "Penalty")
    assert ev["fd-5-goals-91-0-1"]["type"] == "Own Goal Against" and ev["fd-5-bookings-60-0-3"]["card"] == "Second Yellow"
    card = FD.fixture_cards(raw).first()
    assert (card["competition"], card["status"], card["home_name"], card["away_name"]) == ("La Liga", "half_time", "A", "B")


def test_raw_event_files(spark, tmp_path):
    ev = [{"id": "a", "index": 1, "minute": 3, "type": {"id": 1, "name": "Shot"}, "team": {"id": 5, "name": "T"}, "player": {"id": 6, "name": "Legal Name"}, "location": [100.0, 40.0],
           "shot": {"statsbomb_xg": 0.1, "outcome": {"id": 1, "name": "Goal"}, "end_location": [120.0, 40.0, 1.0], "freeze_frame": [{"location": [1.0, 2.0], "teammate": True}]}},
          {"id": "b", "index": 2, "minute": 4, "type": {"id": 2, "name": "Pass"}, "pass": {"end_location": [1.0, 2.0]}, "foul_committed": {"card": {"id": 1, "name": "Red Card"}}}]
    (tmp_path / "77.json").write_text(json.dumps(ev))
    nick = spark.createDataFrame([(77, "6", "Nick")], "match_id long, player_id string, nickname string")
    rows = {r["event_id"]: r for r in SB.normalise(SB.read_events(spark, str(tmp_path)), nick).collect()}
    assert rows["a"]["match_id"] == 77 and rows["a"]["player"] == "Nick" and rows["a"]["end_x"] == 120.0 and rows["a"]["freeze"][0]["teammate"]
    assert rows["b"]["pass_outcome"] == "Complete" and rows["b"]["card"] == "Red Card" and rows["b"]["x"] is None and rows["b"]["freeze"] is None


def test_layouts_answer_alike(spark):
    rows = [(m, f"e{m}-{i}", i, 1, i % 90, "Shot" if i % 5 == 0 else "Pass", f"p{i % 4}" if i % 7 else None, "Goal" if i % 10 == 0 else "Saved", m % 3) for m in range(9) for i in range(120)]
    e = spark.createDataFrame(rows, "match_id long, event_id string, idx int, period int, minute int, type string, player_id string, shot_outcome string, season_id int")
    e = AR.conform(e.withColumns({"competition_id": F.lit(1), "match_date": F.concat(F.lit("2024-01-0"), (F.col("match_id") + 1).cast("string")), "player": F.col("player_id"), "team": F.lit("T")}))
    root, flat = scratch(spark, "t-archive"), scratch(spark, "t-flat")
    AR.write(e, root)
    AR.cluster_by_player(AR.read(spark, root), flat)
    tops = [LB.leaderboard(LB.player_match(AR.read(spark, p), ("goals",)), "goals").collect() for p in (root, flat)]
    assert tops[0] == tops[1] and len(tops[0]) == 2
    assert AR.read(spark, root).count() == AR.read(spark, flat).count() == len(rows)
    plan = AR.read(spark, root).filter("season_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_id" in plan


def test_metrics_credit_the_other_side(spark):
    ev = starting_log() + [event("og", 70, "Own Goal Against", "H", 2), event("p1", 5, x=10.0, y=40.0, end_x=50.0, end_y=40.0, pass_outcome="Complete"),
                           event("p2", 6, x=10.0, y=40.0, end_x=50.0, end_y=40.0, pass_outcome="Complete", pass_type="Throw-in"),
                           event("t1", 7, "Duel", "A", x=60.0, y=1.0, duel_type="Tackle"), event("t2", 8, "Duel", "A", x=60.0, y=1.0, duel_type="Aerial Lost")]
    e, _ = frames(spark, ev)
    sides = spark.createDataFrame([(1, "H", "A")], "match_id long, home_id string, away_id string")
    m = {r["side"]: r for r in ME.team_metrics(e, sides).collect()}
    assert (m["home"]["goals"], m["away"]["goals"]) == (2, 2)
    assert (m["away"]["ppda"], m["home"]["ppda"]) == (1.0, None) and m["home"]["progressive_passes"] == 2


def test_network_stops_at_the_first_change(spark):
    ev = [event(f"p{i}", i, x=50.0, y=40.0, end_x=60.0, end_y=30.0, pass_outcome="Complete", pass_recipient_id="H2", idx=i) for i in range(6)]
    ev += [event("s", 6, "Substitution", idx=6)] + [event(f"q{i}", 7 + i, x=0.0, y=0.0, end_x=0.0, end_y=0.0, pass_outcome="Complete", pass_recipient_id="H2") for i in range(9)]
    e, _ = frames(spark, ev)
    p = NW.counted_passes(e)
    n = {r["player_id"]: (r["x"], r["touches"]) for r in NW.nodes(p).collect()}
    assert n == {"H1": (50.0, 6), "H2": (60.0, 6)}
    assert [tuple(r) for r in NW.edges(p, NW.nodes(p)).select("a", "b", "passes").collect()] == [("H1", "H2", 6)]


def test_timeline_card_adds_a_second_row(spark):
    e, _ = frames(spark, [goal("g", 5, card="Yellow Card"), event("b", 6, "Shot", shot_outcome="Saved", shot_type="Penalty", shot_xg=0.8), event("c", 7, "Shot", shot_outcome="Post", shot_type="Open Play", shot_xg=0.29)])
    assert sorted((r["event_id"], r["kind"]) for r in TL.timeline(e).collect()) == [("b", "penalty_miss"), ("g", "card"), ("g", "goal")]


def test_live_log_equals_batch_and_tells_what_changed(spark):
    ev, ks = starting_log(), [correction("c1", "g2", "disallow", 43)]
    e, k = frames(spark, ev, ks)
    log = LV.LiveLog(spark, scratch(spark, "t-live"), e.schema, k.schema)
    none = k.filter("false")
    log.process(LV.encoded(e.filter("event_id <> 'g3'"), none), 0)
    log.process(LV.encoded(e.filter("event_id <> 'xi-h'"), k), 1)
    log.process(LV.encoded(e, k), 2)  # everything again
    s = log.states().first()
    assert (s["home_score"], s["away_score"]) == (1, 1)
    msgs = [(r["batch_id"], r["type"], r["text"]) for r in log.changes().collect()]
    assert (1, "correction_applied", "Goal disallowed - H-one's goal at 40' has been ruled out (offside). The score is now 1-1.") in msgs
    assert not [m for m in msgs if m[0] == 2]
    assert [(r["home_score"], r["away_score"]) for r in log.score_changes().orderBy("batch_id").collect()] == [(2, 0), (1, 1)]
    # a retried batch leaves no second copy
    log.process(LV.encoded(e, k), 2)
    assert log.visible("event").count() == len(ev)
