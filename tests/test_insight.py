"""Expected threat and assists, possession chains, packing, feed conflicts and resets in order."""

import math
import random
from collections import defaultdict

import pytest

from tests.conftest import C_FIELDS, CORRECTION, EVENT, FIELDS, event
from touchline.operators import chains as CN
from touchline.operators import conflicts as CF
from touchline.operators import creation as CR
from touchline.operators import packing as PK
from touchline.operators import threat as TH


def frame(spark, rows, extra=""):
    names = FIELDS + [c.split()[0] for c in extra.split(", ") if c]
    return spark.createDataFrame([[r.get(f) for f in names] for r in rows], EVENT + (", " + extra if extra else ""))


def zone(x, y):
    return min(15, math.floor(x * 16 / 120)) * 12 + min(11, math.floor(y * 12 / 80))


def test_threat(spark):
    r, rows = random.Random(1), []
    for k in range(3000):
        kind = r.choice(["Pass", "Pass", "Carry", "Shot", "Pressure"])
        rows.append(event(f"e{k}", k % 90, kind, x=r.choice([None, 0.0, 120.0, *[r.uniform(0, 120) for _ in range(9)]]), y=r.uniform(0, 80), end_x=r.choice([None, 120.0, *[r.uniform(0, 120) for _ in range(9)]]),
                          end_y=r.uniform(0, 80), period=r.choice([1, 2, 5]), pass_outcome=r.choice(["Complete", "Incomplete"]) if kind == "Pass" else None, shot_outcome=r.choice(["Goal", "Saved"]) if kind == "Shot" else None,
                          player_id=r.choice(["p1", "p2", None])))
    acts = []
    for e in rows:
        moved = e["type"] == "Carry" or e["type"] == "Pass" and e["pass_outcome"] == "Complete"
        if e["period"] < 5 and e["type"] in ("Pass", "Carry", "Shot") and e["x"] is not None and (not moved or e["end_x"] is not None):
            acts.append((e, zone(e["x"], e["y"]), zone(e["end_x"], e["end_y"]) if moved else None))
    total, goals, steps, v = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for e, z, to in acts:
        total[z] += 1
        goals[z] += e["shot_outcome"] == "Goal"
        steps[z, to] += to is not None
    for _ in range(TH.ROUNDS):
        v = defaultdict(int, {z: (goals[z] * TH.UNIT + sum(n * v[to] for (a, to), n in steps.items() if a == z and to is not None)) // total[z] for z in total})
    df = frame(spark, rows).repartition(5)
    grid = TH.grid(TH.counts(df))
    got = grid.collect()
    assert len(got) == 192 and {x["zone"]: x["value"] for x in got} == {z: v[z] for z in range(192)} and sum(x["actions"] for x in got) == len(acts)
    own = defaultdict(list)
    for e, z, to in acts:
        if to is not None and e["player_id"]:
            own[e["player_id"]].append(v[to] - v[z])
    for x in TH.players(df, grid).collect():
        gains = own.pop(x["player_id"])
        assert x["moves"] == len(gains) and abs(x["xt"] - sum(gains) / 1e9) < 1e-6 and abs(x["xt_gained"] - sum(g for g in gains if g > 0) / 1e9) < 1e-6
    assert not own
    empty = TH.grid(TH.counts(df.limit(0)))
    assert empty.count() == 192 and empty.filter("value <> 0").count() == 0


def test_assists(spark):
    rows = [event("p1", 1, player_id="a", pass_outcome="Complete"), event("p2", 2, player_id="b", pass_outcome="Complete"),
            event("s1", 3, "Shot", shot_xg=0.25, shot_outcome="Goal", shot_key_pass_id="p1"), event("s2", 4, "Shot", shot_xg=0.5, shot_outcome="Saved", shot_key_pass_id="p1"),
            event("s3", 5, "Shot", shot_xg=0.125, shot_outcome="Goal (disallowed)", shot_key_pass_id="p2"), event("s4", 6, "Shot", shot_xg=0.3, shot_outcome="Goal"),
            event("s5", 7, "Shot", shot_xg=0.1, shot_key_pass_id="lost"), event("s6", 8, "Shot", shot_key_pass_id="p2"), event("s7", 9, "Shot", period=5, shot_xg=0.7, shot_key_pass_id="p2")]
    made = CR.created_shots(frame(spark, rows, "shot_key_pass_id string"))
    assert {x["player_id"]: (x["chances"], x["assists"], x["xa"]) for x in CR.players(made).collect()} == {"a": (2, 1, 0.75), "b": (2, 0, 0.125)}
    b = CR.balance(made).first()
    assert (b["attributed"], b["unattributed"], b["xg_micro"], b["xa_micro"], b["nobody_micro"]) == (4, 1, 975_000, 875_000, 100_000)


def walked(rows):
    out, last = [], object()
    place = None
    for e in sorted((e for e in rows if e["possession"] is not None and e["period"] < 5), key=lambda e: (e["period"], e["minute"], e["second"], e["idx"], e["event_id"])):
        if (e["period"], e["possession"]) != (place, last):
            out.append([])
        place, last = e["period"], e["possession"]
        out[-1].append(e)
    res = []
    for k, es in enumerate(out, 1):
        team = es[0]["team_id"]
        own = [e for e in es if e["team_id"] == team]
        clock = [e["minute"] * 60 + e["second"] for e in es]
        res.append((k, es[0]["period"], es[0]["possession"], team, len(es), sum(e["pass_outcome"] == "Complete" for e in own), sum(e["type"] == "Shot" for e in own), clock[0], clock[-1] - clock[0], own[-1]["type"] == "Shot"))
    return res


def test_chains(spark):
    r, rows, p = random.Random(2), [], 0
    for k in range(600):
        p += r.random() < 0.3
        kind = r.choice(["Pass", "Pass", "Shot", "Pressure", "Duel"])
        rows.append(event(f"e{k:03}", k // 8, kind, r.choice("HHA"), 1 if k < 290 else 2 if k < 590 else 5, k % 8 * 7, k, possession=None if r.random() < 0.05 else p % 40 if r.random() < 0.97 else p % 40 - 1, pass_outcome="Complete" if kind == "Pass" and r.random() < 0.7 else None))
    rows[290]["possession"] = rows[289]["possession"] = 7  # one number on both sides of the half: two chains
    got = CN.chains(frame(spark, rows, "possession int").repartition(6)).collect()
    keys = ("chain", "period", "possession", "team_id", "events", "passes", "shots", "start", "seconds", "ends_in_shot")
    assert sorted(tuple(x[c] for c in keys) for x in got) == walked(rows) and any(x["ends_in_shot"] for x in got)
    t = {x["team_id"]: x for x in CN.teams(CN.chains(frame(spark, rows, "possession int"))).collect()}
    assert sum(x["chains"] for x in t.values()) == len(got) and sum(x["ending_in_shot"] for x in t.values()) == sum(x["ends_in_shot"] for x in got)


def test_no_window_over_a_match(spark):
    plan = CN.numbered(frame(spark, [event("e", 1, possession=1)], "possession int"))._jdf.queryExecution().optimizedPlan().toString()
    specs = [x.split("windowspecdefinition(")[1] for x in plan.split("\n") if "windowspecdefinition(" in x]
    over_events = [x.split(" ASC")[0] for x in specs if "event_id" in x]
    assert over_events and all("minute#" in x for x in over_events), specs


def test_packing(spark):
    man = lambda x, y, mate=False, keeper=False: (x, y, mate, keeper)
    view = [man(50.0, 40.0), man(55.0, 44.0), man(60.0, 40.0), man(30.0, 40.0), man(52.0, 40.0, True), man(58.0, 40.0, False, True), man(None, 40.0), man(60.5, 40.0)]
    base = {"x": 40.0, "y": 40.0, "end_x": 60.0, "end_y": 40.0, "pass_outcome": "Complete"}
    rows = [event("seen", 1, freeze=view, **base), event("failed", 2, freeze=view, **{**base, "pass_outcome": "Incomplete"}), event("back", 3, freeze=view, **{**base, "x": 60.0, "end_x": 40.0}),
            event("unseen", 4, freeze=None, **base), event("nobody", 5, freeze=[], **base), event("unknown", 6, freeze=view, **{**base, "end_x": None}), event("still", 7, freeze=view, **{**base, "end_x": 40.0}), event("shot", 8, "Shot", freeze=view, **base)]
    df = frame(spark, rows, "freeze array<struct<x:double,y:double,teammate:boolean,keeper:boolean>>")
    got = {x["event_id"]: (x["packed"], x["through"]) for x in PK.packing(df).collect()}
    assert got == {"seen": (3, 2), "failed": (0, 0), "back": (0, 0), "unseen": (None, None), "nobody": (0, 0), "unknown": (None, None), "still": (0, 0)}
    p = PK.players(PK.packing(df)).first()
    assert (p["passes_seen"], p["packed"], p["through"], p["per_pass"]) == (5, 3, 2, 0.6)
    flat = spark.createDataFrame([(1, r["event_id"], *m) for r in rows if r["freeze"] for m in r["freeze"]], "match_id long, event_id string, x double, y double, teammate boolean, keeper boolean")
    again = {x["event_id"]: (x["packed"], x["through"]) for x in PK.packing(PK.with_frames(df, flat)).collect()}
    assert again == {**got, "nobody": (None, None)}


ROLES = {"fed": CF.OFFICIAL, "deep": CF.DEEP}


def test_conflicts(spark):
    t = lambda h: f"2024-05-01 {h:02}:00:00"
    said = [(1, "score", "fed", "2-1", t(1)), (1, "score", "deep", "1-1", t(9)), (1, "score", "x", "2-1", None), (2, "score", "deep", "0-0", None), (2, "score", "x", "1-0", t(3)), (2, "score", "fed", None, t(5)),
            (3, "score", "fed", "1-0", t(2)), (3, "score", "fed", "1-1", t(3)), (3, "score", "deep", "1-1", t(1)), (1, "lineup", "fed", "a,b", t(1)), (1, "lineup", "x", "a,c", t(2)), (2, "lineup", "fed", "a", t(2)), (2, "lineup", "deep", "b", t(2)),
            (1, "xg", "x", "9.9", t(9)), (1, "xg", "deep", "1.2", None), (2, "xg", "x", "3.0", t(1)), (1, "kickoff", "deep", "12:00", t(9)), (1, "kickoff", "fed", "13:00", None), (4, "referee", "x", "A", t(1)), (4, "referee", "deep", "B", None)]
    facts = spark.createDataFrame(said, "match_id long, fact string, feed string, value string, updated_at string").withColumn("updated_at", CF.F.col("updated_at").cast("timestamp"))
    st = CF.standing(facts, ROLES)
    got = {(x["match_id"], x["fact"]): (x["feed"], x["value"], x["feeds"], x["values"], x["conflict"]) for x in CF.settled(st).collect()}
    assert got == {(1, "score"): ("fed", "2-1", 3, 2, True), (2, "score"): ("deep", "0-0", 2, 2, True), (3, "score"): ("fed", "1-1", 2, 1, False), (1, "lineup"): ("x", "a,c", 2, 2, True), (2, "lineup"): ("deep", "b", 2, 2, True),
                   (1, "xg"): ("deep", "1.2", 2, 2, True), (1, "kickoff"): ("fed", "13:00", 2, 2, True), (4, "referee"): ("deep", "B", 2, 2, True)}
    log = CF.conflicts(st, CF.settled(st))
    assert {(x["match_id"], x["fact"], x["feed"], x["value"]) for x in log.collect()} == {(1, "score", "deep", "1-1"), (2, "score", "x", "1-0"), (1, "lineup", "fed", "a,b"), (2, "lineup", "fed", "a"), (1, "xg", "x", "9.9"), (1, "kickoff", "deep", "12:00"), (4, "referee", "x", "A")}
    assert sum(x["conflicts"] for x in CF.counted(log).collect()) == 7


def test_facts_of_feeds(spark):
    rows = [event("g1", 5, "Shot", "H", shot_outcome="Goal"), event("g2", 6, "Shot", "A", shot_outcome="Goal"), event("o1", 7, "Own Goal Against", "A"), event("g3", 8, "Shot", "H", period=5, shot_outcome="Goal"), event("c", 9, "Pass", "A")]
    sides = spark.createDataFrame([(1, "H", "A"), (2, "H", "A")], "match_id long, home_id string, away_id string")
    assert [tuple(x)[:4] for x in CF.score_facts(frame(spark, rows), sides, "f").collect()] == [(1, "score", "f", "2-1")]
    off = spark.createDataFrame([(1, "g1")], "match_id long, event_id string")
    assert CF.score_facts(frame(spark, rows), sides, "f", off).first()["value"] == "1-1"
    m = spark.createDataFrame([(1, "2024-05-01T20:00:00+02:00"), (2, "soon"), (3, None)], "match_id long, at string")
    assert [x["value"] for x in CF.kickoff_facts(m, CF.F.col("at"), "f").orderBy("match_id").collect()] == ["2024-05-01 18:00", None, None]
    sheet = spark.createDataFrame([(1, 9, True), (1, 10, True), (1, 9, True), (1, 3, False)], "match_id long, player_id int, started boolean").withColumn("updated_at", CF.F.lit(None).cast("timestamp"))
    assert CF.lineup_facts(sheet, "f").first()["value"] == "10,9"


@pytest.mark.parametrize("numbered", [True, False])
def test_resets_in_order(spark, tmp_path, numbered):
    """Against a walk over the feed, record by record."""
    from pyspark.sql import functions as F

    from touchline.streaming import live as LV

    r, feed = random.Random(5), []
    for seq in range(1, 160):
        m = r.randint(1, 4)
        feed.append((seq, m, None if r.random() < 0.06 else f"e{r.randint(1, 12)}"))
    e, k = frame(spark, []), spark.createDataFrame([], CORRECTION)
    log = LV.LiveLog(spark, str(tmp_path / "log"), e.schema, k.schema)
    batches = [feed[a:a + 40] for a in range(0, 160, 40)]
    held = defaultdict(set)
    for n, batch in enumerate(batches):
        if not numbered:  # all of a batch comes after its resets
            for m in {m for _, m, x in batch if x is None}:
                held[m].clear()
        for _, m, x in batch:
            if x is None and numbered:
                held[m].clear()
            elif x is not None:
                held[m].add(x)
        events = frame(spark, [{**event(x, 1), "match_id": m, "second": seq} for seq, m, x in batch if x])
        recs = LV.RC.encode(events, "event").withColumn("seq", F.get_json_object("body", "$.second").cast("long"))
        gone = spark.createDataFrame([("control", m, "reset", seq) for seq, m, x in batch if x is None], "kind string, match_id long, body string, seq long")
        both = recs.unionByName(gone).repartition(3)
        log.append(both if numbered else both.drop("seq"), n)
        log.append(both if numbered else both.drop("seq"), n)  # a retry
        got = defaultdict(set)
        for x in log.visible("event").select("match_id", "event_id").collect():
            assert x["event_id"] not in got[x["match_id"]]
            got[x["match_id"]].add(x["event_id"])
        assert {m: s for m, s in got.items() if s} == {m: s for m, s in held.items() if s}
    assert len(C_FIELDS) == len(k.columns)
