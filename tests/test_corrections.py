"""The log: corrections supersede events; results depend on the set of records."""

import random

from pyspark.sql import functions as F

from tests.conftest import correction, event, frames, goal, starting_log, state_of
from touchline.operators import log as LG
from touchline.operators import moments as MO
from touchline.operators import state as ST


def score(s):
    return s["home_score"], s["away_score"]


def test_disallow_reinstate_reassign(spark):
    log = starting_log()
    assert score(state_of(spark, log)) == (2, 1)
    off = correction("c1", "g2", "disallow", 43)
    assert score(state_of(spark, log, [off])) == (1, 1)
    assert score(state_of(spark, log, [off, off])) == (1, 1)
    assert score(state_of(spark, log, [off, correction("c2", "g2", "reinstate", 45)])) == (2, 1)
    # decisions count in the order they were made, not received
    assert score(state_of(spark, log, [correction("c2", "g2", "reinstate", 41), off])) == (1, 1)
    assert score(state_of(spark, log, [correction("c3", "g2", "reassign", 50, new_player_id="H9", new_player="Nine")])) == (2, 1)


def test_score_as_it_stood(spark):
    e, k = frames(spark, starting_log(), [correction("c1", "g2", "disallow", 43)])
    ch = ST.score_changes(e, k, ST.discover_sides(e))
    at = lambda p, m: tuple(ST.score_at(ch, p, m).first()[1:])
    assert at(1, 41) == (2, 0) and at(1, 44) == (1, 0) and at(2, 90) == (1, 1)
    assert ST.ever(ch, 2, 0).count() == 1 and ST.ever(ch, 2, 1).count() == 0
    for p, m in ((1, 41), (1, 44), (2, 90)):
        e2, k2 = LG.as_of(e, k, p, m)
        s = ST.match_state(LG.corrected_events(e2, LG.resolve(k2)), ST.discover_sides(e2)).first()
        assert score(s) == at(p, m)


def test_team_amendment_moves_the_score_from_its_decision(spark):
    e, k = frames(spark, starting_log(), [correction("c1", "g1", "amend", 30, new_team_id="A", new_team="A")])
    ch = ST.score_changes(e, k, ST.discover_sides(e))
    at = lambda p, m: tuple(ST.score_at(ch, p, m).first()[1:])
    assert at(1, 25) == (1, 0) and at(1, 30) == (0, 1) and at(1, 45) == (1, 1)


def test_own_goal_and_shootout(spark):
    s = state_of(spark, starting_log() + [event("og", 70, "Own Goal Against", "H", 2)])
    assert score(s) == (2, 2)
    pens = starting_log()[:2] + [goal(f"p{i}", 120 + i, t, 5) for i, t in enumerate("HAH")]
    s = state_of(spark, pens)
    assert score(s) == (0, 0) and (s["home_shootout"], s["away_shootout"]) == (2, 1)
    assert s["scoreline"] == "0-0 (2-1 on penalties)" and s["clock"] == "PENS"


def test_amend_keeps_place_in_order(spark):
    e, k = frames(spark, starting_log(), [correction("c1", "g1", "amend", 30, new_minute=44, new_xg=0.5)])
    eff = {r["event_id"]: r for r in LG.effective_events(e, LG.resolve(k)).collect()}
    assert eff["g1"]["minute"] == 44 and eff["g1"]["order_minute"] == 20 and eff["g1"]["shot_xg"] == 0.5


def test_later_amend_does_not_lift_disallow_but_moments_read_the_last(spark):
    ks = [correction("c1", "g2", "disallow", 43), correction("c2", "g2", "amend", 50, new_xg=0.7)]
    assert score(state_of(spark, starting_log(), ks)) == (1, 1)
    _, k = frames(spark, [], ks)
    assert MO.last_corrections(k).first()["k_kind"] == "amend"
    v = LG.resolve(k).first()
    assert v["disallowed"] and v["decided_at_minute"] == 50 and v["new_xg"] == 0.7


def test_any_order_any_number_of_deliveries(spark):
    rng = random.Random(3)
    events = starting_log() + [event(f"e{i}", rng.randint(0, 90), rng.choice(["Pass", "Pressure", "Foul Committed"]), rng.choice("HA"), rng.choice([1, 2])) for i in range(40)]
    ks = [correction("c1", "g2", "disallow", 43), correction("c2", "g2", "reinstate", 47), correction("c3", "g1", "disallow", 70, 2)]
    want = state_of(spark, events, ks)
    for _ in range(5):
        ev = events + rng.sample(events, 20)
        kk = ks + rng.sample(ks, 2)
        rng.shuffle(ev)
        rng.shuffle(kk)
        assert state_of(spark, ev, kk) == want


def test_suppression_against_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for m in range(30):
        swing_of = {k: rng.choice([0.1, 0.2, 0.3, 0.4]) for k in range(20)}
        for i in range(25):
            minute = rng.randint(0, 6)
            rows.append((m, rng.choice([1, 2]), minute, rng.randint(0, 59), i, f"{m}-{i:02d}", swing_of[minute], rng.random() < 0.5))
    df = spark.createDataFrame(rows, "match_id int, period int, minute int, second int, idx int, event_id string, swing double, mandatory boolean")
    got = {r["event_id"] for r in MO.suppress_duplicates(df).collect()}
    want = set()
    for m in range(30):
        mine = sorted((r for r in rows if r[0] == m), key=lambda r: (-r[6], not r[7], r[1], r[2], r[3], r[4]))
        kept = []
        for r in mine:
            close = [k for k in kept if k[1] == r[1] and abs(k[2] * 60 + k[3] - r[2] * 60 - r[3]) <= 90]
            if any(not (r[7] and not k[7]) for k in close):
                continue
            kept = [k for k in kept if k not in close] + [r]
        want |= {k[5] for k in kept}
    assert got == want


def test_choice_fills_up_to_eight(spark):
    rows = [(1, 1, i, 0, i, f"m{i}", 0.1, True) for i in range(3)] + [(1, 2, i, 0, i, f"o{i}", i / 100, False) for i in range(10)]
    df = spark.createDataFrame(rows, "match_id int, period int, minute int, second int, idx int, event_id string, swing double, mandatory boolean")
    got = {r["event_id"] for r in MO.choose(df).collect()}
    assert got == {"m0", "m1", "m2", "o9", "o8", "o7", "o6", "o5"}


def test_running_sums_equal_a_plain_window(spark):
    from pyspark.sql import Window

    from touchline.functions.scan import running_sums

    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 13).alias("a"), F.col("id").alias("b"), (F.col("id") % 5).alias("v"))
    w = Window.partitionBy("k").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["b"]: r["s"] for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {r["b"]: r["s"] for r in running_sums(df, ["k"], ["a"], ["b"], {"s": F.col("v")}).collect()}
    assert got == want
