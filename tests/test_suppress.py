"""Near-duplicate moments against a plain walk; periods aren't handed to Python one by one."""

import random

from touchline.operators import moments as MO

COLS = "match_id long, period int, minute int, second int, idx int, event_id string, swing double, mandatory boolean"


def walk(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], not r[7], *r[2:6])):
        near = [k for k in kept if abs((k[2] - r[2]) * 60 + k[3] - r[3]) <= MO.WINDOW_S]
        if all(r[7] and not k[7] for k in near):
            kept = [k for k in kept if k not in near] + [r]
    return kept


def test_suppression_against_a_plain_walk(spark):
    rng = random.Random(5)
    swing = {(m, n): rng.choice([0.0, 0.1, 0.2, 0.3]) for m in range(40) for n in range(12)}
    rows, want = [], set()
    for match in range(40):
        for period in (1, 2):
            part = []
            for i in range(rng.randint(0, 25)):
                minute = rng.randint(0, 11)
                part.append((match, period, minute, rng.choice([0, 7, 30, 59]), i, f"e{match}-{period}-{i}", swing[match, minute], rng.random() < 0.4))
            rows += part
            want |= set(walk(part))
    out = MO.suppress_duplicates(spark.createDataFrame(rows, COLS))
    assert out.columns == [c.split(" ")[0] for c in COLS.split(", ")]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "FlatMapGroupsIn" not in out._jdf.queryExecution().executedPlan().toString()
