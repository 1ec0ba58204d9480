"""Facts of seasons against a plain count; a league needs its pairings, not only as many matches."""

from touchline.operators import standings as SD

COLS = "competition_id int, season_id int, international boolean, stage string, kickoff int, home_id int, away_id int, home_goals int, away_goals int"


def test_facts_come_from_one_pass_over_the_cards(spark):
    rows = [(c, s, c == 43, "Group Stage" if c == 43 else "Regular Season", i, i % (3 + s), (i * 5 + 1) % (4 + s), 1, 0) for c in (11, 43) for s in (1, 2) for i in range(17 * s)]
    facts = SD.season_facts(spark.createDataFrame(rows, COLS))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for r in facts.collect():
        mine = [x for x in rows if x[:2] == (r["competition_id"], r["season_id"])]
        teams = {t for x in mine for t in x[5:7]}
        assert (r["matches"], r["teams"], r["expected"]) == (len(mine), len(teams), len(teams) * (len(teams) - 1))
        assert r["pairings"] == len({x[5:7] for x in mine}) and r["has_groups"] == r["international"] == (r["competition_id"] == 43)


def test_repeated_pairings_are_no_league(spark):
    part = [(11, 1, False, "Regular Season", i, i % 2, 1 - i % 2, 1, 0) for i in range(40)] + [(11, 1, False, "Regular Season", i, 2, 3, 1, 0) for i in range(40)]
    full = [(11, 2, False, "Regular Season", 1, a, b, 1, 0) for a in range(3) for b in range(3) if a != b for _ in range(2)]
    df = spark.createDataFrame(part + full, COLS)
    assert {r["season_id"] for r in SD.season_tables(df, SD.season_facts(df)).collect()} == {2}
