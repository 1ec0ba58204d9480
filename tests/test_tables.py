"""Standings against a plain recursive ranking; groups; Elo."""

import random

import pytest

from touchline.operators import elo as EL
from touchline.operators import standings as SD


def plain_rank(results, rules):
    """Rank one table the obvious way: split a level group, then its parts."""
    teams = {t for h, a, *_ in results for t in (h, a)}

    def sums(team, group):
        p = gd = gf = ag = 0
        for h, a, hg, ag_ in results:
            if team not in (h, a) or not {h, a} <= set(group):
                continue
            mine, other = (hg, ag_) if team == h else (ag_, hg)
            p += 3 if mine > other else mine == other
            gd += mine - other
            gf += mine
            ag += mine if team == a else 0
        return {"points": p, "goal_difference": gd, "goals_for": gf, "away_goals": ag}

    whole = {t: sums(t, teams) for t in teams}

    def score(rule, team, group):
        return sums(team, group)[rule[4:]] if rule.startswith("h2h_") else whole[team][rule]

    def order(group, rest):
        if len(group) == 1 or not rest:
            return sorted(group)
        parts = {}
        for t in group:
            parts.setdefault(score(rest[0], t, group), []).append(t)
        return [t for s in sorted(parts, reverse=True) for t in order(parts[s], rest[1:])]

    levels = {}
    for t in teams:
        levels.setdefault(whole[t]["points"], []).append(t)
    return [t for p in sorted(levels, reverse=True) for t in order(levels[p], rules)]


@pytest.mark.parametrize("rule", ["PL", "LIGA", "UCL_GROUP", "FIFA_GROUP", "UEFA_EURO_GROUP"])
def test_every_rule_set_on_random_seasons(spark, rule):
    rng = random.Random(rule)
    rows, want = [], {}
    for season in range(25):
        n = rng.randint(3, 5)
        res = [(f"t{a}", f"t{b}", rng.randint(0, 1), rng.randint(0, 1)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.8]
        res = res or [("t0", "t1", 0, 0)]
        rows += [(season, *r) for r in res]
        want[season] = plain_rank(res, list(SD.TIE_BREAKS[rule].rules))
    df = spark.createDataFrame(rows, "season int, home_id string, away_id string, home_goals int, away_goals int")
    got = {}
    for r in SD.standings(df, ["season"], rule).orderBy("season", "position").collect():
        got.setdefault(r["season"], []).append(r["team_id"])
    assert got == want


def test_inseparable_teams_are_reported(spark):
    df = spark.createDataFrame([(1, "a", "b", 1, 1), (1, "b", "a", 1, 1), (1, "a", "c", 2, 0), (1, "b", "c", 2, 0)], "season int, home_id string, away_id string, home_goals int, away_goals int")
    rows = SD.standings(df, ["season"], "LIGA").orderBy("position").collect()
    assert [(r["team_id"], r["unresolved"]) for r in rows] == [("a", True), ("b", True), ("c", False)]


def test_groups_follow_a_long_chain(spark):
    rows = [(1, i, i + 1, 100 - i) for i in range(40)] + [(1, 100, 101, 5)]
    df = spark.createDataFrame(rows, "season int, home_id int, away_id int, kickoff int")
    got = SD.groups(df, ["season"]).collect()
    assert {r["group_no"] for r in got if r["team_id"] <= 40} == {2} and {r["group_no"] for r in got if r["team_id"] >= 100} == {1}


def test_elo_is_causal_and_independent_of_steps(spark):
    rng = random.Random(1)
    rows = [(m, m % 2, f"2024-{1 + m // 20:02d}-01", f"{m % 24:02d}", rng.randint(0, 3), rng.randint(4, 7), rng.randint(0, 3), rng.randint(0, 3)) for m in range(120)]
    df = spark.createDataFrame(rows, "match_id int, competition_id int, match_date string, kick_off string, home_id int, away_id int, home_goals int, away_goals int")
    rating, want = {}, {}
    for m, c, *_rest, h, a, hg, ag in sorted(rows, key=lambda r: (r[2], r[3], r[0])):
        rh, ra = rating.get((c, h), 1500.0), rating.get((c, a), 1500.0)
        want[m] = rh - ra
        exp = 1 / (1 + 10 ** ((ra - rh) / 400))
        d = 24 * max(abs(hg - ag), 1) ** 0.5 * ((hg > ag) + 0.5 * (hg == ag) - exp)
        rating[c, h], rating[c, a] = rh + d, ra - d
    for step in (1000, 7):
        got = {r["match_id"]: r["elo_diff"] for r in EL.causal_elo(df, step_rows=step).collect()}
        assert got == pytest.approx(want)


def test_partial_coverage_gives_no_table(spark):
    cols = "competition_id int, season_id int, international boolean, stage string, kickoff int, home_id int, away_id int, home_goals int, away_goals int"
    few = [(11, 1, False, "Regular Season", i, 0, i + 1, 1, 0) for i in range(4)]
    full = [(11, 2, False, "Regular Season", 1, a, b, 1, 0) for a in range(3) for b in range(3) if a != b]
    df = spark.createDataFrame(few + full, cols)
    facts = SD.season_facts(df)
    notes = {r["season_id"]: r["note"] for r in SD.season_notes(facts).collect()}
    assert notes[1].startswith("The open data holds 4 of this season's 20") and notes[2] == ""
    assert {r["season_id"] for r in SD.season_tables(df, facts).collect()} == {2}
