"""The search index knows names, matches and dates; it derives no probabilities or stories for them."""

from touchline.plans import directory, narrative
from touchline.plans.fixture import table


def test_index_derives_no_stories(spark, monkeypatch):
    d = "/root/testdata/sf0.001"

    def none(*_):
        raise AssertionError("the index needs no such table")

    for name in ("candidates", "winners", "_goals"):
        monkeypatch.setattr(narrative, name, none)
    rows = directory._index(spark, d).collect()
    matches = table(spark, d, "matches").collect()
    teams = {t for m in matches for t in ((str(m["home_id"]), m["home"]), (str(m["away_id"]), m["away"]))}
    assert {(r["id"], r["name"]) for r in rows if r["kind"] == "team"} == teams
    assert {r["id"]: r["weight"] for r in rows if r["kind"] == "team"} == {i: 1000 + sum(i in (str(m["home_id"]), str(m["away_id"])) for m in matches) for i, _ in teams}
    assert [(r["id"], r["weight"]) for r in rows if r["kind"] == "competition"] == [("11", 10_000 + len(matches))]
