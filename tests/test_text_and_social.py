"""Text functions, classification, author cap, entity resolution."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import entities as EN
from touchline.operators import social as SO


def test_similarity_reference_values():
    for a, b, v in (("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("gizmx hot", "gizmo hot", 0.9181), ("", "x", 0.0), ("a", "a", 1.0)):
        assert T.similarity(a, b) == pytest.approx(v, abs=5e-5)


def test_blocking_finds_every_pair_that_reaches_the_threshold(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeilnorst ") for _ in range(rng.randint(4, 14))).strip() or "a" for _ in range(60)]
    other = []
    for n in base:
        k = list(n)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(k))
            k[i] = rng.choice("abcdeilnorst")
        other.append("".join(k))
    left = spark.createDataFrame([("t", n) for n in set(base)], "team_norm string, target string")
    right = spark.createDataFrame([("t", n, n) for n in set(other)], "team_norm string, sorted_name string, canonical_id string")
    got = {(r["target"], r["sorted_name"]) for r in EN._possible(left, right, ["team_norm"]).collect()}
    want = {(a, b) for a in set(base) for b in set(other) if T.similarity(a, b) >= EN.FUZZY}
    assert want <= got and len(want) > 20


def test_html_and_folding(spark):
    df = spark.createDataFrame([("<p>A&amp;B<br>c</p><p>d</p><br><br><br>e", "Atlético ﬁ")], "h string, s string")
    r = df.select(T.plain_text("h").alias("h"), T.fold("s").alias("s"), T.normalise_name(T.fold("s")).alias("n")).first()
    assert r["h"] == "A&B\nc\n\nd\n\ne" and r["s"] == "atletico fi" and r["n"] == "atletico fi"


ALIASES = [("f", "fixture", "PL", "home", "man city", True), ("f", "fixture", "PL", "home", "city", False), ("f", "fixture", "PL", "away", "nott'm forest", True),
           ("f", "fixture", "PL", "away", "arsenal", True), ("PL", "competition", "PL", "name", "premier league", True), ("PL", "competition", "PL", "name", "#epl", True)]


def test_classification(spark):
    posts = [(1, "Man City v Nott'm Forest tonight", None), (2, "city lights, arsenal of talent", None), (3, "nice city", "f"), (4, "Canadian Premier League final", None),
             (5, "the PREMIER LEAGUE!", None), (6, "premierleague", None), (7, "watch #EPL", None), (8, "epl", None), (9, "mancity and arsenals", "f"),
             (10, "canadian premier league and the premier league", None), (11, "premier, league", None)]
    p = spark.createDataFrame(posts, "post_id int, text string, via string")
    a = spark.createDataFrame(ALIASES, "topic string, kind string, code string, side string, alias string, strong boolean")
    got = {}
    for r in SO.classify(p, a, {"PL": ("canadian premier league",)}).collect():
        got.setdefault(r["post_id"], set()).add(r["topic"])
    assert got == {1: {"f", "PL"}, 3: {"f", "PL"}, 5: {"PL"}, 7: {"PL"}, 10: {"PL"}}


def test_searched_fixture_needs_one_named_team(spark):
    p = spark.createDataFrame([(1, "arsenal", "f"), (2, "arsenal", None)], "post_id int, text string, via string")
    a = spark.createDataFrame(ALIASES, "topic string, kind string, code string, side string, alias string, strong boolean")
    assert {(r["post_id"], r["topic"]) for r in SO.classify(p, a).collect()} == {(1, "f"), (1, "PL")}


def test_author_cap_against_a_plain_walk(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["x", "reddit"]), rng.randint(0, 1), t0 + dt.timedelta(minutes=rng.randint(0, 3 * 24 * 60))) for i in range(400)]
    df = spark.createDataFrame(rows, "post_id int, network string, author_id int, ts timestamp")
    got = {r["post_id"] for r in SO.cap_authors(df, ["network", "author_id"]).collect()}
    want, opened = set(), {}
    for pid, n, a, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        start, k = opened.get((n, a), (None, 0))
        if start is None or ts >= start + dt.timedelta(hours=6):
            start, k = ts, 0
        opened[n, a] = (start, k + 1)
        if k + 1 <= 8:
            want.add(pid)
    assert got == want


def test_resolution_stages(spark):
    c = spark.createDataFrame([("1", "Lionel Messi", "1987-06-24", "Barcelona"), ("2", "Rodrigo Silva", None, "City"), ("3", "Rodrigo Silva", None, None)],
                              "canonical_id string, name string, birth_date string, team string")
    m = spark.createDataFrame([("football-data", "44", "whoever", None, None), ("a", "1", "LIONEL  MESSÍ", "1987-06-24", None), ("a", "2", "Silva Rodrigo", None, "CITY"),
                               ("a", "3", "Rodrigo Silvo", None, None), ("a", "4", "Rodri", None, "City"), ("a", "5", "Rodrigo Silvaa", None, "Other")],
                              "feed string, feed_id string, name string, birth_date string, team string")
    got = {r["feed_id"]: (r["canonical_id"], r["method"], r["needs_review"]) for r in EN.resolve(m, c, EN.curated(c)).collect()}
    assert got == {"44": ("5503", "alias", False), "1": ("1", "exact", False), "2": ("2", "fuzzy", False), "3": (None, "unresolved", True),
                   "4": (None, "unresolved", True), "5": ("3", "fuzzy", False)}


def test_hashtags_and_times(spark):
    df = spark.createDataFrame([("#Él no #Goal #goal #ab #1x #Tor_9", "2024-01-02T03:04:05Z"), ("", "nonsense"), (None, "2024-01-02T03:04:05.250+02:00")], "t string, at string")
    r = df.select(T.hashtags(F.col("t")).alias("h"), T.epoch_seconds(F.col("at")).alias("s")).collect()
    assert r[0]["h"] == ["goal", "tor_9"] and [x["s"] for x in r] == [1704164645.0, 0.0, 1704157445.25]
