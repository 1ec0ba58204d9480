"""A large bucket of unlike lines about one passage: few pairs are compared, and the similar ones among them are found."""

import random

from tests.llm.test_dedup import prose
from tests.llm.test_lines import ASCII, edited
from touchline.llm import lines


def test_unlike_lines_of_a_bucket_are_not_all_compared(spark, monkeypatch):
    r = random.Random(31)
    passage = prose(r, 50)
    texts = [f"{''.join(r.choices(ASCII, k=150))} {passage}" for _ in range(60)]
    twins = [edited(r, t, 2) for t in texts[:5]]
    docs = spark.createDataFrame(list(enumerate(texts + twins)), "id long, text string")
    lk = {x["line"]: x["lk"] for x in lines.occurrences(docs).collect()}
    n, compared = [], lines.compared

    def counted(pairs, of):
        n.append(pairs.count())
        return compared(pairs, of)

    monkeypatch.setattr(lines, "compared", counted)
    one = spark.createDataFrame([(x, [7]) for x in lk.values()], "lk long, keys array<long>")
    got = {x["node"]: x["root"] for x in lines.classes(docs, one).collect()}
    assert got == {lk[x]: min(lk[a], lk[b]) for a, b in zip(texts, twins) for x in (a, b)}
    assert sum(n) < 5 * len(lk)
