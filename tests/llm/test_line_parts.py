"""A large bucket of lines about as alike as similar lines must be: parts of it join most, so that few pairs are found, and none is missed."""

import random

from tests.llm.test_dedup import components, prose, similar
from tests.llm.test_lines import edited
from touchline.llm import lines


def test_few_pairs_of_near_copies_are_found_and_all_links_kept(spark, monkeypatch):
    r = random.Random(51)
    base = prose(r, 60)
    texts = list(dict.fromkeys(edited(r, base, 3 + 3 * (k % 2)) for k in range(160)))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    occ = lines.occurrences(docs).select("lk", "line").collect()
    n, possible = [], lines.possible

    def counted(*args):
        out = possible(*args)
        n.append(out.count())
        return out

    monkeypatch.setattr(lines, "possible", counted)
    one = spark.createDataFrame([(x["lk"], [7]) for x in occ], "lk long, keys array<long>")
    got = {x["node"]: x["root"] for x in lines.classes(docs, one).collect()}
    want = components(len(occ), lambda i, j: similar(occ[i]["line"], occ[j]["line"]))
    lead = {}
    for x, c in zip(occ, want, strict=True):
        lead[c] = min(lead.get(c, x["lk"]), x["lk"])
    assert all(got.get(x["lk"], x["lk"]) == lead[c] for x, c in zip(occ, want, strict=True))
    assert 0 < sum(n) < 12 * len(occ)
