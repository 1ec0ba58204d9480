"""Large buckets of lines, in rounds, against all pairs; columns with the names that line dedup uses itself."""

import random
from collections import Counter, defaultdict

from tests.llm.test_dedup import components, prose, similar
from tests.llm.test_lines import edited
from touchline.llm import lines


def test_rounds_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(lines, "LISTED", 4)
    monkeypatch.setattr(lines, "FIRSTS", 2)
    r = random.Random(21)
    base = [prose(r, 14) for _ in range(9)]
    texts = list(dict.fromkeys(base + [edited(r, x, k) for x in base[:4] for k in (1, 2, 3, 4, 5, 6, 7)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    occ = lines.occurrences(docs).select("lk", "line").collect()
    want = components(len(occ), lambda i, j: similar(occ[i]["line"], occ[j]["line"]))
    one = spark.createDataFrame([(x["lk"], [7]) for x in occ], "lk long, keys array<long>")
    got = {x["node"]: x["root"] for x in lines.classes(docs, one).collect()}
    by = defaultdict(set)
    for x, c in zip(occ, want, strict=True):
        by[c].add(got.get(x["lk"], x["lk"]))
    assert max(Counter(want).values()) > 2 and all(len(s) == 1 for s in by.values()) and len(set().union(*by.values())) == len(by)


def test_clashing_columns(spark):
    inner = "row dk id i d gone lk pos line n root key f best u v".split()
    text = "one line that is there twice\nand one that is not"
    docs = spark.createDataFrame([(1, text, *inner), (2, text + " at all, not here nor anywhere", *inner), (None, None, *inner), (3, "", *inner)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in inner))
    out = lines.kept(docs, least=1)
    assert out.columns == docs.columns
    got = {x["doc_id"]: x for x in out.collect()}
    assert got[2]["text"] == "and one that is not at all, not here nor anywhere" and got[1]["text"] == text and got[None]["text"] is None and got[3]["text"] == ""
    assert all(x[c] == c for x in got.values() for c in inner)


def test_signature_is_that_of_the_line_hash(spark):
    docs = spark.createDataFrame([("häuser und gärten\nabc\n   \n日本語のテキスト行",)], "text string")
    lk = {x["lk"] for x in lines.buckets(docs, 1).collect()}
    assert lk == {x["lk"] for x in lines.occurrences(docs.selectExpr("1 AS id", "text"), 1).collect() if len(x["line"]) >= lines.SHINGLE}


def test_compared_counts_as_sets_do(spark, monkeypatch):
    monkeypatch.setattr(lines, "REMEMBERED", 300)
    r = random.Random(22)
    texts = [prose(r, 30) for _ in range(12)] + ["", "x", "abc", "abcd", "abcde", "a" * 40, "日本語のテキスト行", "é𝄞" * 9, "one " * 500]
    texts += [edited(r, t, 3) for t in texts if len(t) > 20]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))]
    table = spark.createDataFrame(list(enumerate(texts)), "lk long, line string")
    got = {(x["u"], x["v"]): (x["shared"], x["all"]) for x in lines.compared(spark.createDataFrame(pairs, "u long, v long"), table).collect()}
    sets = [{t[k:k + lines.SHINGLE] for k in range(max(1, len(t) - lines.SHINGLE + 1))} for t in texts]
    assert got == {(i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, j in pairs}
