"""Line dedup: signatures of every kind of line, all pairs of a bucket, short lines."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.test_dedup import components, prose, similar, table
from touchline.llm import lines

CJK = [chr(c) for c in range(0x4E00, 0x5200)]
ASCII = "abcdefghijklmnopqrstuvwxyz0123456789-_/."


def edited(r, t, n):
    for _ in range(n):
        k = r.randrange(len(t))
        t = t[:k] + r.choice(ASCII) + t[k + 1:]
    return t


def kinds(r):
    yield "clauses", lambda: " ".join("".join(r.choices(CJK, k=40)) for _ in range(12)), 12
    yield "more clauses", lambda: " ".join("".join(r.choices(CJK, k=30)) for _ in range(30)), 16
    yield "paths", lambda: " ".join("/" + "".join(r.choices(ASCII, k=44)) for _ in range(12)), 10
    yield "tables", lambda: " | ".join(str(r.randrange(10**11)) for _ in range(30)), 8
    yield "prose", lambda: prose(r, 60), 6
    yield "short", lambda: prose(r, 7), 1


def test_similar_lines_share_a_bucket(spark):
    r, rows = random.Random(11), []
    for kind, make, edits in kinds(r):
        while sum(x[0] == kind for x in rows) < 150:
            a = make()
            b = edited(r, a, r.randint(1, edits))
            if similar(a, b):
                rows.append((kind, a, b))
    d = spark.createDataFrame(rows, "kind string, a string, b string").repartition(4)
    shares = d.select("kind", F.arrays_overlap(lines.signed(F.col("a")), lines.signed(F.col("b"))).cast("int").alias("s")).groupBy("kind").agg(F.avg("s").alias("s"))
    assert {x["kind"]: x["s"] for x in shares.collect() if x["s"] < 0.97} == {}


def test_no_pair_of_a_bucket_is_missed(spark, monkeypatch):
    monkeypatch.setattr(lines, "LISTED", 6)
    r = random.Random(12)
    base = [prose(r, 20) for _ in range(7)]
    texts = base + [edited(r, x, k) for x in base[:3] for k in (1, 2, 3, 4)]
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    occ = lines.occurrences(docs).select("lk", "line").collect()
    want = components(len(occ), lambda i, j: similar(occ[i]["line"], occ[j]["line"]))
    one = spark.createDataFrame([(x["lk"], [7]) for x in occ], "lk long, keys array<long>")
    got = {x["node"]: x["root"] for x in lines.classes(docs, one).collect()}
    by = defaultdict(set)
    for x, c in zip(occ, want, strict=True):
        by[c].add(got.get(x["lk"], x["lk"]))
    assert max(Counter(want).values()) > 3 and all(len(s) == 1 for s in by.values()) and len(set().union(*by.values())) == len(by)


def test_short_lines_take_part(spark):
    rows = [(1, "Home\nAbout us\n\n--\nx"), (2, "Home\nAbout us\n\n--\nx"), (3, "About us here and there\nAbout us here and there.\n \n"), (4, "x\ny")]
    got = {x["doc_id"]: sorted(x["_gone"]) for x in lines.dedup(table(spark, rows), least=1).collect()}
    assert got == {1: [], 2: [0, 1, 3, 4], 3: [1], 4: [0]}


def test_no_copy_is_left(spark):
    sf = "/root/testdata/sf0.001"
    out = lines.op7_line_dedup(spark, sf).select("doc_id", "dropped").collect()
    gone = {x["doc_id"]: {int(k) for k in x["dropped"].split(",") if k} for x in out}
    left = Counter(t for x in spark.read.parquet(f"{sf}/documents.parquet").collect() for k, t in enumerate((x["text"] or "").split("\n")) if t.strip(" \t\n\v\f\r") and k not in gone[x["doc_id"]])
    assert max(left.values()) == 1
