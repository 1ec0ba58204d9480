"""Exact, near, line and passage dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from touchline.llm import common, exact, lines, passages, simhash

SCHEMA = "doc_id long, text string, row long, name string, key int, root string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", 2, "r") for i, t in rows], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    base = [prose(r, n) for n in (3, 30, 60, 120, 200, 400)]
    out = [(i, t) for i, t in enumerate(base * 2)]
    for i, t in enumerate(base[2:], 20):
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append((i, " ".join(w)))
    out += [(40, base[3] + "\n" + base[4]), (41, "intro words here " + base[2] + " and an end"), (42, None), (43, ""), (43, ""), (44, " \t\n"), (None, base[1]), (45, "same " * 90), (46, "long " + "word " * 5000 + prose(r, 50))]
    return out


def components(n, linked):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                par[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    near = {frozenset(p) for p in pairs}
    roots = components(140, lambda i, j: frozenset((i, j)) in near)
    least = {}
    for i, x in enumerate(roots):
        least.setdefault(x, i)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: least[roots[i]] for i in range(140) if any(i in p and len(p) == 2 for p in near)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("size", [7, 4096])
def test_exact(spark, corpus, size):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[t or ""].append(i)
    out = exact.dedup(table(spark, corpus), block_bytes=size).collect()
    assert len(out) == len(corpus)
    sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for x in out:
        g = sha[x["text_sha256"]]
        assert x["group_size"] == len(g) and x["keep_id"] == max((i for i in g if i is not None), default=None) and (not x["kept"] or x["id"] == x["keep_id"])
    assert sum(x["kept"] for x in out) == len(groups) == len({(x["n_blocks"], x["name"]) for x in out})
    assert exact.dedup(table(spark, corpus).limit(0)).count() == 0


def test_exact_with_clashing_hashes(spark, corpus, monkeypatch):
    blocks = exact._blocks
    monkeypatch.setattr(exact, "_blocks", lambda rows, size: blocks(rows, size).withColumn("h", exact.F.octet_length("block").cast("long") % 3))
    out = exact.dedup(table(spark, corpus), block_bytes=64).collect()
    by = defaultdict(set)
    for x in out:
        by[x["n_blocks"], x["name"]].add(x["text_sha256"])
    assert all(len(s) == 1 for s in by.values()) and len(by) == len({t or "" for _, t in corpus})


def bits(t):
    w = (t or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64)) if hs else 0


def test_simhash(spark, corpus):
    f = [bits(t) for _, t in corpus]
    root = components(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 2)
    least = {x: min((i for (i, _), y in zip(corpus, root, strict=True) if x == y and i is not None), default=None) for x in root}
    want = sorted((str(i), f"{p:016x}", least[x]) for (i, _), p, x in zip(corpus, f, root, strict=True))
    assert sorted((str(x["id"]), x["fingerprint"], x["component_id"]) for x in simhash.groups(table(spark, corpus)).collect()) == want
    kept = simhash.keep_one(table(spark, corpus))
    assert kept.columns == table(spark, corpus).columns and kept.count() == len(set(root))
    assert simhash.groups(table(spark, corpus).limit(0)).count() == 0


def test_no_link_is_missed(spark):
    r = random.Random(3)
    f = []
    for _ in range(40):
        x = r.getrandbits(64)
        for k in range(r.randint(1, 8)):
            f.append(x ^ sum(1 << b for b in r.sample(range(64), k % 4)))
    f += [0, 1, 3, 1 << 63, (1 << 63) | 1, (1 << 64) - 1]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in f})
    m = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and ((a & m) ^ (b & m)).bit_count() <= 2}
    got = [(x["u"], x["v"]) for x in simhash.links(spark.createDataFrame([(x,) for x in [*signed, signed[0]]] + [(None,)], "fp long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_passages(spark, corpus):
    seqs = [(t or "").encode().split() for _, t in corpus]
    n = passages.WINDOW
    c = Counter(tuple(w[k:k + n]) for w in seqs for k in range(len(w) - n + 1))
    want = []
    for (i, _), w in zip(corpus, seqs, strict=True):
        gone = {j for k in range(len(w) - n + 1) if c[tuple(w[k:k + n])] > 1 for j in range(k, k + n)}
        want.append((str(i), len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    assert sum(x[2] for x in want) > 1000
    assert sorted((str(x["id"]), x["n_words"], x["n_removed"], x["kept"]) for x in passages.dedup(table(spark, corpus)).collect()) == sorted(want)
    assert passages.dedup(table(spark, corpus).limit(0)).count() == 0


def test_cover_meets_every_pair():
    assert all(any((i + s) % passages.PERIOD in passages.COVER and (j + s) % passages.PERIOD in passages.COVER for s in range(passages.PERIOD)) for i in range(passages.PERIOD) for j in range(passages.PERIOD))
    x = np.arange(1, 200, dtype=np.uint64)
    y = np.concatenate([x[50:90], x[:10], x[50:90]])
    h = passages.rolled(passages.mixed(y, 1), 35, 0x9E3779B97F4A7C15)
    assert (h[:6] == h[50:56]).all() and len(set(h.tolist())) == len(h) - 6


def similar(a, b):
    a, b = ({t[k:k + 5] for k in range(max(1, len(t) - 4))} for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def test_lines(spark):
    r = random.Random(5)
    base = [prose(r, n) for n in (12, 15, 20, 9, 30)]
    odd = [b[:len(b) // 2] + "X" + b[len(b) // 2 + 1:] for b in base]
    rows = [(i, "\n".join([prose(r, 14), base[i % 5], "short", prose(r, 11)])) for i in range(20)]
    rows += [(30 + i, odd[i] + "\nshort\n") for i in range(5)] + [(40, None), (41, ""), (None, base[0]), (42, "-" * 60 + "\n" + "-" * 60), (43, " " * 60 + "\n" + " " * 60), (44, "字" * 50), (45, "字" * 50)]
    occ = [(i, k, x) for i, t in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0)) for k, x in enumerate((t or "").split("\n")) if len(x) >= 40 and re.search(r"[^\x20\x09-\x0D]", x)]
    root = components(len(occ), lambda a, b: similar(occ[a][2], occ[b][2]))
    seen, want = set(), defaultdict(list)
    for (i, k, _), x in zip(occ, root, strict=True):
        if x in seen:
            want[i].append(k)
        seen.add(x)
    out = lines.dedup(table(spark, rows))
    got = {x["doc_id"]: sorted(x["_gone"]) for x in out.collect()}
    assert got == {i: want[i] for i, _ in rows}
    text = dict(rows)
    for x in out.collect():
        t = text[x["doc_id"]]
        assert x["text"] == (None if t is None else "\n".join(y for k, y in enumerate(t.split("\n")) if k not in want[x["doc_id"]])) and x["row"] == 1
    assert lines.dedup(table(spark, rows).limit(0)).count() == 0
