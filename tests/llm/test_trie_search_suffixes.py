"""Burst tries, ranked search and the suffix sort against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.test_dedup import prose, table
from touchline.llm import lexical, suffixes, tries

TURNS = "conv_id long, turn long, role string, text string, s string, box string, key string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "s", "b", "k") for r in rows], TURNS)


def trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[:len(q)] == q and len(r) > len(q) for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(cs) if whole[c] == p).encode()).hexdigest()
        out[min(cs), len(p)] = (min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, ends)
    return out


@pytest.mark.parametrize("full", [1, 3, 2048])
def test_trie(spark, full):
    r = random.Random(full)
    rows = []
    for c in range(90):
        start = r.choice([[], ["a"], ["a", "b"], ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"]])
        for t, text in enumerate(start + [r.choice("xyzß") for _ in range(r.randint(0, 14))]):
            rows.append((c, t, r.choice(["user", "user", None]), text))
    rows += [(200 + k, t, "user", x) for k in range(40) for t, x in enumerate("abcdefghijklm")]
    rows += [(300, None, "user", "null first"), (300, 0, None, None), (300, 0, "a", None), (300, 0, "a", None), (None, 1, "user", "of none"), (301, 5, "us", "er"), (302, 5, "use", "r"), (10**12, 1, "user", "a")]
    r.shuffle(rows)
    want = trie(rows)
    got = tries.nodes(tries.rebuilt(tries.strings(conversations(spark, rows))), full).collect()
    assert len(got) == len(want)
    assert {(x["conv_id"], x["depth"]): tuple(x)[2:] for x in got} == {k: (v[0], *v[1:]) for k, v in want.items()}


def test_trie_of_nothing(spark):
    assert tries.nodes(tries.rebuilt(tries.strings(conversations(spark, [])))).count() == 0
    turnless = tries.nodes(tries.rebuilt(tries.strings(conversations(spark, [(1, 1, "user", "x")])))).collect()  # crc32("1") % 9 = 1, no conversation 0
    assert [tuple(x) for x in turnless] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_ids_of_equal_conversations_meet_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 7)
    convs = spark.createDataFrame([(c, bytes([c % 2])) for c in range(101)], "conv long, s binary")
    want = {hashlib.sha256(",".join(map(str, range(k, 101, 2))).encode()).hexdigest() for k in (0, 1)}
    assert {x["sha"] for x in tries.ends(convs).collect()} == want


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    N, L = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    query = defaultdict(set)
    for i, t in items:
        query[i] |= set(terms(t))
    out = []
    for i, ts in query.items():
        scores = []
        for (d, c), n in zip(counts, sizes, strict=True):
            if d is not None and n:
                m = 100 - 50 + 50 * n * N // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
                scores.append((-s, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(x for x in scores if x[0])[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k,cells,block_bytes", [(50, 1 << 23, 1 << 20), (3, 64, 100), (5, 1000, 1 << 20)])
def test_search(spark, monkeypatch, k, cells, block_bytes):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "QUERY_BYTES", block_bytes)
    monkeypatch.setattr(lexical, "STEP", 4)
    r = random.Random(4)
    docs = [(i, prose(r, r.choice([1, 5, 40, 200]))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(60)] + [(300, None), (301, ""), (302, " -_.\t"), (303, "ALPHA Ünï ünï Ü beta-gamma_1x"), (None, docs[3][1]), (304, "word " * 70_000 + "alpha"), (304, "eta"), (304, "eta")]
    items = [(i, prose(r, n)) for i, n in enumerate([1, 2, 10, 30, 90])] + [(5, None), (6, "nowhere"), (7, "Ünï Alpha"), (8, "alpha"), (8, "beta beta"), (9, "")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id int, text string, item string, rank int")
    got = lexical.search(table(spark, docs).repartition(5), frame, k=k).collect()
    assert sorted(tuple(x) for x in got) == ranked(docs, items, k)


def test_masks_of_many_terms():
    import numpy as np

    r = np.random.default_rng(1)
    present = r.random((150, 40)) < 0.5
    present[:, 20:] = present[:, :20]
    one, mask = lexical.masks(present)
    assert len(one) == 20 and (present[:, one[mask]] == present).all()


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical.search(table(spark, []), items).count() == 0
    assert lexical.search(table(spark, [(1, "alpha")]), items.limit(0)).count() == 0
    assert lexical.search(table(spark, [(1, None)]), items).count() == 0


def without_repeats(docs, n):
    raw = [(t or "").encode() for _, t in docs]
    c = Counter(b[k:k + n] for b in raw for k in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(docs, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if c[b[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        out.append((str(i), len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def test_suffixes(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdeüß字", k=r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(n) for n in (30, 90, 200, 400, 150)]
    docs = list(enumerate(base + base[:3]))
    for k in range(40):  # stretches shared with different surroundings, some a byte too short
        s = r.choice(base[2:])
        a = r.randrange(max(1, len(s) - 420))
        docs.append((100 + k, text(r.randint(0, 40)) + s[a:a + r.choice([180, 250, 390, 399, 400, 401, 460, 700])] + text(r.randint(0, 40))))
    for k, n in enumerate((398, 399, 400, 401)):
        x = "".join(r.choices("klmnopq", k=n))
        docs += [(200 + 2 * k, "<" + x + ">"), (201 + 2 * k, "(" + x + ")")]
    edited = list(base[3])
    for k in range(150, len(edited), 700):
        edited[k] = "#"
    docs += [(300, "".join(edited)), (301, None), (302, ""), (302, ""), (None, base[4]), (303, "ab" * 700), (304, "x" * 1000), (305, "ab" * 300 + text(5)), (306, base[1] + base[1])]
    got = suffixes.dedup(table(spark, docs).repartition(5)).collect()
    want = without_repeats(docs, suffixes.WINDOW)
    assert sum(x[2] for x in want) > 10_000 and any(x[3] > 1 for x in want)
    assert sorted((str(x["id"]), x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == want


def test_suffixes_of_other_windows(spark):
    r = random.Random(8)
    x = "".join(r.choices("abc", k=1200))
    docs = [(1, x[:700]), (2, x[300:]), (3, x[100:363]), (4, x[200:464]), (5, "".join(r.choices("abc", k=900)))]
    got = suffixes.dedup(table(spark, docs), window=264).collect()
    assert sorted((str(y["id"]), y["n_bytes"], y["n_removed"], y["n_spans"], bytes(y["kept"])) for y in got) == without_repeats(docs, 264)
    assert suffixes.dedup(table(spark, docs).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffixes.dedup(table(spark, docs), window=100)
