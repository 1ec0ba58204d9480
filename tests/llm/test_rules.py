"""Quality rules, personal data, licenses and mixing against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from touchline.llm import licenses, mixing, private, quality

SCHEMA = "doc_id long, text string, lang string, source string, q int, kept string, h string, spans int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 1, "k", "h", 2) for i, t, lang, src in rows], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["the", "of", "and", "a", "river", "stone", "walks", "under", "bright", "mornings", "slowly", "Tree"]) + r.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(1)
    rows = [(i, "\n".join(prose(r, 40) for _ in range(1 + i % 5)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, "en", None), (101, "", None, "s1"), (102, " \n\t ", "en", "s1"), (103, "### $$$ %%% &&& " * 15, "en", "s0"), (104, "same line here\n" * 40, "en", "s0"), (None, prose(r, 90), "en", "s2"),
             (105, "qxj zzv " * 10 + " ".join(f"w{k}x" for k in range(300)), "en", None), (106, prose(r, 60), "xx", "é"), (60, prose(r, 55), "en", "z")]
    return rows + [rows[3], rows[3]]


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen = {}
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k:k + 3]), []).append(k)
    ls = [x for x in t.split("\n") if WORD.search(x)]
    again = {j for v in seen.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(again)


def test_quality(spark, corpus):
    d = table(spark, corpus)
    out = quality.judged(d, into="verdict").select("doc_id", "text", "q", "verdict.*").collect()
    assert len(out) == len(corpus)
    for x in out:
        n, *rest = counts(x["text"])
        assert [x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]] == [n, *rest]
        assert x["base_failed"] == (n < 50 or 100 * rest[-1] > 50 * n) and not (x["base_failed"] and x["kept"])
    by = {x["doc_id"]: x for x in out}
    assert by[1]["char_distance"] < 0.2 and by[103]["char_distance"] > 0.5 and by[105]["word_distance"] > 0.21
    assert not by[105]["kept"] and by[106]["char_distance"] is None
    kept = quality.kept(d)
    assert kept.columns == d.columns and kept.count() == sum(x["kept"] for x in out)
    assert quality.judged(d.limit(0)).count() == 0


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [3, 0, 5, 2], [1, 4, 0, 5]
    a, b = [x / 10 for x in p], [x / 10 for x in q]
    kl = lambda u, v: sum(x * math.log2(x / y) for x, y in zip(u, v, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(a, b, strict=True)]
    row = spark.range(1).select(quality.distance(quality.shares(F.array(*map(F.lit, p)), F.lit(10)), quality.shares(F.array(*map(F.lit, q)), F.lit(10)))).first()[0]
    assert row == pytest.approx(math.sqrt((kl(a, m) + kl(b, m)) / 2))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    return True


def base(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if passes(k, m.group())]


def test_base_spans(spark):
    r = random.Random(2)
    bits = ["a", "b.c", "@", "@x.de", ".", "-", "_", "+", "+49 30 1234567", "1", "12", "255", "256", ".1", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", " ", "é", "日", "", "9" * 20, "000", "+1 (555) 010-9999", "a@b.c_d@e.f"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 14))), "en", "s") for i in range(600)] + [(700, None, "en", "s"), (701, "9" * 3000 + "a" * 3000 + "@x.org " + "1." * 3000, "en", "s")]
    out = private.detected(table(spark, rows), into="found").select("doc_id", "text", "found").collect()
    assert len(out) == len(rows)
    for x in out:
        assert [(s["kind"], s["start"], s["end"]) for s in x["found"] if s["base"]] == base(x["text"] or "")


def test_added_spans(spark):
    r = random.Random(3)
    rows = []
    for i in range(200):
        plant = ["", f"mail {prose(r, 1)[:3]}{i}@site.com now", f"call phone +49 30 {r.randint(1000000, 9999999)} ok", f"phone: {r.randint(200, 999)}-555-{r.randint(1000, 9999)} ok", f"host 10.2.{i}.7 up"][i % 5]
        rows.append((i, f"{prose(r, 20)} {plant} {prose(r, 20)}", "en", "s"))
    out = {x["doc_id"]: x for x in private.detected(table(spark, rows), into="found").collect()}
    assert all(not out[i]["found"] for i in range(0, 200, 5))
    assert all(s["base"] or s["score"] > private.SURE for x in out.values() for s in x["found"])
    assert private.detected(table(spark, rows).limit(0)).count() == 0


def test_em_learns_which_labeler_is_right():
    counts = Counter()
    r = random.Random(4)
    for _ in range(4000):
        y = r.random() < 0.4
        votes = [(1 if y else -1) * (1 if r.random() < a else -1) if r.random() < 0.9 else 0 for a in (0.95, 0.9, 0.9, 0.55, 0.85)]
        counts["phone", *votes] += 1
    p = private.reliabilities(dict(counts))
    assert p["phone", 1, 1, 1, -1, 1] > 0.95 and p["phone", -1, -1, -1, 1, -1] < 0.05
    w = private.classifier(dict(counts), p)
    score = lambda k: sum(a * b for a, b in zip(w, private.features(k), strict=True))
    assert score(("phone", 1, 1, 1, 0, 1)) > 0 > score(("phone", -1, -1, -1, 0, -1))


def test_licenses(spark):
    r = random.Random(5)
    t = licenses.TEMPLATES
    rows = [(1, prose(r, 50) + " " + t["MIT text"] + " " + prose(r, 50), "en", "s"), (2, t["MIT"] + "\n" + prose(r, 400) + "\n" + t["MIT"], "en", "s"), (3, prose(r, 300), "en", "s"), (4, None, "en", "s"), (5, "", "en", "s"),
            (6, " ".join(w for k, w in enumerate(t["BSD-3-Clause"].split()) if k % 12), "en", "s"), (7, t["MIT text"] * 3, "en", "s"), (8, prose(r, 5).join(["Licensed", "under the Apache", "License", "Version", "2", "0"]) , "en", "s")]
    got = {(x["id"], x["license"]): x for x in licenses.scan(table(spark, rows)).collect()}
    assert got[1, "MIT text"]["coverage"] == 1 and got[1, "MIT text"]["first_word"] == 50
    assert (2, "MIT") in got and got[6, "BSD-3-Clause"]["coverage"] > 0.85 and got[7, "MIT text"]["coverage"] == 1
    assert not any(i in (3, 4, 5) for i, _ in got)
    assert licenses.scan(table(spark, rows).limit(0)).count() == 0


def test_other_licenses_are_not_taken_for_a_template(spark):
    t = licenses.TEMPLATES
    others = ["Released under the BSD License.", "Licensed under CC BY 4.0.", t["GPL-3.0"].replace("3", "2"), t["CC-BY-4.0"].replace("Attribution", "Attribution-NonCommercial"),
              t["GPL-3.0 header"].replace("version 3", "version 2"), t["GPL-3.0 header"].replace("GNU General", "GNU Lesser General"), "Licensed under the Apache License, Version 1.1."]
    assert licenses.scan(table(spark, [(i, x, "en", "s") for i, x in enumerate(others)])).collect() == []
    got = licenses.scan(table(spark, [(i, f"One two. {x} Three.", "en", "s") for i, x in enumerate(t.values())])).collect()
    assert {(x["id"], x["license"], x["first_word"]) for x in got} >= {(i, k, 2) for i, k in enumerate(t)}


def test_loose_candidates_of_any_length(spark):
    """Long secrets and written-out addresses are proposed whole; nothing else changes."""
    long, key = "ab1" * 40_000, "k9Z_" * 30_000
    texts = [f'token="{key}" x', f"mail {long} [at] {long} [dot] com now", "joe (at) host.org", "key='" + "a1" * 8 + "'", "key='" + "a1" * 7 + "'", "a (at) b", f'token="{key} x', None, ""]
    rows = private.candidates(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).select("doc_id", "_c").collect()
    got = {r["doc_id"]: [(c["kind"], c["start"], c["end"]) for c in r["_c"] if not c["base"] and c["v0"] == 0] for r in rows}
    assert got == {0: [("secret", 7, 7 + len(key))], 1: [("email", 5, len(texts[1]) - 4)], 2: [("email", 0, 17)], 3: [("secret", 5, 21)], 4: [], 5: [], 6: [], 7: [], 8: []}


NOTICES = {k: licenses.words(t) for k, t in licenses.TEMPLATES.items() if len(licenses.words(t)) <= licenses.NOTICE}
PHRASES = {k: [licenses.words(p) for p in ps] for k, ps in licenses.TELLING.items()}


def notices_by_brute_force(text):
    """All notices of which the longest common subsequence with some stretch of the text makes a match."""
    ws, out = licenses.words(text), set()
    for k, b in NOTICES.items():
        for lo in (i for i, w in enumerate(ws) if w in b):
            row = [0] * (len(b) + 1)
            for hi in range(lo, min(len(ws), lo + 2 * len(b))):
                old = row[:]
                for j, w in enumerate(b, 1):
                    row[j] = max(old[j], row[j - 1], old[j - 1] + 1 if w == ws[hi] else 0)
                if ws[hi] in b and licenses.accepted(ws, lo, hi, row[-1], b, PHRASES[k]):
                    out.add(k)
    return out


def reworded(r):
    """Notices with words left out, put in or changed, among words of theirs."""
    parts = []
    for _ in range(r.randint(1, 4)):
        b = licenses.TEMPLATES[r.choice(sorted(NOTICES))].split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            i, how = r.randrange(len(b)), r.random()
            b[i:i + 1] = [] if how < 0.3 else [r.choice(["an", "the", "stone", "version", "3"])] if how < 0.5 else [b[i], b[i]] if how < 0.7 else [r.choice(["the", "this", "river", "license", "under"]), b[i]]
        parts.append(" ".join(b))
        parts.append(" ".join(r.choice(["the", "river", "under", "walks", "license", "this", "stone", "a", "version"]) for _ in range(r.choice([0, 1, 3, 12, 40]))))
    return " ".join(parts)


def test_reworded_notices_against_brute_force(spark):
    r = random.Random(11)
    texts = [reworded(r) for _ in range(400)]
    got, found, apart = {}, 0, 0
    for x in licenses.scan(table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        got.setdefault(x["id"], set()).add(x["license"])
    one = lambda ks: {"GPL-3.0" if k == "GPL-3.0 terms" else k for k in ks}  # noqa: E731  (a part of the other's stretch isn't told)
    for i, t in enumerate(texts):
        want, have = one(notices_by_brute_force(t)), one(got.get(i, set()))
        assert have <= want
        found, apart = found + len(want), apart + len(want - have)
    assert found > 400 and apart <= found // 200  # patience alignment isn't a longest common subsequence


def test_matches_are_aligned(spark):
    """Every row has its words in the order of the template; longer licenses hide those they contain; texts of any length end."""
    t = licenses.TEMPLATES | licenses.OTHERS
    rows = [(1, t["BSD-3-Clause"], "en", "s"), (2, t["BSD-2-Clause"], "en", "s"), (3, t["Apache-2.0 header"], "en", "s"), (4, "Released under an MIT License.", "en", "s"), (5, "Released under a non-MIT License.", "en", "s"),
            (6, t["MIT text"][:len(t["MIT text"]) // 2], "en", "s"), (7, (t["LGPL-3.0 header"] + " ") * 200, "en", "s"), (8, "the license under " * 100_000 + t["ISC"], "en", "s"), (9, t["MIT"] + " " + t["MIT"], "en", "s")]
    rows += [rows[3], (None, t["MIT"], "en", "s")]
    out = licenses.scan(table(spark, rows), t).collect()
    assert sorted((str(x["id"]), x["license"]) for x in out) == sorted([("1", "BSD-3-Clause"), ("2", "BSD-2-Clause"), ("3", "Apache-2.0 header"), ("4", "MIT"), ("4", "MIT"), ("7", "LGPL-3.0 header"), ("8", "ISC"), ("9", "MIT"), ("None", "MIT")])
    text = {i: licenses.words(x) for i, x, *_ in rows}
    for x in out:
        b = licenses.words(t[x["license"]])
        pairs = licenses.aligned(text[x["id"]][x["first_word"]:x["last_word"] + 1], b)
        assert x["n_aligned"] == len(pairs) == x["coverage"] * len(b) and all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert {x["first_word"] for x in out if x["id"] in (7, 9)} == {0}  # of equally good stretches the first


def test_longest_chain():
    r = random.Random(6)
    for _ in range(200):
        js = r.sample(range(30), 9)
        got = [j for _, j in licenses.chain(list(enumerate(js)))]
        top = max((sum(1 for _ in s) for m in range(1, 512) if (s := [js[k] for k in range(9) if m >> k & 1]) == sorted(s)), default=0)
        assert got == sorted(got) and len(got) == top and [j for j in js if j in got] == got


def shares(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, rest, open_ = {}, sum(sizes.values()), set(names)
    while True:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in over}
        rest, open_ = rest - sum(most * sizes[s] for s in over), open_ - over


def test_mixing(spark, corpus):
    d = table(spark, corpus)
    out = mixing.mix(d).collect()
    assert len(out) == len(corpus)
    sizes = Counter()
    for _, t, _, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    aims, largest = shares(dict(sizes)), Counter()
    for x in out:
        largest[x["source"]] = max(largest[x["source"]], x["size"])
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(aims[x["source"]]) and x["taken"] <= 3 * x["size"]
    for s, aim in aims.items():
        assert abs(sum(x["taken"] for x in out if x["source"] == s) - aim) <= 3 * largest[s]  # a row that is there three times is one draw
    again = sorted((str(x["id"]), x["taken"]) for x in mixing.mix(d.repartition(5)).collect())
    assert again == sorted((str(x["id"]), x["taken"]) for x in out)
    rows = mixing.repeated(d)
    assert rows.columns == d.columns and Counter(str(x["doc_id"]) for x in rows.collect()) == Counter(str(x["id"]) for x in out for _ in range(x["copies"]))
    assert mixing.mix(d.limit(0)).count() == 0
