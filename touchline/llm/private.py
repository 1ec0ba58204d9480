"""Personal data by weak supervision.

Regular expressions with checks find the base spans.  Looser expressions propose
further candidates.  Labelers (the strict expressions, a gazetteer, the words in
front, the neighbouring characters, the shape) vote on every candidate: for,
against, or not at all.  Expectation-maximisation over all candidates of the
corpus estimates what each labeler's votes are worth, and a logistic regression
on votes and kind, trained on the resulting probabilities, decides.  Base spans
always stay; the classifier only adds.

A candidate enters EM and regression as its pattern of votes and its kind, and
there are KINDS x 3 ^ LABELERS of those at most: only their counts are gathered.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import documents, inner, let
from touchline.session import cut

#: Stands around matches; in a text it is read as its neighbour, which no pattern matches either.
MARK, NEIGHBOUR = "\ue000", "\ue001"
#: The base patterns.  Possessive loops and anchors at the start of a run find the same as the plain ones, in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates: written-out addresses, national numbers, social security numbers, keys and passwords, of any length.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<=[=:]\x20?[\"'])[A-Za-z0-9_+/-]{16,}+(?=[\"'])",
}
#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "ssn", "secret")
#: What the gazetteer knows, and words that announce personal data or speak against it.
DOMAINS = "com org net edu gov de fr es it uk eu io info".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 64 81 82 86 90 91".split()
ANNOUNCES = "phone|tel|call|mobile|fax|mail|contact|address|card|visa|account|ssn|social|ip|host|token|key|secret|password|passwd"
DENIES = "version|release|page|isbn|issn|doi|chapter|section|figure|total|sum"
NEAR = 24
LABELERS, ROUNDS, STEPS, TRUST, SURE = 5, 50, 300, 0.2, 0.65

SPANS = "array<struct<kind:string,start:int,end:int,s:string,base:boolean,strict:int>>"


def matches(text: Column, pattern: str) -> Column:
    """Start, end (code points, end exclusive) and text of the leftmost non-overlapping matches."""
    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def step(a: Column, p: Column) -> Column:
        end = a["pos"] + F.char_length(p)
        got = F.array(F.struct(a["pos"].alias("start"), end.alias("end"), p.alias("s")))
        return F.struct(end.alias("pos"), (~a["hit"]).alias("hit"), F.when(a["hit"], F.concat(a["out"], got)).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"), none.alias("out")), step)["out"]


def luhn(digits: Column) -> Column:
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda d: (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return let(F.translate(s, " -", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.regexp_replace(s, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def proposed(text: Column) -> Column:
    """All candidates of a text: base matches, strict (1) or failing their check (-1), and loose ones (0)."""
    some = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}

    def span(kind: str, strict: bool):
        def make(x: Column) -> Column:
            ok = valid(kind, x["s"]) if strict else F.lit(False)
            vote = F.when(ok, 1).otherwise(-1 if strict else 0)
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), ok.alias("base"), vote.alias("strict"))

        return make

    lists = []
    for strict, patterns in ((True, BASE), (False, LOOSE)):
        for kind, pattern in patterns.items():
            found = F.transform(matches(text, pattern), span(kind, strict)).cast(SPANS)
            lists.append(F.when(some[kind], found).otherwise(F.array().cast(SPANS)) if strict and kind in some else found)
    return F.concat(*lists)


def voted(text: Column, spans: Column) -> Column:
    """Candidates with the votes v0 .. v4 of the labelers."""

    def votes(x: Column) -> Column:
        kind, s = x["kind"], x["s"]
        begin = F.greatest(F.lit(0), x["start"] - NEAR)
        before = F.lower(F.substring(text, begin + 1, x["start"] - begin))
        last, after = F.right(before, F.lit(1)), F.substring(text, x["end"] + 1, F.lit(1))
        tld, calling = F.lower(F.regexp_extract(s, r"([A-Za-z]+)[^A-Za-z]*$", 1)), F.regexp_extract(s, r"^\+([0-9]+)", 1)
        known = (F.when(kind == "email", F.when(tld.isin(DOMAINS), 1).otherwise(-1))
                 .when(kind == "phone", F.when(calling == "", 0).when(F.exists(F.array(*map(F.lit, CALLING)), lambda c: F.startswith(calling, c)), 1).otherwise(-1))
                 .when(kind == "ip", F.when(s.rlike(r"^(?:0|127|255)\."), -1).otherwise(1)).otherwise(0))
        context = F.when(before.rlike(rf"\b(?:{ANNOUNCES})\b"), 1).when(before.rlike(rf"\b(?:{DENIES})\b"), -1).otherwise(0)
        alone = F.when(F.concat(last, after).rlike(r"[A-Za-z0-9]"), -1).otherwise(1)
        digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
        shape = (F.when(kind == "secret", F.when((digits >= 4) & s.rlike("[A-Za-z]"), 1).otherwise(-1))
                 .when(kind == "card", F.when(digits.between(13, 19), 1).otherwise(-1)).when(kind == "ssn", F.when(s.rlike("^(?:000|666|9)"), -1).otherwise(1)).otherwise(0))
        cols = [x["strict"], known, context, alone, shape]
        return F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), *[c.cast("int").alias(f"v{i}") for i, c in enumerate(cols)])

    return F.transform(spans, votes)


def candidates(docs: DataFrame, text_col: str = "text", into: str = "_c") -> DataFrame:
    own = docs.withColumn("_t", F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), MARK, NEIGHBOUR))
    own = own.withColumn("_s", proposed(F.col("_t")))
    return own.select(*[f"`{c}`" for c in docs.columns], voted(F.col("_t"), F.col("_s")).alias(into))


def reliabilities(counts: dict[tuple, int]) -> dict[tuple, float]:
    """EM: the probability of each pattern of votes (kind, v0, ...) to be personal data.

    A labeler has a chance to vote for among what is personal data, and another
    among what isn't; where it doesn't vote it says nothing, for that follows from
    the kind.  Before anything is seen, with the weight of TRUST of its votes, it
    votes as often for as it does on the whole, a right vote being four times as likely
    as a wrong one: so one that always votes alike says nothing, and the names of the
    two classes can't change over.
    """
    p = {k: 1 / (1 + math.exp(-sum(k[1:]) - k[1])) for k in counts}  # a check that was made counts twice
    total = sum(counts.values())
    cast = [{v: 1 + sum(n for k, n in counts.items() if k[1 + j] == v) for v in (1, -1)} for j in range(LABELERS)]
    for _ in range(ROUNDS):
        prior = (sum(p[k] * n for k, n in counts.items()) + 1) / (total + 2)
        for_it = {}
        for j, y in product(range(LABELERS), (0, 1)):
            seen = {v: TRUST * n * (2.0 if (v > 0) == bool(y) else 0.5) for v, n in cast[j].items()}
            for k, n in counts.items():
                if k[1 + j]:
                    seen[k[1 + j]] += n * (p[k] if y else 1 - p[k])
            for_it[j, y] = {v: x / (seen[1] + seen[-1]) for v, x in seen.items()}
        for k in counts:
            log = math.log(prior / (1 - prior)) + sum(math.log(for_it[j, 1][k[1 + j]] / for_it[j, 0][k[1 + j]]) for j in range(LABELERS) if k[1 + j])
            p[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return p


def features(key: tuple) -> list[float]:
    return [1.0, *(float(key[0] == k) for k in KINDS), *(float(v == s) for v in key[1:] for s in (1, -1))]


def classifier(counts: dict[tuple, int], p: dict[tuple, float]) -> list[float]:
    """Weights of a logistic regression of the probabilities on votes and kind."""
    x = {k: features(k) for k in counts}
    n, w = sum(counts.values()), [0.0] * len(features((KINDS[0], *[0] * LABELERS)))
    for _ in range(STEPS):
        grad = [1e-3 * a for a in w]
        for k, f in x.items():
            off = (1 / (1 + math.exp(-sum(a * b for a, b in zip(w, f, strict=True)))) - p[k]) * counts[k] / n
            grad = [g + off * b for g, b in zip(grad, f, strict=True)]
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def detected(docs: DataFrame, text_col: str = "text", into: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, those in `keep`) with the spans of its texts.

    `into` is an array of (kind, start, end, base, score): all base spans, and the
    candidates of which the classifier is sure and that overlap no base span or
    earlier-listed addition, by kind as in KINDS, then start.  Offsets are code
    points, the end exclusive.  Null texts count as empty and have none; repeated
    rows get the same spans; an empty table gives an empty table.
    """
    keep = docs.columns if keep is None else keep
    seen = cut(candidates(docs, text_col).select(*[f"`{c}`" for c in keep], "_c"), "candidates")
    names = ["kind", *(f"v{i}" for i in range(LABELERS))]
    rows = seen.select(F.explode("_c").alias("c")).select("c.*").groupBy(*names).count().collect()  # bounded by KINDS x 3 ^ LABELERS
    counts = {tuple(r[n] for n in names): r["count"] for r in rows}
    w = classifier(counts, reliabilities(counts)) if counts else [0.0] * len(features((KINDS[0], *[0] * LABELERS)))

    def score(x: Column) -> Column:
        z = F.lit(w[0])
        for i, k in enumerate(KINDS):
            z = z + F.when(x["kind"] == k, w[1 + i]).otherwise(0.0)
        for j in range(LABELERS):
            up, down = w[1 + len(KINDS) + 2 * j:3 + len(KINDS) + 2 * j]
            z = z + F.when(x[f"v{j}"] == 1, up).when(x[f"v{j}"] == -1, down).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    scored = F.transform("_c", lambda x: F.struct(rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"), score(x).alias("score")))
    seen = seen.withColumn("_c", F.sort_array(scored))
    base = F.filter("_c", lambda x: x["base"])
    free = lambda x, others: ~F.exists(others, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    seen = seen.withColumns({"_b": base, "_m": F.filter("_c", lambda x: ~x["base"] & (x["score"] > SURE))})
    seen = seen.withColumn("_m", F.filter("_m", lambda x: free(x, F.col("_b"))))
    seen = seen.withColumn("_m", F.filter("_m", lambda x, i: free(x, F.slice("_m", F.lit(1), i))))
    out = F.transform(F.sort_array(F.concat("_b", "_m")), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), x["score"].alias("score")))
    return seen.select(*[f"`{c}`" for c in keep], out.alias(into))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_private(spark, sf_dir):
    """Personal data in all of `documents`."""
    d = detected(inner(documents(spark, sf_dir), doc_id="doc_id", text="text"), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(n, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {"op8_private": op8_private}
ORACLE: dict[str, str] = {}
