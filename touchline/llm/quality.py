"""Quality rules: how far a text's histograms are from its language.

For every text two histograms are counted: of character classes and of common
words.  The reference of a language is the sum over all of its documents.  A
text is rejected if the Jensen-Shannon distance (base 2, from 0 to 1) of either
histogram to the reference is over its limit.  Both the text and the reference
need a minimum length before a verdict counts; short histograms scatter, so the
limit of a text rises with one over the root of its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import BLANKS, documents, inner, let, words
from touchline.session import cut

#: Frequent words of some languages; one histogram of all of them serves every language.
COMMON = """
a and as at by for in is it of on that the to was with
auf das dem den der die ein eine im ist mit nicht und von zu
au dans des du en est et la le les par pour que un une
al con de del el en la las lo los no por que se un y
""".split()
COMMON = sorted(set(COMMON))
#: Classes of characters: what is taken out of the text in turn, and counted by the length that is lost.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("blank", BLANKS), ("digit", "[0-9]+"), ("letter", r"[\p{L}\p{M}]+"), ("point", r"[.,;:!?'\"()-]+"), ("symbol", r"[#*$%&|<>]+"))
#: Limits of the distances, how they loosen with few observations, and the least numbers of words and characters.
CHAR_LIMIT, CHAR_SCATTER, WORD_LIMIT, WORD_SCATTER = 0.15, 1.4, 0.04, 3.0
LEAST_WORDS, LEAST_REFERENCE = 50, 5000
#: The base rules: fewest words, and the largest share of words in repeated windows.
BASE_WORDS, BASE_REPEATED, WINDOW = 50, 50, 3


def repeated_words(w: Column) -> Column:
    """Words of array `w` that lie in a window of three which the text has twice or more.

    Windows are told apart by 64-bit hashes within one text.
    """
    def covered(runs: Column) -> Column:
        # sorted by hash: a window is repeated if a neighbour has its hash
        again = F.filter(runs, lambda x, i: (F.get(runs, i - 1)["h"] == x["h"]) | (F.get(runs, i + 1)["h"] == x["h"]))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        # each start adds what its window covers beyond the one before
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(x - F.get(s, i - 1), F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def windows(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - WINDOW), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)))

    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(windows(w), count))


def measured(docs: DataFrame, text_col: str = "text", into: str = "_q") -> DataFrame:
    """`docs` with a struct of counts: of words, symbols, repeats, character classes and common words."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    left, lengths = docs.withColumn("_t0", text), []
    for k, (_, pattern) in enumerate(CLASSES):
        left = left.withColumn(f"_t{k + 1}", F.regexp_replace(f"_t{k}", pattern, ""))
        lengths.append(F.char_length(f"_t{k}") - F.char_length(f"_t{k + 1}"))
    left = left.withColumn("_w", words(F.col("_t0")))
    # Each common word between two spaces; what removing a word takes away tells how often it is there.
    common = F.array_join(F.filter("_w", lambda x: x.isin([*COMMON, *(c.capitalize() for c in COMMON)])), "  ")
    left = left.withColumn("_c", F.concat(F.lit(" "), F.lower(common), F.lit(" ")))
    lines = F.filter(F.split("_t0", "\n"), lambda x: F.length(F.regexp_replace(x, BLANKS, "")) > 0)
    hits = [((F.octet_length("_c") - F.octet_length(F.replace("_c", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("int") for w in COMMON]
    n_words, chars = F.size("_w"), F.char_length("_t0")
    blank, symbol = lengths[2], lengths[6]
    q = F.struct(
        n_words.cast("long").alias("n_words"), (chars - blank).cast("long").alias("word_chars"), symbol.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.array(*lengths, F.char_length(f"_t{len(CLASSES)}")).alias("chars"), F.array(*hits).alias("common"))
    return left.select(*[f"`{c}`" for c in docs.columns], q.alias(into))


def references(counted: DataFrame) -> DataFrame:
    """`lang`, `ref_words`, `ref_chars`, `ref_common`: the sums over all documents of a language (null is one too)."""
    n, k = len(CLASSES) + 1, len(COMMON)
    sums = counted.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n)], *[F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(k)])
    return sums.select("lang", "ref_words", F.array(*[f"c{i}" for i in range(n)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(k)]).alias("ref_common"))


def shares(counts: Column, total: Column) -> Column:
    return let(F.greatest(F.lit(1), total), lambda n: F.transform(counts, lambda x: x / n))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", into: str = "_q", keep: list[str] | None = None) -> DataFrame:
    """`docs` (of its columns, those in `keep`) with a struct of the counts, distances and verdicts.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance, kept.  Null texts count as empty and
    fail the base rules.  Without enough words in the text or in all texts of its
    language there is no distance (null) and no rejection by it.  Repeated rows
    are judged alike; an empty table gives an empty table.
    """
    keep = docs.columns if keep is None else keep
    own = measured(docs, text_col, "_q0").select(*[f"`{c}`" for c in keep], F.col(f"`{lang_col}`").alias("_l"), "_q0")
    counted = cut(own, "counts")
    ref = references(counted.select(F.col("_l").alias("lang"), "_q0.n_words", "_q0.chars", "_q0.common"))
    tail = lambda counts, n: F.concat(counts, F.array(F.greatest(F.lit(0), n - F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x))))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    ref = cut(ref.select(F.col("lang").alias("_lang"), "ref_words", shares(F.col("ref_chars"), total(F.col("ref_chars"))).alias("ref_chars"),
                         shares(tail(F.col("ref_common"), F.col("ref_words")), F.col("ref_words")).alias("ref_common")), "references")
    # As many rows as languages; Spark broadcasts them if they are as few as they should be.
    both, q = counted.join(ref, F.col("_l").eqNullSafe(F.col("_lang")), "left"), F.col("_q0")
    enough = (q["n_words"] >= LEAST_WORDS) & (F.col("ref_words") >= LEAST_REFERENCE)
    char_d = F.when(enough, distance(shares(q["chars"], total(q["chars"])), F.col("ref_chars")))
    word_d = F.when(enough, distance(shares(tail(q["common"], q["n_words"]), q["n_words"]), F.col("ref_common")))
    failed = (q["n_words"] < BASE_WORDS) | (100 * q["n_repeat_words"] > BASE_REPEATED * q["n_words"])
    both = both.withColumns({"_cd": char_d, "_wd": word_d})
    short = 1 / F.sqrt(F.greatest(F.lit(1), q["n_words"]))
    over = (F.coalesce("_cd", F.lit(0.0)) > CHAR_LIMIT + CHAR_SCATTER * short) | (F.coalesce("_wd", F.lit(0.0)) > WORD_LIMIT + WORD_SCATTER * short)
    counts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return both.select(*[f"`{c}`" for c in keep], F.struct(*counts, failed.alias("base_failed"), F.col("_cd").alias("char_distance"), F.col("_wd").alias("word_distance"), (~failed & ~over).alias("kept")).alias(into))


def kept(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that pass, all columns as they are."""
    return judged(docs, text_col, lang_col, "_q").where("_q.kept").drop("_q")


def op3_quality(spark, sf_dir):
    """All of `documents` by the quality rules."""
    d = inner(documents(spark, sf_dir), doc_id="doc_id", text="text", lang="lang")
    out = judged(d, keep=["doc_id"]).select("doc_id", "_q.*")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def _oracle() -> str:
    """The same in SQL: histograms as lists, references as lists of sums."""
    nth = lambda k: f"regexp_replace(t{k}, '{CLASSES[k][1].replace(chr(39), chr(39) * 2)}', '', 'g')"
    steps = "".join(f", s{k + 1} AS (SELECT *, {nth(k)} AS t{k + 1} FROM s{k})" for k in range(len(CLASSES)))
    lost = ", ".join(f"length(t{k}) - length(t{k + 1})" for k in range(len(CLASSES)))
    sums = lambda name: f"SELECT lang, list(n ORDER BY k) AS {name} FROM (SELECT lang, k, sum({name}[k]) AS n FROM h, range(1, len({name}) + 1) AS r(k) GROUP BY lang, k) GROUP BY lang"
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p}) + ({q})) * 2) ELSE 0 END"
    p, q = "({a}[k] / greatest(1, list_sum({a})))", "({b}[k] / greatest(1, list_sum({b})))"
    pair = part.replace("{x}", p) + " + " + part.replace("{x}", q)
    jsd = lambda a, b: "sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda k: " .replace("{a}", a) + pair.replace("{p}", p).replace("{q}", q).replace("{a}", a).replace("{b}", b) + ")) / 2))"
    return rf"""
WITH s0 AS (SELECT doc_id, lang, coalesce(text, '') AS t0, list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '') AS ws FROM documents){steps},
m AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, [{lost}, length(t{len(CLASSES)})] AS chars,
  list_transform({COMMON!r}, lambda c: len(list_filter(ws, lambda x: x = c OR x = upper(c[1]) || c[2:]))) AS common,
  list_filter(string_split(t0, chr(10)), lambda x: length(regexp_replace(x, '{BLANKS}', '', 'g')) > 0) AS ls,
  list_transform(range(1, len(ws) - {WINDOW} + 2), lambda i: array_to_string(ws[i:i + {WINDOW} - 1], ' ')) AS runs FROM s{len(CLASSES)}),
twice AS (SELECT doc_id, list(i) AS starts FROM (SELECT doc_id, unnest(runs) AS s, unnest(range(1, len(runs) + 1)) AS i FROM m) SEMI JOIN
  (SELECT doc_id, s FROM (SELECT doc_id, unnest(runs) AS s FROM m) GROUP BY doc_id, s HAVING count(*) > 1) USING (doc_id, s) GROUP BY doc_id),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(starts) AS i FROM twice), range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
h AS (SELECT doc_id, lang, n_words, chars, list_append(common, n_words - list_sum(common)) AS common, ls FROM m),
ref AS (SELECT * FROM (SELECT lang, sum(n_words) AS ref_words FROM h GROUP BY lang) JOIN (SELECT lang AS l1, chars AS ref_chars FROM ({sums("chars")})) ON lang IS NOT DISTINCT FROM l1
  JOIN (SELECT lang AS l2, common AS ref_common FROM ({sums("common")})) ON lang IS NOT DISTINCT FROM l2),
j AS (SELECT h.*, coalesce(again.n, 0) AS n_repeat_words, n_words >= {LEAST_WORDS} AND ref_words >= {LEAST_REFERENCE} AS enough,
  {jsd("chars", "ref_chars")} AS cd, {jsd("common", "ref_common")} AS wd FROM h JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang LEFT JOIN again USING (doc_id)),
v AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED} * n_words AS base_failed FROM j)
SELECT doc_id, n_words, CAST(list_sum(chars) - chars[3] AS BIGINT) AS word_chars, CAST(chars[7] AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CASE WHEN enough THEN round(cd, 6) END AS char_distance, CASE WHEN enough THEN round(wd, 6) END AS word_distance,
  NOT base_failed AND NOT (enough AND (cd > {CHAR_LIMIT} + {CHAR_SCATTER} / sqrt(greatest(1, n_words)) OR wd > {WORD_LIMIT} + {WORD_SCATTER} / sqrt(greatest(1, n_words)))) AS kept
FROM v
"""


QUERIES = {"op3_quality": op3_quality}
ORACLE = {"op3_quality": _oracle()}
