"""Substring dedup with difference-cover anchors.

A window is a run of `window` words.  Let D be a difference cover modulo v: for
any two positions i, j some shift below v takes both into D.  If the windows at i
and j are equal, then so are the shorter ones that start at i + shift and
j + shift, and both of these are anchors, that is start at a position in D modulo
v.  So hashing the anchors alone meets every pair of equal windows.  From an
anchor that occurs twice the match is extended: all windows around it are
candidates, and these are compared as a whole by 128-bit fingerprints.

Whatever a task itself finds to be repeated leaves it once (to inform the
others), however often it occurs; so a passage that many documents share makes
no large group.  Documents with the same text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from touchline.llm.common import documents, inner
from touchline.session import cut

WINDOW = 35
#: A perfect difference set: every difference modulo 21 occurs.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Characters of text that a task holds as words at once (one text at least), and words whose hash it remembers.
CHARS, MEMORY = 1_500_000, 100_000
#: Bits of the filter of keys, at most.
FILTER_BITS = 1 << 23
U = np.uint64


class Hashes(dict):
    """XXH64 of words; bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


known = Hashes()


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Scatter 64-bit values (the finish of splitmix64)."""
    x = x + U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolled(x: np.ndarray, length: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of all runs of `length` values."""
    back = pow(base, -1, 1 << 64)
    up, down = np.ones(len(x), U), np.ones(len(x), U)
    np.multiply.accumulate(np.r_[U(1), np.full(len(x) - 1, base, U)], out=up)
    np.multiply.accumulate(np.r_[U(1), np.full(len(x) - 1, back, U)], out=down)
    sums = np.r_[U(0), np.add.accumulate(x * down)]
    return (sums[length:] - sums[:-length]) * up[:len(x) - length + 1]


class Batch:
    """The words of some texts one after the other, as hashes."""

    def __init__(self, texts: list[str]):
        words = [t.encode().split() for t in texts]
        self.n = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.x = np.fromiter((known[w] for ws in words for w in ws), U, int(self.n.sum()))
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.pos = np.arange(len(self.x)) - self.first[self.doc]

    def runs(self, length: int, at: np.ndarray, base: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Places among `at` (a mask over the words) where a run fits into its text, and the hashes of these."""
        fits = at & (self.pos + length <= self.n[self.doc])
        places = np.nonzero(fits)[0]
        return places, rolled(mixed(self.x, salt), length, base)[places] if len(places) else self.x[:0]


def sent(h: list[np.ndarray], key: np.ndarray, check: np.ndarray, pos: np.ndarray) -> pa.RecordBatch | None:
    """Rows for the shuffle: hashes, whose run it is, and a flag.

    0: met once here.  1: met at two places here, one row for all.  2: such a place;
    it goes under a hash of its own, for it needs no company.
    """
    if not len(pos):
        return None
    order = np.lexsort((pos, check, key, *h))
    h, key, check, pos = [x[order] for x in h], key[order], check[order], pos[order]
    other_h = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in h])]
    other = other_h | np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]) | (pos[1:] != pos[:-1])]
    h, key, check, pos, other_h = [x[other] for x in h], key[other], check[other], pos[other], other_h[other]
    group = np.cumsum(other_h) - 1
    many = np.bincount(group)[group] > 1
    flag = np.where(many, np.where(other_h, 1, 2), 0).astype(np.int8)
    own = mixed(key.view(U) ^ mixed(pos.astype(U), 7), 11)
    h = [np.where(flag == 2, own, x) for x in h]
    cols = {f"h{i}": x.view(np.int64) for i, x in enumerate(h)} | {"key": key, "m": check, "p": pos.astype(np.int32), "flag": flag}
    return pa.RecordBatch.from_pydict(cols)


def texts_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Columns of some rows as lists, texts first, of bounded size together."""
    held, n = [], 0
    for b in batches:
        for k in range(0, b.num_rows, 100):
            part = b.slice(k, 100)
            for row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if held and n + len(row[0]) > CHARS:
                    yield tuple(zip(*held, strict=True))
                    held, n = [], 0
                held.append(row)
                n += len(row[0])
    if held:
        yield tuple(zip(*held, strict=True))


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all anchors of texts that have a window."""
    for texts, key, m in texts_of(batches, "text", "key", "m"):
        b, key, m = Batch(texts), np.array(key, np.int64), np.array(m, np.int32)
        at = np.isin(b.pos % PERIOD, COVER) & (b.n[b.doc] >= WINDOW)
        places, h = b.runs(WINDOW - PERIOD + 1, at, 0x9E3779B97F4A7C15, 1)
        if (out := sent([h], key[b.doc[places]], m[b.doc[places]], b.pos[places])) is not None:
            yield out


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of the windows around repeated anchors."""
    for texts, key, m, hits in texts_of(batches, "text", "key", "m", "hits"):
        b, key, m = Batch(texts), np.array(key, np.int64), np.array(m, np.int32)
        edge = np.zeros(len(b.x) + 1, np.int64)
        for first, hs in zip(b.first.tolist(), hits, strict=True):
            a = np.array(hs, np.int64)
            np.add.at(edge, first + np.maximum(a - PERIOD + 1, 0), 1)
            np.add.at(edge, first + a + 1, -1)
        at = np.cumsum(edge[:-1]) > 0
        places, h = b.runs(WINDOW, at, 0x9E3779B97F4A7C15, 1)
        _, g = b.runs(WINDOW, at, 0xC2B2AE3D27D4EB4F, 2)
        if (out := sent([h, g], key[b.doc[places]], m[b.doc[places]], b.pos[places])) is not None:
            yield out


ROWS = "key long, m int, p int, flag tinyint"


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    """`key`, `m`, `places` of what occurs at two places at least."""
    w = W.partitionBy(*by)
    two = F.max("flag").over(w) > 0
    for c in ("key", "m", "p"):
        two = two | (F.min(c).over(w) != F.max(c).over(w))
    return rows.withColumn("two", two).where("two").groupBy("key", "m").agg(F.collect_set("p").alias("places"))


class Filter:
    """A Bloom filter of document keys with a fixed bound: fuller, it lets more through, which only costs time."""

    def __init__(self, spark: SparkSession, keys: DataFrame):
        bits = 1 << 10
        while bits < min(FILTER_BITS, 12 * keys.count()):
            bits *= 2
        at = lambda i: F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(bits))
        rows = keys.select(F.explode(F.array(at(1), at(2))).alias("b")).distinct().groupBy(F.shiftright("b", 5).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(31)).cast("int"))).alias("v")).collect()
        words = np.zeros(bits // 32, np.uint32)
        for r in rows:  # FILTER_BITS / 32 at most
            words[r["w"]] = r["v"]
        self.words, self.columns = spark.sparkContext.broadcast(words), [at(1).alias("_b1"), at(2).alias("_b2")]


def passes(words: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
    out = np.ones(b.num_rows, bool)
    for c in ("_b1", "_b2"):
        x = b.column(c).to_numpy(zero_copy_only=False)
        out &= (words[x >> 5] >> (x & 31).astype(np.uint32) & 1).astype(bool)
    return out


def filtered(docs: DataFrame, f: Filter, want: bool, once: bool = False) -> DataFrame:
    """The rows of `docs` whose key may be (`want`) or surely isn't in the filter; `once`: each key once per task."""
    words, names = f.words, docs.columns

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep = passes(words.value, b) == want
            if once:
                if len(seen) > MEMORY:
                    seen.clear()
                for i in np.nonzero(keep)[0].tolist():
                    k = b.column("key")[i].as_py()
                    keep[i] = k not in seen
                    seen.add(k)
            yield b.select(names).filter(pa.array(keep))

    return docs.select("*", *f.columns).mapInArrow(some, docs.schema)


def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`id`, number of words, of removed words, and the kept words; `places` has the repeated windows."""
    for texts, ids, whole, places in texts_of(batches, "text", "id", "whole", "places"):
        n, gone, kept = [], [], []
        for t, w, ps in zip(texts, whole, places, strict=True):
            words = t.encode().split()
            n.append(len(words))
            if w and len(words) >= WINDOW:
                words = []
            elif ps:
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.array(ps, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + WINDOW, -1)
                words = [words[i] for i in np.nonzero(np.cumsum(edge[:-1]) == 0)[0].tolist()]
            gone.append(n[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words that repeated windows cover.

    Returns `id`, `n_words`, `n_removed`, `kept` (the other words, joined by a
    space).  A word goes if a window over it has a sequence of words that starts
    anywhere else, in the same text or another; windows are judged on the input.  Null texts
    have no words.  Copies of a text of `WINDOW` words or more lose them all.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    d = inner(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # A text is known by 96 bits of hash; rows of equal texts make the same rows everywhere.
    d = d.select("id", F.xxhash64("text").alias("key"), F.hash("text").alias("m"), "text")
    hits = cut(repeated(d.select("key", "m", "text").mapInArrow(anchors, "h0 long, " + ROWS), "h0"), "anchors")
    near = filtered(d.select("key", "m", "text"), Filter(spark, hits), want=True, once=True)
    near = near.join(hits.withColumnRenamed("places", "hits"), ["key", "m"])
    found = cut(repeated(near.select("text", "key", "m", "hits").mapInArrow(windows, "h0 long, h1 long, " + ROWS), "h0", "h1"), "windows")
    copies = d.groupBy("key", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "m", F.lit(True).alias("whole"))
    info = cut(found.join(copies, ["key", "m"], "full"), "repeats")
    f = Filter(spark, info)
    schema = "id long, n_words long, n_removed long, kept string"
    none: list[Column] = [F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("array<int>").alias("places")]
    clean = filtered(d, f, want=False).select("text", "id", *none)
    hit = filtered(d, f, want=True).join(info, ["key", "m"], "left").select("text", "id", "whole", "places")
    return clean.mapInArrow(stripped, schema).union(hit.mapInArrow(stripped, schema))


def op10_passages(spark, sf_dir):
    """`documents` without repeated passages of 35 words or more."""
    return dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_passages": op10_passages}
ORACLE = {"op10_passages": rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
ranks AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM w),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW} - 1], ' ') AS s FROM ranks),
twice AS (SELECT s FROM runs GROUP BY s HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS js FROM runs JOIN twice USING (s), range(0, {WINDOW}) AS r(k) GROUP BY doc_id),
kept AS (SELECT doc_id, ws, list_filter(ws, lambda x, j: js IS NULL OR NOT list_contains(js, j)) AS ks FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(ks) AS BIGINT) AS n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""}
