"""Suffix-array dedup: suffixes ordered through `window` bytes by a radix sort.

Only the first `window` bytes of a suffix matter, so the most-significant-digit
passes stop there: what is still in one bucket then are the repeated windows.  A
pass looks at buckets of two suffixes at least and deals them by the next digit.

Neighbouring suffixes go through the passes as one run.  The first digit holds what
REACH neighbours must share: each suffix looks at its first REACH places for the one
where the 8 bytes hash lowest.  Equal windows choose alike, and all suffixes that
choose a place p have in common the bytes that follow it, window - REACH + 1 of them.
A run is those suffixes, numbered by their distance to p; suffixes of two runs can
only be equal through `window` bytes if their digits and their distances are.  A later pass
parts a run in SPLIT shorter ones, and as these have more bytes in common their digit
is longer: the depth goes from 145 bytes over 337, 385 and 397 to 400, where a run is
one suffix.  A run that is equal to another one from its first byte to its last is
settled for all its suffixes at once; one of such a class goes on as a partner for
others.  Buckets are known by hashes of their digits, runs as a whole by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import Flags, documents, inner
from touchline.llm.passages import mixed
from touchline.session import cut, forget

WINDOW = 400
#: Neighbours of a run at most, and into how many a pass parts it; a power of SPLIT.
REACH, SPLIT = 256, 4
#: Bytes of text that a task works on at once (one text at least).
BATCH = 1 << 19
U = np.uint64

RUNS = "key long, m int, p int, lo int, hi int, core long, w0 long, w1 long"


def some(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Columns of some rows as lists, texts first, of about BATCH bytes of text together."""
    held, n = [], 0
    for b in batches:
        for k in range(0, b.num_rows, 50):
            part = b.slice(k, 50)
            for row in zip(*(part.column(c).to_pylist() for c in names), strict=True):
                if held and n + len(row[0]) > BATCH:
                    yield tuple(zip(*held, strict=True))
                    held, n = [], 0
                held.append(row)
                n += len(row[0])
    if held:
        yield tuple(zip(*held, strict=True))


def chosen(data: np.ndarray) -> np.ndarray:
    """For every place the one of the REACH from there on whose 8 bytes hash lowest, the first of several.

    The hash has 32 bits and the place the others, so that one minimum gives both.
    """
    x = data.astype(U)
    for step in (1, 2, 4):
        x = x[:-step] | x[step:] << U(8 * step)
    low = mixed(x, 1) & U(0xFFFFFFFF00000000) | np.arange(len(x), dtype=U)
    step = 1
    while step < REACH:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return (low & U(0xFFFFFFFF)).astype(np.int64)


def runs(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """All runs of texts that have a window: place, nearest and farthest suffix, hashes of the first digit and of the whole."""
    for texts, key, m in some(batches, "text", "key", "m"):
        n = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(n) - n
        buf = b"".join(texts)
        p = chosen(np.frombuffer(buf, np.uint8))
        # A place where a window begins and ends in one text.
        edge = np.zeros(len(buf) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + n - window + 1, -1)
        at = np.nonzero(np.cumsum(edge[:-1]) > 0)[0]
        q = p[at]
        new = np.nonzero(np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)])[0]
        a, b, q = at[new], at[np.r_[new[1:], len(at)] - 1], q[new]
        view = memoryview(buf)
        core = b"".join(xxhash.xxh3_64_digest(view[x:x + window - REACH + 1]) for x in q.tolist())
        whole = b"".join(xxhash.xxh3_128_digest(view[x:y + window]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
        doc = np.searchsorted(first, a, side="right") - 1
        w = np.frombuffer(whole, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict({
            "key": np.array(key, np.int64)[doc], "m": np.array(m, np.int32)[doc], "p": (q - first[doc]).astype(np.int32), "lo": (q - b).astype(np.int32), "hi": (q - a).astype(np.int32),
            "core": np.frombuffer(core, np.int64), "w0": w[:, 0], "w1": w[:, 1]})


def sliced(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text."""
    for texts, wanted in some(batches, "text", "wanted"):
        for t, rs in zip(texts, wanted, strict=True):
            for k in range(0, len(rs), 5000):
                few = rs[k:k + 5000]
                out = {c: [r[c] for r in few] for c in ("w0", "w1", "lo", "hi", "settled")}
                out["text"] = [t[r["p"] - r["hi"]:r["p"] - r["lo"] + window] for r in few]
                yield pa.RecordBatch.from_arrays([pa.array(out["w0"], pa.int64()), pa.array(out["w1"], pa.int64()), pa.array(out["lo"], pa.int32()), pa.array(out["hi"], pa.int32()),
                                                  pa.array(out["settled"], pa.bool_()), pa.array(out["text"], pa.binary())], names=list(out))


def passed(active: DataFrame, width: int, window: int) -> tuple[DataFrame, DataFrame]:
    """One pass: runs of up to SPLIT * `width` suffixes become runs of up to `width`.

    `active` has `w0`, `w1` (the run it is from), `o` (distance its numbers begin with), `lo`, `hi`
    (its suffixes), `settled`, `text`.  Returns what the pass has found to be repeated
    (`w0`, `w1`, `lo`, `hi`) and the runs of the next.
    """
    o = F.col("up") + F.col("j") * width
    kids = active.select("w0", "w1", F.col("o").alias("up"), F.col("lo").alias("l"), F.col("hi").alias("h"), "settled", "text", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))).alias("j"))
    kids = kids.select("w0", "w1", "up", o.alias("o"), F.greatest("l", o).alias("lo"), F.least("h", o + width - 1).alias("hi"), "h", "settled", "text").where("lo <= hi")
    kids = kids.withColumn("text", F.substring("text", F.col("h") - F.col("hi") + 1, F.col("hi") - F.col("lo") + window))
    digit = F.substring("text", F.col("hi") - F.col("o") + 1, F.lit(window - width + 1))
    named = kids.select("w0", "w1", "up", "o", "lo", "hi", "settled", F.xxhash64("o", digit).alias("core"), F.unhex(F.md5("text")).alias("whole"))
    named = cut(named, "suffix-runs")
    same = ["core", "o", "lo", "hi", "whole"]
    # The firsts are of one row: fixed-width buffers that are set together.
    classes = cut(named.groupBy(*same).agg(F.count(F.lit(1)).alias("k"), F.max("settled").alias("s"), F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("up").alias("up")), "suffix-classes")
    hits = cut(named.where("NOT settled").join(classes.where("k > 1").select(*same), same).select("w0", "w1", "lo", "hi"), "suffix-hits")
    if width == 1:
        forget(named, classes)
        return hits, active.limit(0)
    known = F.col("s") | (F.col("k") > 1)
    buckets = cut(classes.groupBy("core").agg(F.count(F.lit(1)).alias("d"), F.min(known).alias("all")).where("d > 1 AND NOT all").select("core"), "suffix-buckets")
    alive = classes.join(buckets, "core").select("w0", "w1", "up", F.col("o").alias("o2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), known.alias("known"))
    rest = active.withColumnRenamed("o", "up").join(alive, ["w0", "w1", "up"]).select(
        "w0", "w1", F.col("o2").alias("o"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("known").alias("settled"),
        F.substring("text", F.col("hi") - F.col("hi2") + 1, F.col("hi2") - F.col("lo2") + window).alias("text"))
    rest = cut(rest, "suffix-active")
    forget(named, classes, buckets)
    return hits, rest


def repeated(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """`key`, `m`, `spans`: for each text with repeated windows the stretches these cover, as (start, stop), maybe overlapping.

    `texts` has `key`, `m` (96 bits of hash of the text) and `text` as bytes.
    """
    long_texts = texts.where(F.octet_length("text") >= window)
    every = cut(long_texts.select("text", "key", "m").mapInArrow(lambda bs: runs(bs, window), RUNS), "suffix-first")
    cores = every.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("w0").alias("a"), F.max("w0").alias("b"), F.min("w1").alias("c"), F.max("w1").alias("d"))
    cores = cut(cores.where("k > 1").select("core", F.expr("a <> b OR c <> d").alias("mixed")), "suffix-cores")
    found = cut(every.join(cores, "core").select("key", "m", "p", "lo", "hi", "w0", "w1", "mixed"), "suffix-found")
    forget(every, cores)
    firsts = [F.first(c).alias(c) for c in ("key", "m", "p", "lo", "hi", "mixed")]
    wholes = cut(found.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("k"), *firsts), "suffix-wholes")
    hits = wholes.where("k > 1").select("w0", "w1", "lo", "hi")
    wanted = wholes.where("mixed").groupBy("key", "m").agg(F.collect_list(F.struct("w0", "w1", "p", "lo", "hi", (F.col("k") > 1).alias("settled"))).alias("wanted"))
    wanted = cut(wanted, "suffix-wanted")
    near = long_texts.where(Flags(wanted, "key").has("key")).join(wanted, ["key", "m"]).select("text", "wanted")
    schema = "w0 long, w1 long, lo int, hi int, settled boolean, text binary"
    active = near.mapInArrow(lambda bs: sliced(bs, window), schema).withColumn("o", F.lit(0))
    active = cut(active.dropDuplicates(["w0", "w1"]), "suffix-active")
    forget(wanted)
    width = REACH
    while width > 1:
        width //= SPLIT
        more, rest = passed(active, width, window)
        hits = hits.union(more)
        forget(active)
        active = rest
    marks = cut(hits.groupBy("w0", "w1").agg(F.collect_set(F.struct("lo", "hi")).alias("marks")), "suffix-marks")
    at = found.select("key", "m", "p", "w0", "w1").join(marks, ["w0", "w1"]).select("key", "m", "p", F.explode("marks").alias("k"))
    return at.groupBy("key", "m").agg(F.collect_set(F.struct((F.col("p") - F.col("k.hi")).alias("start"), (F.col("p") - F.col("k.lo") + window).alias("stop"))).alias("spans"))


def stripped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without its spans."""
    for texts, ids, spans in some(batches, "text", "id", "spans"):
        n, gone, pieces, kept = [], [], [], []
        for t, ss in zip(texts, spans, strict=True):
            left, end, k, removed = [], 0, 0, 0
            for a, b in sorted((s["start"], s["stop"]) for s in ss or ()):
                if a > end or not removed:
                    left.append(t[end:a])
                    k, removed, end = k + 1, removed + b - a, b
                elif b > end:
                    removed, end = removed + b - end, b
            left.append(t[end:])
            n.append(len(t))
            gone.append(removed)
            pieces.append(k)
            kept.append(b"".join(left))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces, pa.int64()), pa.array(kept, pa.binary())],
                                         names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Every document without the bytes that repeated windows cover.

    Returns `id` (a whole number), `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and
    `kept`, the other bytes; as a cut can fall into a character these are binary.  A byte
    goes if a window of `window` bytes over it also starts anywhere else, in the same text
    or another; windows are judged on the input and overlaps count.  `window` is REACH + 8 at least.
    A null text is empty.  Copies of a text of a window or more lose it all.  Rows that
    repeat are documents of their own; null ids stay null.  Texts may be of any length that
    Spark holds; a text with a short period has as many runs as bytes.  An empty table gives no
    rows, and other columns are not read.
    """
    if window < REACH + 8:
        raise ValueError(f"windows have {REACH + 8} bytes at least")
    d = inner(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("id", F.xxhash64("text").alias("key"), F.hash("text").alias("m"), F.col("text").cast("binary").alias("text"))
    info = cut(repeated(d.select("key", "m", "text"), window), "suffix-spans")
    hit = Flags(info, "key").has("key")
    clean = d.where(~hit).select("text", "id", F.lit(None).cast(info.schema["spans"].dataType).alias("spans"))
    hit = d.where(hit).join(info, ["key", "m"], "left").select("text", "id", "spans")
    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    return clean.mapInArrow(stripped, schema).union(hit.mapInArrow(stripped, schema))


def op11_suffixes(spark, sf_dir):
    """`documents` without repeated strings of 400 bytes or more."""
    return dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffixes": op11_suffixes}
ORACLE = {"op11_suffixes": f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
places AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - {WINDOW} + 2)) AS i FROM d WHERE octet_length(b) >= {WINDOW}),
suffixes AS (SELECT doc_id, i, md5(b[i:i + {WINDOW - 1}]) AS s FROM places),
twice AS (SELECT s FROM suffixes GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM suffixes JOIN twice USING (s)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN step <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS z FROM numbered GROUP BY doc_id, k),
-- what stands before each span, and after the last
gaps AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS f, a AS t FROM spans
  UNION ALL SELECT doc_id, max(z), max(z), 2147483647 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[f:t - 1]), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
totals AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN totals USING (doc_id) LEFT JOIN kept USING (doc_id)
"""}
