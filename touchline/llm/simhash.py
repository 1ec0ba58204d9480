"""SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is two segments A and B of 32.  Fingerprints that differ
in at most two bits fall in one of three cases, and for each a table is keyed by
bits that must then be equal:

- A equal: B differs in two bits at most, so one of three parts of B is equal;
- B equal: likewise with three parts of A;
- one bit in A and one in B differ: a half of B is equal, and A is reached from a
  Hamming ball of radius one.  Of two such values one has the bit set, so it is
  enough to probe with each set bit cleared.

Each fingerprint thus has eight table rows and some 32 probes whatever the number
of documents, and a match already agrees in 42 bits or more; the whole distance
is then verified.  Documents with equal fingerprints are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import components, documents, inner
from touchline.session import cut

WORDS_IN_SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Lowest bit and width of the three parts of a segment.
PARTS = ((0, 11), (11, 11), (22, 10))


def fingerprint(text: str | None, width: int = WORDS_IN_SHINGLE) -> int:
    """The fingerprint of one text; 0 if it has no words."""
    w = (text or "").encode().lower().split()  # of bytes: A-Z only, blanks of ASCII only
    if not w:
        return 0
    line = b" ".join(w)
    ends, at = [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest, last = xxhash.xxh64_intdigest, min(width, len(w)) - 1
    ones, n = np.zeros(64, np.int64), len(w) - last
    for k in range(0, n, CHUNK):
        m = min(n, k + CHUNK)
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k:m], ends[k + last:m + last], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed longs of the same bits."""
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())


def links(prints: DataFrame) -> DataFrame:
    """Pairs `u` < `v` of the distinct values of column `fp` that differ in one or two bits.

    Nulls link to nothing.  No pair is left out, however many share a table row.
    """
    p = prints.where("fp IS NOT NULL").select("fp").distinct()
    mask = (1 << 32) - 1
    a, b = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(mask))
    key = lambda kind, seg, part: F.shiftleft(F.lit(kind).cast("long"), 56).bitwiseOR(F.shiftleft(part, 32)).bitwiseOR(seg)
    bits = lambda seg, lo, n: F.shiftrightunsigned(seg, lo).bitwiseAND(F.lit((1 << n) - 1))
    same = [key(k, x, bits(y, lo, n)) for x, y, k0 in ((a, b, 0), (b, a, 3)) for k, (lo, n) in enumerate(PARTS, k0)]
    halves = [(6, bits(b, 0, 16)), (7, bits(b, 16, 16))]
    table = p.select("fp", F.explode(F.array(*same, *[key(k, a, half) for k, half in halves])).alias("key"))
    ball = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.shiftrightunsigned("fp", 32).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    flipped = F.flatten(F.transform(ball, lambda i: F.array(*[key(k, a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), half) for k, half in halves])))
    probes = p.select("fp", F.explode(F.concat(F.array(*same), flipped)).alias("key"))
    found = probes.withColumnRenamed("fp", "x").join(table.withColumnRenamed("fp", "y"), "key")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # Of the symmetric cases each pair is met twice; one of them is enough.
    found = found.where((near > 0) & (near <= DISTANCE) & ((F.shiftrightunsigned("key", 56) >= 6) | (F.col("x") < F.col("y"))))
    return found.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def clustered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with two more columns: `_fp` and `_root`, equal for documents of one group.

    Null and wordless texts have fingerprint 0, which links like any other.
    """
    marked = cut(docs.withColumn("_fp", fingerprints(F.col(f"`{text_col}`"))), "fingerprints")
    roots = cut(components(links(marked.select(F.col("_fp").alias("fp")))).select(F.col("node").alias("_fp"), F.col("root").alias("_r")), "roots")
    return marked.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_r", "_fp")).drop("_r")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `id`, `fingerprint` (16 lowercase hex digits), `component_id`.

    component_id is the smallest id reachable over links, the document's own
    included; null ids count only if there is no other.  Repeated rows stay.  An
    empty table gives no rows.
    """
    d = clustered(inner(docs, id=id_col, text=text_col), "text").select("id", "_fp", "_root")
    least = d.groupBy("_root").agg(F.min("id").alias("component_id"))
    return d.join(least, "_root").select("id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group: that with the smallest id.

    All columns stay as they are.  Null ids come first; of rows that share id and
    fingerprint one stays.
    """
    d = clustered(docs, text_col)
    best = d.groupBy("_root").agg(F.min(F.struct(F.col(f"`{id_col}`").alias("i"), F.col("_fp").alias("f"))).alias("_best"))
    first = d.join(best, "_root").where(F.col(f"`{id_col}`").eqNullSafe(F.col("_best.i")) & (F.col("_fp") == F.col("_best.f")))
    return first.dropDuplicates(["_root"]).select(*[f"`{c}`" for c in docs.columns])


def op5_simhash(spark, sf_dir):
    """Near copies in `documents`: fingerprints that differ in two bits or fewer link."""
    return groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE: dict[str, str] = {}
