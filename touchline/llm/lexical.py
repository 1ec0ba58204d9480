"""Ranked lexical search by presence masks.

The queries' terms are a small vocabulary.  One pass over the texts keeps, per
document, its length and the counts of these terms; all statistics come from that
table.  A second pass works on blocks of it.  A block has one row of saturated
counts per term; of these a query takes its terms' rows, and the bitmap of what is
present in them gives each document its mask of matched terms.  Documents of one
mask are a group.  No document of a group can score above the mask's bound, the
sum over its terms of weight times the largest saturation in the block; so groups
are scored by descending bound, and the rest is left as soon as the bound is below
the lowest score that still counts.  Bounds and scores are integers: nothing is
left that could enter the ranking, ties included.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.llm.common import inner
from touchline.session import cut

BEST = 50
#: Bytes of query texts that are searched in one pass over the documents; more take several passes.
QUERY_BYTES = 1 << 20
#: Cells (terms x documents) of a block, and documents scored between two looks at the bound.
CELLS, STEP = 1 << 23, 256
#: A-Z to lower case; letters, digits and all bytes beyond ASCII as they are; the rest parts terms.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

COUNTED = "id long, n long, at array<int>, tf array<int>"
FOUND = "item int, id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, repeats included."""
    return (text or "").encode().translate(TABLE).split()


def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """`id`, `n` (terms in all), and which terms of the vocabulary are there how often.

    `docs` has `id`, `text`.
    """
    number = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.value.get
        for b in batches:
            n, at, tf = [], [], []
            for text in b.column("text"):
                ts = terms(text.as_py())
                c = Counter(map(get, ts))
                c.pop(None, None)
                n.append(len(ts))
                at.append(list(c))
                tf.append(list(c.values()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], names=["id", "n", "at", "tf"])

    return docs.mapInArrow(count, COUNTED)


class Best:
    """The best `k` (score, id) so far, by descending score, then ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a document must reach to count; one equal to it may, by its id."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        s, i = s[s > 0], i[s > 0]
        order = np.lexsort((i, -s))[:self.k]
        self.scores, self.ids = s[order], i[order]


def masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which documents (columns) share a mask: one document of each mask, and each document's mask number."""
    bits = np.packbits(present, axis=0)  # eight terms a row
    wide = np.zeros((present.shape[1], -(-bits.shape[0] // 8) * 8), np.uint8)
    wide[:, :bits.shape[0]] = bits.T
    keys = wide.view(np.uint64)
    if keys.shape[1] == 1:
        _, one, mask = np.unique(keys[:, 0], return_index=True, return_inverse=True)
    else:
        _, one, mask = np.unique(wide.view(f"V{wide.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return one, mask


def searched(saturated: np.ndarray, ids: np.ndarray, at: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """One query over a block: `saturated` has a row per term, a column per document."""
    rows = saturated[at]
    some = rows.any(axis=0)
    if not some.any():
        return
    rows, ids = rows[:, some], ids[some]
    present = rows > 0
    one, mask = masks(present)
    bound = (weight * rows.max(axis=1)) @ present[:, one]
    by_mask = np.argsort(mask, kind="stable")
    start = np.searchsorted(mask[by_mask], np.arange(len(one) + 1))
    held, n = [], 0
    for k in np.argsort(-bound, kind="stable").tolist():
        if bound[k] < best.least():
            break
        held.append(by_mask[start[k]:start[k + 1]])
        n += len(held[-1])
        if n >= STEP:
            docs = np.concatenate(held)
            best.add(weight @ rows[:, docs], ids[docs])
            held, n = [], 0
    if held:
        docs = np.concatenate(held)
        best.add(weight @ rows[:, docs], ids[docs])


def blocks(batches: Iterator[pa.RecordBatch], width: int, documents: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and saturated counts (terms x documents) of some documents at a time; those without any of the terms left out."""
    size = max(16, CELLS // max(1, width))
    for b in batches:
        for k in range(0, b.num_rows, size):
            part = b.slice(k, size)
            at, tf = part.column("at"), part.column("tf")
            per = np.diff(at.offsets.to_numpy())
            m = np.array([50 + 50 * n * documents // length for n in part.column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(part.num_rows), per)
            f = tf.flatten().to_numpy().astype(np.int64)
            out = np.zeros((width, part.num_rows), np.int64)
            out[at.flatten().to_numpy(), doc] = 1_000_000_000 * f // (1000 * f + 20 * m[doc])
            yield part.column("id").to_numpy(zero_copy_only=False), out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = BEST) -> DataFrame:
    """The `k` highest-scoring documents of each item.

    Returns `item_id`, `rank` (from 1), `doc_id`, `score`, for scores above 0, equal
    scores by ascending id.  Ids of documents are whole numbers; rows without one
    can't be named and are counted in the statistics only.  Rows that repeat are
    documents of their own.  A null text has no terms.  Rows of `items` with one id
    are one query, their texts taken together; an item without terms or matches has
    no rows, and neither has an empty table.  A text may be of any length.  Other
    columns of either table are not read.

    Queries are collected to the driver block by block, a block being about
    QUERY_BYTES of their texts; each block is one pass over the documents.
    """
    d = inner(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    q = inner(items, item=item_col, text=query_col)
    size = q.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // QUERY_BYTES
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    kind = items.select(F.col(f"`{item_col}`")).schema[0].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("item", T.IntegerType())])
    out = None
    for b in range(n_blocks):
        texts: dict = {}
        for r in q.where(block == b).collect():  # about QUERY_BYTES
            texts.setdefault(r["item"], set()).update(terms(r["text"]))
        found = _block(d, [sorted(ts) for ts in texts.values()], k)
        names = docs.sparkSession.createDataFrame([(i, k) for k, i in enumerate(texts)], schema)
        found = found.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        out = found if out is None else out.union(found)
    return out


def _block(d: DataFrame, queries: list[list[bytes]], k: int) -> DataFrame:
    vocabulary = sorted({t for ts in queries for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = cut(counted(d, vocabulary), "counted-terms")
    documents, length = rows.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["t"]: r["df"] for r in rows.select(F.explode("at").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()}  # of the vocabulary
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
    at = [np.array([number[t] for t in ts if df.get(number[t])], np.int64) for ts in queries]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Best(k) for _ in at]
        for ids, saturated in blocks(batches, len(weight), documents, max(1, length)):
            for top, a in zip(tops, at, strict=True):
                if len(a):
                    searched(saturated, ids, a, weight[a], top)
        for item, top in enumerate(tops):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top.ids), item, np.int32)), pa.array(top.ids), pa.array(top.scores)], names=["item", "id", "score"])

    found = rows.where("id IS NOT NULL AND size(at) > 0").mapInArrow(best, FOUND)
    w = W.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def op13_search(spark, sf_dir):
    """The 50 best documents for each item of `benchmark`."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op13_search": op13_search}
ORACLE = {"op13_search": rf"""
WITH low AS (SELECT doc_id AS id, 0 AS kind, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, 1, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT id, kind, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tf AS (SELECT id, kind, term, count(*) AS tf FROM split GROUP BY ALL),
size AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf WHERE kind = 0 GROUP BY id),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
df AS (SELECT term, count(*) AS df FROM tf WHERE kind = 0 GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
scored AS (SELECT q.id AS item_id, d.id AS doc_id, CAST(sum(w * ((1000000000 * d.tf) // (1000 * d.tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM tf q JOIN tf d ON q.kind = 1 AND d.kind = 0 AND d.term = q.term JOIN weight g ON g.term = d.term JOIN size ON size.id = d.id, total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {BEST}
"""}
