"""Helpers shared by the operators: words, ids of rows, components of a graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from touchline.session import cut

#: What stands between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def inner(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names.

    `columns` maps the inner name to the name in `docs`, so that other columns
    of the caller can have any name.
    """
    return docs.select(*[F.col(f"`{name}`").alias(own) for own, name in columns.items()])


def let(value: Column, use) -> Column:
    """`use(value)`, with `value` worked out once per row."""
    return F.transform(F.array(value), use)[0]


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows from 0 in the given order, without a task that sees them all.

    The rows are dealt by range and numbered within their partition; what comes
    before a partition is a sum over one count per partition.  The order must be
    total for the numbers to be the same on every run.
    """
    low = (1 << 33) - 1
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    parts = parts.withColumn("_p", F.shiftright("_m", 33))
    before = running_before(parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")), "_p", "_n", "_before")
    return parts.join(before, "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit(low))).drop("_p", "_m", "_before")


def running_before(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """The running sum before each key; for tables with one row per partition."""
    w = W.partitionBy(F.lit(0)).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(n).over(w), F.lit(0)).alias(name))


class Flags:
    """A filter on keys for the rows that a join may need; it lets too many through, never too few.

    One byte a slot, eight slots a key and MOST_SLOTS at most: with more keys than these it lets more
    through, which costs time and not rows.
    """

    MOST_SLOTS = 1 << 23

    def __init__(self, keys: DataFrame, *by: str):
        spark, n = keys.sparkSession, keys.count()
        self.slots = 1 << 10
        while self.slots < min(self.MOST_SLOTS, 8 * n):
            self.slots *= 2
        words = keys.select(self._at(*by).alias("b")).groupBy(F.shiftright("b", 5).cast("int").alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(32)).cast("int"))).alias("v")).toArrow()
        bits = words["v"].to_numpy().astype("<u4").view(np.uint8).reshape(-1, 4)  # MOST_SLOTS / 32 at most
        flags = np.zeros((self.slots // 32, 32), np.uint8)
        flags[words["w"].to_numpy()] = np.unpackbits(bits, axis=1, bitorder="little")
        self.table = cut(spark.createDataFrame(pa.table({"flags": pa.array([flags.tobytes()], pa.binary())})).coalesce(1), "flags")

    def _at(self, *by) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(self.slots))

    def has(self, *by) -> Column:
        return F.substring(self.table.scalar(), self._at(*by).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: distributed union-find.

    `edges` has two columns `u`, `v` of one ordered type.  Returns `node`, `root`
    for every node of an edge; the root is the smallest node of the component.
    Edges with a null end or two equal ends join nothing.

    Each round hangs every node's larger neighbours under its smallest one, then
    every node and its smaller neighbours likewise, which halves the depth of the
    trees; it ends when a round changes nothing.  Both steps are an aggregate and
    a join, so a node with very many neighbours is split like any skewed key.
    Every round is written out: the lineage stays short.
    """
    tidy = lambda df: df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, seen = cut(tidy(edges), "edges"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        seen = tuple(state)
        both = e.select("u", "v").union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        far = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = far.groupBy("u").agg(F.min("v").alias("m"))
        near = far.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m"))
        e = cut(near.distinct(), "edges")
