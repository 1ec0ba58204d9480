"""Mixing sources to target weights by hash thresholds.

Every document has a hash.  A source takes all documents a whole number of times
and, once more, those whose hash lies under a threshold.  The threshold comes
from histograms: tokens are summed by source and leading bits of the hash, the
running sum finds the bucket in which the budget ends, and only that bucket is
summed again by the next bits.  Nothing is sorted; each level moves one row per
source and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.llm.common import documents, inner, ranked, words
from touchline.session import cut

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken at most so many times.
MOST = 3
#: Bits of the hash, and those that one histogram splits by.
BITS, STEP = 63, 9


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`id`, `source`, `size` (words of the text, 0 for null) and the document's hash `h`."""
    d = inner(docs, id=id_col, text=text_col, source=source_col)
    return d.select("id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"),
                    F.shiftrightunsigned(F.xxhash64("id", "text", "source"), 1).alias("h"))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """`source`, `source_size`, `target` for each source.

    Sources in the order of their names by code point, null last, weigh as
    `weights` says, repeating.  They share the sum of all sizes by weight; no
    target exceeds `most` times its source's size, and what is over goes to the
    others by weight until none is above.  The common level is found from sums
    over the table of sources, so the number of sources isn't bounded.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = ranked(by, F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = cut(by.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        n, spent, open_weight = by.agg(F.count_if(over), F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == full or not open_weight:
            break
        level, full = (total - spent) / open_weight, n
    return by.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")).alias("target"))


def thresholds(sized: DataFrame, aims: DataFrame, bits: int = BITS, step: int = STEP) -> DataFrame:
    """`source`, `times`, `below`: all documents are taken `times` times, those with `h` < `below` once more.

    What a source takes differs from its target by half the size of one document
    at most (documents with equal hashes, that is repeated rows, count as one).
    """
    plan = aims.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = cut(plan.select("source", "times", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget")), "budgets")
    # rest: what the budget still has in the bucket `prefix`; None of them is left when every source is settled.
    open_, at = plan.where("budget > 0").select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest")), 0
    settled = None
    while at < bits:
        width = min(step, bits - at)
        at += width
        part = sized.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", bits - at + width) == F.col("prefix")))
        sums = part.groupBy("s", "rest", F.shiftright("h", bits - at).alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = W.partitionBy("s").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
        edge = cut(sums.where("before <= rest AND rest < upto").select("s", F.col("bucket").alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "n", "lo", "hi"), "edge")
        single = edge.where("lo = hi").select("s", F.expr("CASE WHEN 2 * rest > n THEN hi + 1 ELSE lo END").alias("below"))
        settled = single if settled is None else settled.union(single)
        open_ = edge.where("lo < hi").select("s", "prefix", "rest")
        if open_.isEmpty():
            break
    # A source whose budget no bucket exceeds takes every document once more; without budget, none.
    return plan.join(settled, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "times", F.coalesce("below", F.when(F.col("budget") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(0))).alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document with how often the mix takes it.

    Returns `id`, `source`, `size`, `source_size`, `target`, `copies`, `taken`
    (= size x copies).  Null texts have size 0; null is a source of its own, the
    last; a source without words takes nothing.  The draw depends on id, text
    and source alone, so reruns agree and repeated rows share their lot.  An empty
    table gives no rows.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col), "sized")
    aims = cut(targets(sized, weights, most), "targets")
    cuts = thresholds(sized, aims)
    per = aims.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s")
    copies = (F.col("times") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")
    return (sized.join(per, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
            .select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "h"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of `docs` as the mix takes them: each 0 to `most` times, all columns as they are."""
    plan = mix(docs, id_col, text_col, source_col, weights, most)
    lot = plan.groupBy("source", "h").agg(F.max("copies").alias("_copies")).withColumnsRenamed({"source": "_s", "h": "_h"}).where("_copies > 0")
    h = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, text_col, source_col)]), 1)
    rows = docs.withColumn("_k", h).join(lot, (F.col("_k") == F.col("_h")) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("_s")))
    return rows.select(*[f"`{c}`" for c in docs.columns], F.explode(F.sequence(F.lit(1), "_copies")).alias("_i")).drop("_i")


def op9_mix_sources(spark, sf_dir):
    """All documents mixed to the weights 5, 2, 1 of their sources."""
    return mix(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLE: dict[str, str] = {}
