"""Exact dedup by naming blocks.

A text is cut into blocks of a fixed number of bytes.  The distinct blocks are
sorted and numbered; each number names its block.  Then adjacent names are
paired, the distinct pairs are sorted and numbered in turn, and so on until one
name is left per text.  Two texts of the same number of blocks have the same
name exactly if they are equal: names are given by position in a sorted list of
distinct values, never by a hash.

Hashes only route: a block is looked up by its hash, and where two different
blocks share one, by its bytes too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import documents, inner
from touchline.session import cut

BLOCK_BYTES = 4096


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    raw, n = F.col("text").cast("binary"), F.octet_length("text")
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / F.lit(size))).cast("int"))
    return (rows.withColumn("n_blocks", F.size(at))
            .select("*", F.posexplode(at).alias("pos", "_i"))
            .withColumn("block", F.substring(raw, F.col("_i") * size + 1, F.lit(size)))
            .withColumn("h", F.xxhash64("block")).drop("text", "_i"))


def _numbered(values: DataFrame, *order: str) -> DataFrame:
    """Distinct values, each with an integer of its own, in sorted order within a partition."""
    return values.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def named(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row with the identity of its text.

    Returns `row` (a number of the row), `id`, `text_sha256`, `n_blocks`, `name`;
    (n_blocks, name) are equal for two rows exactly if their texts are.  A null
    text counts as empty; the empty text is one empty block.  Rows that repeat
    are rows of their own.  An empty table gives no rows.
    """
    texts = inner(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    blocks = _blocks(texts.select("text"), block_bytes).groupBy("h", "block").agg(F.lit(1).alias("_one")).drop("_one")
    names = cut(_numbered(blocks, "h", "block"), "block-names")
    clashes = cut(names.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "block-clashes")
    # A block is told by its hash alone unless another block has the same one.
    plain = names.join(clashes, "h", "left_anti").select("h", "name")
    rows = _blocks(texts.withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.sha2("text", 256)), block_bytes)
    keep = ["row", "id", "sha", "n_blocks", "pos", "h"]
    if clashes.isEmpty():
        level = cut(rows.select(*keep).join(plain, "h").drop("h"), "names")
    else:
        full = names.join(clashes, "h", "left_semi").select("h", "block", F.col("name").alias("full"))
        rows = cut(rows.join(clashes.withColumn("c", F.lit(True)), "h", "left").withColumn("block", F.expr("CASE WHEN c THEN block END")).drop("c"), "blocks")
        level = cut(rows.join(plain, "h", "left").join(full, ["h", "block"], "left").withColumn("name", F.coalesce("full", "name"))
                    .select("row", "id", "sha", "n_blocks", "pos", "name"), "names")
    done = level.where("n_blocks = 1").select("row", "n_blocks", "name")
    todo = level.where("n_blocks > 1").select("row", "n_blocks", "pos", "name")
    most, span = level.agg(F.max("n_blocks")).first()[0] or 1, 1
    while span < most:
        # The pair at 2k, 2k + 1; the last one of an odd number stands with -1, which no block is named.
        pick = lambda odd: F.coalesce(F.max(F.when(F.col("pos") % 2 == odd, F.col("name"))), F.lit(-1))
        pairs = todo.withColumn("half", F.floor(F.col("pos") / 2)).groupBy("row", "n_blocks", "half").agg(pick(0).alias("a"), pick(1).alias("b"))
        table = cut(_numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
        step = cut(pairs.join(table, ["a", "b"]).select("row", "n_blocks", F.col("half").alias("pos"), "name"), "names")
        span *= 2  # blocks that a name now stands for
        done = done.union(step.where(F.col("n_blocks") <= span).select("row", "n_blocks", "name"))
        todo = step.where(F.col("n_blocks") > span)
    first = level.where("pos = 0").select("row", "id", F.col("sha").alias("text_sha256"))
    return first.join(done, "row")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: which document of its equal texts stays.

    Returns `id`, `keep_id`, `group_size`, `kept`, `text_sha256`, `n_blocks`,
    `name`.  Of equal texts the row with the largest id stays (a null id only if
    there is no other); of several rows with that id, one.
    """
    rows = cut(named(docs, id_col, text_col, block_bytes), "identities")
    same = ["n_blocks", "name"]
    groups = cut(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("top")), "groups")  # a join of its own splits a large group
    return rows.join(groups, same).select(
        "id", F.col("top.id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256", "n_blocks", "name")


def op6_exact_dedup(spark, sf_dir):
    """Exact copies in `documents`; the row with the largest doc_id stays."""
    return dedup(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLE = {"op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""}
