"""A file of one row group is worked on by all cores, in however many pieces it is dealt; folding ASCII needs no Python."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.session import spread


def test_one_row_group_is_spread(spark, tmp_path):
    pq.write_table(pa.table({"k": list(range(4000))}), f"{tmp_path}/t.parquet", row_group_size=4000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = spark.read.parquet(f"{tmp_path}/t.parquet")
        assert df.rdd.getNumPartitions() >= 4
        rows = lambda x: [r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect()]
        assert rows(df) == [4000]
        out = rows(spread(df, "k"))
        assert len(out) == 4 and sum(out) == 4000 and max(out) < 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_folded_is_fold(spark):
    rows = [("Ärger Ñandú",), ("PLAIN Text 12_#",), (None,), ("",), ("ﬁn İstanbul é",)]
    got = spark.createDataFrame(rows, "t string").select(T.fold("t").alias("a"), T.folded(F.col("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got)
