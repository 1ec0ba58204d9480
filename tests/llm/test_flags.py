"""The filter on keys is put together from Arrow columns, not from a row object for every word of it."""

from pyspark.sql import functions as F

from touchline.llm.common import Flags


def test_filter_has_all_keys_and_few_others(spark, monkeypatch):
    keys = spark.range(0, 9000, 3, numPartitions=4).withColumnRenamed("id", "lk")

    def collect(self):
        raise AssertionError("rows are collected")

    with monkeypatch.context() as m:
        m.setattr(type(keys), "collect", collect)
        flags = Flags(keys, "lk")
    assert flags.slots == 1 << 15
    hit = spark.range(9000).withColumn("h", flags.has("id")).groupBy((F.col("id") % 3 == 0).alias("own")).agg(F.count_if("h").alias("n")).collect()
    got = {x["own"]: x["n"] for x in hit}
    assert got[True] == 3000 and got[False] < 1200
