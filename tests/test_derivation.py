"""Deriving tables: every core takes part, however few tasks read the file."""

import datetime as dt

from touchline.plans import fixture as FX


def test_one_small_file_is_derived_by_every_core(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1), i % 9, ("purchase", "view", "error")[i % 3], float(i % 100), '{"k": %d}' % (i % 90)) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    df = FX.table(spark, str(tmp_path), "match_events")
    assert len(df.inputFiles()) == spark.sparkContext.defaultParallelism > 1
    assert df.count() == 2000 and df.filter("match_id = 3").count() == 500
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit
