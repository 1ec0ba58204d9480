"""The stream's files are of bounded size, however large the log."""

import datetime as dt

from touchline.plans import live as LI


def test_files_grow_with_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LI, "FILE_ROWS", 200)
    rows = [(i, dt.datetime(2024, 1, 1), i % 9, ("purchase", "view", "error")[i % 3], float(i % 100), '{"k": %d}' % (i % 90)) for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    path, files = LI._feed_files(spark, str(tmp_path))
    assert files >= 10 and LI.FILES < len(spark.read.parquet(path).inputFiles()) <= files
