"""Registered queries: streams.  Each runs its stream over files until they are
used up and returns what the sink then holds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from touchline.plans import corrections as C
from touchline.plans import feed as FE
from touchline.plans import narrative as N
from touchline.plans.fixture import once, table, with_views
from touchline.session import scratch
from touchline.streaming import live as LV
from touchline.streaming import social as SO


FILES, FILE_ROWS = 4, 250_000


def _feed_files(spark, d, extra=None):
    """Records in scrambled order, a third of them delivered twice; (path, number of files), four or more: a file is of bounded size."""
    e, k = table(spark, d, "match_events").drop("match_day"), table(spark, d, "corrections")
    recs = LV.encoded(e, k)
    again = recs.filter(F.pmod(F.xxhash64("body"), F.lit(3)) == 0)
    path = scratch(spark, "records")
    files = max(FILES, -(-(e.count() + k.count()) // FILE_ROWS))
    recs.unionByName(again).repartition(files, F.xxhash64("body") % 1000, F.rand(7)).write.parquet(path)
    return path, files


def _live(spark, d):
    e, k, m = table(spark, d, "match_events").drop("match_day"), table(spark, d, "corrections"), table(spark, d, "matches")
    return LV.LiveLog(spark, scratch(spark, "live"), e.schema, k.schema, m)


def _run(spark, d):
    """The whole log through the stream, once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _logs:
        log = _live(spark, d)
        path, files = _feed_files(spark, d)
        q = log.start(LV.read_stream(spark, path, files_per_batch=-(-files // 2)), scratch(spark, "ckpt"))
        q.awaitTermination()
        _logs[key] = log
    return _logs[key]


_logs: dict[tuple[str, str], LV.LiveLog] = {}


def stream_reset(spark, d):
    """A reset drops what came before; later records of the match count again."""
    log = _live(spark, d)
    e, k = table(spark, d, "match_events").drop("match_day"), table(spark, d, "corrections")
    log.append(LV.encoded(e, k), 0)
    log.append(LV.resets(e.filter("match_id % 5 = 0").select("match_id").distinct()), 1)
    log.append(LV.encoded(e.filter("match_id = 5"), k.filter("match_id = 5")), 2)
    return log.visible("event").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


def stream_reset_in_batch(spark, d):
    """The same through a stream, with resets and records from both sides of them in one batch.

    Match 5 is sent again after its reset, match 10 before it.
    """
    log = _live(spark, d)
    e, k = table(spark, d, "match_events").drop("match_day"), table(spark, d, "corrections")
    recs = LV.encoded(e, k)
    far = F.lit(1_000_000).cast("long")
    gone = LV.resets(e.filter("match_id % 5 = 0").select("match_id").distinct()).withColumn("seq", far)
    again = recs.filter("match_id IN (5, 10)").withColumn("seq", F.when(F.col("match_id") == 5, far + 1).otherwise(far - 1))
    path = scratch(spark, "records")
    # Older files first: all of the first write are one micro-batch, the one file of the second is the next.
    recs.withColumn("seq", F.lit(1).cast("long")).write.parquet(path)
    first = len(spark.read.parquet(path).inputFiles())
    gone.unionByName(again).repartition(1).write.mode("append").parquet(path)
    log.start(LV.read_stream(spark, path, files_per_batch=first), scratch(spark, "ckpt")).awaitTermination()
    return log.visible("event").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


def stream_append(spark, d):
    log = _run(spark, d)
    e, k = log.visible("event"), log.visible("correction")
    n = lambda df, name: df.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind_of_record", F.lit(name))
    return n(e, "event").unionByName(n(k, "correction"))


def stream_resume(spark, d):
    """A follower that saw the first batch reads on from there."""
    c = _run(spark, d).changes()
    last = c.filter("batch_id = 0").agg(F.max(F.struct("batch_id", "match_id", "n"))).first()[0]
    return _run(spark, d).changes(since=tuple(last)).groupBy("type").agg(F.count(F.lit(1)).alias("messages"))


def score_feed(spark, d):
    """What does not depend on how the log was cut into batches: the last score told, and how often one was told twice in a row."""
    w = W.partitionBy("match_id").orderBy("batch_id")
    told = _run(spark, d).score_changes().withColumn("s", F.struct("home_score", "away_score"))
    told = told.withColumn("again", F.coalesce((F.lag("s").over(w) == F.col("s")).cast("long"), F.lit(0)))
    last = told.groupBy("match_id").agg(F.max_by("s", "batch_id").alias("s"), F.sum("again").alias("repeats"))
    return last.select("match_id", "s.home_score", "s.away_score", "repeats")


def stream_reports(spark, d):
    """What does not depend on the batches: the lede of each match's report last told, and how often a report was told without a change of it or of the log."""
    log = _run(spark, d)
    told = log.changes().filter("type = 'report_regenerated'")
    keys = spark.read.parquet(f"{log.root}/reports")
    w = W.partitionBy("match_id").orderBy("batch_id")
    again = keys.withColumn("again", (F.lag("key").over(w) == F.col("key")).cast("long")).groupBy("match_id").agg(F.coalesce(F.sum("again"), F.lit(0)).alias("repeats"))
    last = told.groupBy("match_id").agg(F.max_by("text", "batch_id").alias("lede"))
    return last.join(again.withColumn("match_id", F.col("match_id").cast("long")), "match_id").select("match_id", "lede", "repeats")


def _posts_stream(spark, d):
    p = FE.posts(spark, d).select("post_id", "network", "author_id", "handle", F.concat_ws(" ", "tag", "text").alias("text"), "ts")
    src = once(spark, d, "posts-stream", lambda: p)
    path = src.inputFiles()[0].rsplit("/", 1)[0]
    return spark.readStream.schema(src.schema).parquet(path)


def _latest(spark, d, counted, keys):
    sink = SO.LatestByBatch(scratch(spark, "windows"), keys)
    flat = counted.withColumn("from", F.date_format("w.start", "yyyy-MM-dd HH:mm")).drop("w")
    q = flat.writeStream.outputMode("update").foreachBatch(sink.write).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink.read(spark)


def _appended(spark, df):
    out = scratch(spark, "sink")
    q = df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


QUERIES = {
    "stream_append": stream_append,
    "stream_state": lambda s, d: _run(s, d).states().select(*C.SCORE_COLS),
    "stream_changes": lambda s, d: _run(s, d).changes().select("batch_id", "match_id", "type", "ref", "text"),
    "stream_score_feed": score_feed,
    "stream_reports": stream_reports,
    "stream_resume": stream_resume,
    "stream_reset": stream_reset,
    "stream_reset_in_batch": stream_reset_in_batch,
    "stream_volume": lambda s, d: _latest(s, d, SO.hourly_volume(_posts_stream(s, d)), ["from", "network"]),
    "stream_trends": lambda s, d: _latest(s, d, SO.sliding_trends(_posts_stream(s, d)), ["from", "tag"]),
    "stream_fingerprints": lambda s, d: _appended(s, SO.first_of_fingerprint(_posts_stream(s, d))).select("fp"),
    "stream_author_cap": lambda s, d: _appended(s, SO.cap_authors(_posts_stream(s, d))),
}

ORACLE = {
    "stream_append": C.sql(C.COUNT_BY),
    "stream_state": C.ORACLE["match_score"],
    "stream_score_feed": f"SELECT match_id, home_score, away_score, CAST(0 AS BIGINT) AS repeats FROM ({C.ORACLE['match_score']})",
    "stream_reports": N.LIVE_NOW,
    "stream_reset": with_views("SELECT match_id, count(*) AS n FROM match_events WHERE match_id % 5 <> 0 OR match_id = 5 GROUP BY match_id", "match_events"),
    "stream_reset_in_batch": with_views("SELECT match_id, count(*) AS n FROM match_events WHERE match_id % 5 <> 0 OR match_id = 5 GROUP BY match_id", "match_events"),
    "stream_volume": FE.sql("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS "from", network, count(*) AS posts FROM p GROUP BY ALL"""),
    "stream_trends": FE.sql("""SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(h AS INT)), '%Y-%m-%d %H:%M') AS "from", lower(substr(tag, 2)) AS tag, count(*) AS posts FROM p, range(0, 6) r(h) GROUP BY ALL"""),
    "stream_fingerprints": FE.sql(f"SELECT DISTINCT {FE._fpq('''concat_ws(' ', tag, text)''')} AS fp FROM p"),
    "stream_author_cap": FE.sql("SELECT post_id, network, author_id, n_in_window FROM capped", True, **FE._cap("SELECT * FROM p")),
}
