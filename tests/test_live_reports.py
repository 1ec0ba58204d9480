"""The live log tells a report when it says something else, and only then."""

from pyspark.sql import functions as F

from tests.conftest import correction, event, frames, starting_log
from touchline.operators import changes as CH
from touchline.operators import log as LG
from touchline.operators import moments as MO
from touchline.operators import report as RP
from touchline.operators import state as ST
from touchline.streaming import live as LV


def test_what_was_told_last(spark, tmp_path):
    """By batch: a retried batch doesn't see its own report, a reset drops what came before it."""
    e, k = frames(spark, starting_log(), [])
    log = LV.LiveLog(spark, str(tmp_path / "log"), e.schema, k.schema)
    keep = spark.createDataFrame([(1,), (2,), (3,)], "match_id long").withColumn("bucket", LV.RC.bucket())
    told = lambda before: {r["match_id"]: r["key"] for r in log.reports_told(keep, before).collect()}
    assert told(0) == {}
    for batch_id, rows in ((0, [(1, "a"), (2, "b"), (9, "z")]), (2, [(1, "c")])):
        df = spark.createDataFrame(rows, "match_id long, key string").withColumn("bucket", LV.RC.bucket()).withColumn("batch_id", F.lit(batch_id).cast("long"))
        log._write(df, "reports", batch_id)
    assert told(1) == told(2) == {1: "a", 2: "b"} and told(3) == {1: "c", 2: "b"}
    log._write(spark.createDataFrame([(2, None, 3)], "match_id long, seq long, batch_id long"), "resets", 3)
    assert told(3) == {1: "c"} and told(4) == {1: "c"}


def test_told_anew(spark):
    keys = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "match_id long, key string")
    after = spark.createDataFrame([(1, "a", "x"), (2, "c", "y"), (3, "d", "z"), (4, "e", "w")], "match_id long, key string, lede string")
    got = CH.report_messages(CH.reports_told_anew(keys, after)).collect()
    assert sorted((r["match_id"], r["type"], r["text"]) for r in got) == [(2, "report_regenerated", "y"), (3, "report_regenerated", "z"), (4, "report_regenerated", "w")]
    same = spark.createDataFrame([(["a", "b"], "c"), (["a"], "c"), (["a\nb"], "c"), (["a", "b"], "c"), ([], "c")], "lines array<string>, lede string")
    assert same.select(CH.report_key(F.col("lines"), F.col("lede")).alias("k")).distinct().count() == 4


def test_what_a_report_says(spark):
    """A pass changes neither lede nor lines, a correction does."""
    matches = spark.createDataFrame([(1, "Home Town", "Away City")], "match_id long, home string, away string")
    series = spark.createDataFrame([], "match_id long, minute int, p_home double, p_draw double, p_away double")

    def said(events, corrections=()):
        e, k = frames(spark, events, corrections)
        sides = ST.discover_sides(e)
        c = LG.corrected_events(e, LG.resolve(k))
        w = MO.winner(ST.match_state(c, sides), matches)
        r = RP.spoken(w, ST.goals(c, sides), MO.candidates(e, k, series, w)).first()
        return r["lines"], r["lede"]

    lines, lede = said(starting_log())
    assert lede == "Home Town lead Away City 2-1 after 62 minutes." and len(lines) == 3
    assert said([*starting_log(), event("p1", 61, team="A", period=2)]) == (lines, lede)
    again, level = said(starting_log(), [correction("k1", "g2", "disallow", 62, 2)])
    assert level == "Home Town and Away City are level at 1-1 after 62 minutes." and again != lines
