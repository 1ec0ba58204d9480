"""The live log: idempotent append, refold of the touched matches, change feed.

Late and out-of-order records are always accepted - there is no watermark on the
log, because a match's projection depends only on the set of its records.  The
log tables are the state: a micro-batch appends what is new, finds the matches
it touched and refolds those with the batch operators.  Replaying a batch after
a failure writes the same partitions again.

A reset is a tombstone: it hides what came before it.  Where records have a
sequence number, that is what has a smaller one, so a micro-batch can hold a
reset and records from both sides of it in any order.  Without one, all records of
the reset's own batch count as later.  Batches keep the feed's order for a match,
as a log partitioned by match does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from touchline import schemas
from touchline.operators import changes as CH
from touchline.operators import features as FT
from touchline.operators import log as LG
from touchline.operators import model as MD
from touchline.operators import moments as MO
from touchline.operators import report as RP
from touchline.operators import state as ST
from touchline.operators import timeline as TL
from touchline.session import cut
from touchline.sources import records as RC


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16, fmt: str = "parquet") -> DataFrame:
    """(kind, match_id, body) records landed as files; any source with these
    columns will do; `seq` may be missing."""
    return spark.readStream.schema(schemas.STREAM_RECORD).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


class LiveLog:
    """Tables under one root: events, corrections, resets, state, reports, changes.

    Of reports the log keeps a key of what was told; without `matches`, which has the
    names of the teams, there are none.
    """

    def __init__(self, spark: SparkSession, root: str, event_schema: StructType, correction_schema: StructType, matches: DataFrame | None = None) -> None:
        self.spark, self.root, self.matches = spark, root, matches
        tail = [StructField("record_seq", LongType()), StructField("batch_id", LongType())]
        self.schemas = {"event": StructType([*event_schema.fields, *tail]), "correction": StructType([*correction_schema.fields, *tail])}
        self.ids = {"event": "event_id", "correction": "correction_id"}

    # ---- reading
    def _table(self, name: str, schema: StructType) -> DataFrame:
        path = f"{self.root}/{name}"
        if not RC.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _resets(self, through: int | None = None) -> DataFrame:
        """Per match its last reset by number (`reset_seq`), by batch (`reset_at`), and by batch among those without a number (`reset_plain`)."""
        s = StructType([StructField("match_id", LongType()), StructField("seq", LongType()), StructField("batch_id", LongType())])
        t = self._table("resets", s)
        if through is not None:
            t = t.filter(F.col("batch_id") <= through)
        t = t.withColumn("match_id", F.col("match_id").cast(self.schemas["event"]["match_id"].dataType))
        return t.groupBy("match_id").agg(F.max("seq").alias("reset_seq"), F.max("batch_id").alias("reset_at"), F.max(F.when(F.col("seq").isNull(), F.col("batch_id"))).alias("reset_plain"))

    def _not_reset(self, rows: DataFrame, through: int | None = None) -> DataFrame:
        """The rows (with `record_seq`, `batch_id`) that no reset of a batch up to `through` hides."""
        earlier = lambda a, b: F.coalesce(F.col(a) < F.col(b), F.lit(False))
        hidden = F.when(F.col("record_seq").isNull(), earlier("batch_id", "reset_at")).otherwise(earlier("record_seq", "reset_seq") | earlier("batch_id", "reset_plain"))
        return rows.join(self._resets(through), "match_id", "left").filter(~hidden).drop("reset_seq", "reset_at", "reset_plain")

    def visible(self, kind: str, before: int | None = None, keep: DataFrame | None = None, through: int | None = None) -> DataFrame:
        """Records not dropped by a reset; optionally as of an earlier batch and
        only for some matches.  `through`: the last batch whose resets count, if not the one before."""
        t = self._table(kind, StructType([*self.schemas[kind].fields, StructField("bucket", schemas.I)]))
        if keep is not None:
            t = t.join(keep, ["bucket", "match_id"], "left_semi")
        if before is not None:
            t = t.filter(F.col("batch_id") < before)
            through = before - 1 if through is None else through
        return self._not_reset(t, through).drop("bucket", "batch_id", "record_seq")

    # ---- one micro-batch
    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Append what the log does not hold; drop nothing, update nothing."""
        seq = F.col("seq").cast("long") if "seq" in batch.columns else F.lit(None).cast("long")
        batch = batch.withColumn("seq", seq)
        at = F.lit(batch_id).cast("long").alias("batch_id")
        control = batch.filter("kind = 'control' AND body = 'reset'").groupBy("match_id").agg(F.max("seq").alias("seq"), F.max(F.col("seq").isNull()).alias("plain"))
        # A match may have a reset of both kinds: two rows then.
        control = control.select("match_id", F.explode(F.array_distinct(F.array("seq", F.when(~F.col("plain"), F.col("seq"))))).alias("seq"), at)
        self._write(control, "resets", batch_id)
        for kind, schema in self.schemas.items():
            body = StructType(schema.fields[:-2])
            new = batch.filter(F.col("kind") == kind).select(F.from_json("body", body).alias("r"), F.col("seq").alias("record_seq")).select("r.*", "record_seq")
            # Of copies the last counts, as a reset may stand between them; one without a number is later than any.
            new = LG._first_copy(new, ["match_id", self.ids[kind]], [F.desc_nulls_first("record_seq")]).withColumn("bucket", RC.bucket())
            new = self._not_reset(new.select("*", at), batch_id)
            touched = new.select("bucket", "match_id").distinct()
            old = self.visible(kind, batch_id, touched, through=batch_id).select("match_id", self.ids[kind])
            self._write(new.join(old, ["match_id", self.ids[kind]], "left_anti"), kind, batch_id)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        """Partitioned by batch: a retried batch replaces its own output.  A bucket's rows are
        brought together first, so the files grow with the rows and not with tasks times buckets."""
        if "bucket" in df.columns:
            df = df.hint("rebalance", F.col("bucket"))
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[c for c in ("batch_id", "bucket") if c in df.columns]).parquet(f"{self.root}/{name}")

    def touched(self, batch: DataFrame) -> DataFrame:
        t = self.schemas["event"]["match_id"].dataType
        return batch.select(F.col("match_id").cast(t).alias("match_id")).distinct().withColumn("bucket", RC.bucket())

    def project(self, keep: DataFrame, before: int | None = None) -> dict[str, DataFrame]:
        """State, timeline and probability of some matches from their log."""
        e, k = self.visible("event", before, keep), self.visible("correction", before, keep)
        sides = self.matches.select("match_id", "home_id", "away_id") if self.matches is not None else ST.discover_sides(e)
        sides = sides.join(keep.select("match_id"), "match_id", "left_semi")
        v = LG.resolve(k)
        c = LG.corrected_events(e, v)
        state = ST.match_state(c, sides)
        inc = FT.minute_increments(LG.effective_events(e, v), sides)
        return {"events": e, "state": state, "corrections": k, "timeline": TL.corrected_timeline(e.drop("home_id", "away_id"), k, v, sides), "goals": ST.goals(c, sides),
                "series": MD.stand_in_series(FT.feature_rows(FT.minute_state(inc, sides)))}

    def reports_told(self, keep: DataFrame, before: int) -> DataFrame:
        """`match_id`, `key` of the report last told before a batch; a reset up to that batch drops it."""
        s = StructType([StructField("match_id", self.schemas["event"]["match_id"].dataType), StructField("key", StringType()), StructField("batch_id", LongType()), StructField("bucket", schemas.I)])
        t = self._table("reports", s).filter(F.col("batch_id") < before).join(keep, ["bucket", "match_id"], "left_semi")
        last = t.groupBy("match_id").agg(F.max_by("key", "batch_id").alias("key"), F.max("batch_id").alias("batch_id"))
        gone = F.coalesce(F.col("batch_id") < F.col("reset_at"), F.lit(False))
        return last.join(self._resets(before), "match_id", "left").filter(~gone).select("match_id", "key")

    def reports(self, now: dict[str, DataFrame], state: DataFrame, keep: DataFrame, batch_id: int) -> DataFrame:
        """The reports of the touched matches that say something else than what was told last."""
        w = MO.winner(state, self.matches)
        moments = MO.suppress_duplicates(MO.choose(MO.candidates(now["events"], now["corrections"], now["series"], w)))
        spoken = RP.spoken(w, now["goals"], moments).withColumn("key", CH.report_key(F.col("lines"), F.col("lede")))
        return CH.reports_told_anew(self.reports_told(keep, batch_id), spoken)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """foreachBatch: append, refold the touched matches, publish the diff."""
        batch = batch.persist()
        try:
            self.append(batch, batch_id)
            keep = cut(self.touched(batch), "touched")
            old, new = self.project(keep, batch_id), self.project(keep)
            state = cut(new["state"], "state")
            self._write(state.withColumn("batch_id", F.lit(batch_id).cast("long")), "state", batch_id)
            msgs = reduce(DataFrame.unionByName, [
                CH.corrections_applied(old["corrections"], new["corrections"], new["goals"], state), CH.items_appended(old["timeline"], new["timeline"]),
                CH.states_changed(old["state"], state), CH.probability_updated(old["state"], old["series"], state, new["series"])])
            if self.matches is not None:
                told = cut(self.reports(new, state, keep, batch_id), "reports")
                self._write(told.select("match_id", "key", RC.bucket().alias("bucket"), F.lit(batch_id).cast("long").alias("batch_id")), "reports", batch_id)
                msgs = msgs.unionByName(CH.report_messages(told))
            # The place of a message depends on nothing but the messages of its match, so a retry gives the same.
            place = W.partitionBy("match_id").orderBy("rank", "ref", "text")
            numbered = msgs.withColumn("n", F.row_number().over(place).cast("long"))
            self._write(numbered.withColumn("batch_id", F.lit(batch_id).cast("long")), "changes", batch_id)
            scores = CH.score_feed(old["state"], state).withColumn("batch_id", F.lit(batch_id).cast("long"))
            self._write(scores, "scores", batch_id)
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    # ---- what followers read
    def states(self) -> DataFrame:
        """The latest projection of every match that still has records."""
        s = self.spark.read.parquet(f"{self.root}/state")
        cols = [c for c in s.columns if c not in ("match_id", "batch_id")]
        latest = s.groupBy("match_id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
        j = latest.join(self._resets(), "match_id", "left").filter(F.col("reset_at").isNull() | (F.col("batch_id") >= F.col("reset_at")))
        return j.select("match_id", "s.*")

    def changes(self, since: tuple[int, int, int] | None = None) -> DataFrame:
        """The change feed, in order; `since` is the last (batch_id, match_id, n) seen."""
        c = self.spark.read.parquet(f"{self.root}/changes")
        place = ("batch_id", "match_id", "n")
        if since is not None:
            c = c.filter(F.struct(*place) > F.struct(*[F.lit(x).cast("long").alias(p) for x, p in zip(since, place)]))
        return c.orderBy(*place)

    def score_changes(self) -> DataFrame:
        """Across all matches: each batch that left a match with another score, and that score."""
        return self.spark.read.parquet(f"{self.root}/scores")


def encoded(events: DataFrame, corrections: DataFrame) -> DataFrame:
    recs = RC.encode(events, "event").unionByName(RC.encode(corrections, "correction"))
    return recs.withColumn("match_id", F.col("match_id").cast("long"))


def resets(match_ids: DataFrame) -> DataFrame:
    return match_ids.select(F.lit("control").alias("kind"), F.col("match_id").cast("long").alias("match_id"), F.lit("reset").alias("body"))

