"""What each feed provides, and the sentence for what it doesn't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Feed, its name, events, xG, freeze frames, lineups, corrections, live, seconds between updates, licence.
FEEDS = (
    ("statsbomb", "StatsBomb Open Data", True, True, True, True, False, False, None, "Free for research and education; credit required."),
    ("football-data", "football-data.org", False, False, False, False, False, True, 60, "Free tier for non-commercial use; attribution requested."),
    ("api-football", "API-Football", True, False, False, True, True, True, 15, "Commercial API; free tier 100 requests a day."),
)
COLUMNS = ("feed string, name string, has_events boolean, has_xg boolean, has_freeze_frames boolean, has_lineups boolean, has_corrections boolean, "
           "is_live boolean, update_seconds int, licence string")
#: How a capability is called in a sentence, and the sentence.
CALLED = {
    "has_events": "shot-by-shot event data",
    "has_xg": "expected-goals values",
    "has_freeze_frames": "player positions at the moment of a shot",
    "has_lineups": "confirmed lineups",
    "has_corrections": "VAR and post-match corrections",
}
MISSING = "This competition is covered by the %s feed, which does not provide %s, so there is nothing to show here. It is not an error."


def missing(rows: DataFrame, feed: str = "feed") -> DataFrame:
    """For each row and each thing its feed lacks: `capability` and `explanation`.  Rows of unknown feeds have none."""
    feeds = rows.sparkSession.createDataFrame(FEEDS, COLUMNS)
    lacks = feeds.unpivot(["feed", "name"], list(CALLED), "capability", "has").where("NOT has")
    called = F.create_map(*[F.lit(x) for kv in CALLED.items() for x in kv])[F.col("capability")]
    lacks = lacks.select(F.col("feed").alias("_feed"), "capability", F.format_string(MISSING, "name", called).alias("explanation"))
    return rows.join(lacks, F.col(f"`{feed}`") == F.col("_feed")).drop("_feed")
