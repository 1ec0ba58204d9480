"""One fact from several feeds: who is believed, and where they disagree.

A fact is a row (match_id, fact, feed, value, updated_at); feeds have roles.  For each
kind of fact a stated precedence decides.  Nothing is settled silently: every value
that lost to a different one is a row of the conflict log, and is counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import pitch as P

OFFICIAL, DEEP, OTHER = "official", "deep", "other"
#: Roles by precedence for a kind of fact.  LATEST: the most recently updated.
LATEST = "latest"
PRECEDENCE = {"score": (OFFICIAL, DEEP, OTHER), "kickoff": (OFFICIAL, DEEP, OTHER), "xg": (DEEP,), "lineup": LATEST}
SCHEMA = "match_id long, fact string, feed string, value string, updated_at timestamp"


def _role(roles: Mapping[str, str]) -> Column:
    out = F.lit(OTHER)
    for feed, role in roles.items():
        out = F.when(F.col("feed") == feed, role).otherwise(out)
    return out


def _rank() -> Column:
    """Place of a role for its kind of fact; null if it is not believed at all.  Kinds without a rule go by OFFICIAL, DEEP, OTHER."""
    def places(order: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(F.col("role") == r, k) for k, r in enumerate(order)])

    out = places((OFFICIAL, DEEP, OTHER))
    for fact, order in PRECEDENCE.items():
        out = F.when(F.col("fact") == fact, F.lit(0) if order == LATEST else places(order)).otherwise(out)
    return out


def standing(facts: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """What each feed says last, with its `role` and `rank`.

    A null value says nothing.  Of several values of a feed the latest stands, an unknown
    time being the earliest, and at one time the greatest value.
    """
    said = facts.filter("value IS NOT NULL").groupBy("match_id", "fact", "feed").agg(F.max(F.struct("updated_at", "value")).alias("s"))
    return said.select("match_id", "fact", "feed", "s.value", "s.updated_at").withColumn("role", _role(roles)).withColumn("rank", _rank())


def settled(said: DataFrame) -> DataFrame:
    """`match_id`, `fact`, `feed` and `value` that are believed, `feeds` that spoke, different `values`, `conflict`.

    Equal ranks: the most recently updated, then the first feed by name.  A fact that
    only feeds not believed for it tell is left out.
    """
    at = F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62)))
    best = F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", (-at).alias("at"), "feed", "value"))).alias("best")
    n = F.size(F.collect_set("value")).cast("long")  # as many as there are feeds, at most
    out = said.groupBy("match_id", "fact").agg(best, F.count(F.lit(1)).alias("feeds"), n.alias("values"))
    return out.filter("best IS NOT NULL").select("match_id", "fact", "best.feed", "best.value", "feeds", "values", (F.col("values") > 1).alias("conflict"))


def conflicts(said: DataFrame, believed: DataFrame) -> DataFrame:
    """The log: every value that lost to a different one."""
    kept = believed.filter("conflict").select("match_id", "fact", F.col("feed").alias("kept_feed"), F.col("value").alias("kept"))
    return said.join(kept, ["match_id", "fact"]).filter("value <> kept").select("match_id", "fact", "feed", "value", "kept_feed", "kept")


def counted(log: DataFrame) -> DataFrame:
    """Conflicts by kind of fact and the feeds on both sides."""
    return log.groupBy("fact", "kept_feed", "feed").agg(F.count(F.lit(1)).alias("conflicts"), F.count_distinct("match_id").alias("matches"))


# ---- facts from what the feeds send
def score_facts(events: DataFrame, sides: DataFrame, feed: str, disallowed: DataFrame | None = None) -> DataFrame:
    """The score that a feed's goals add up to, "home-away"; own goals count for the other side.

    `disallowed` has the (match_id, event_id) of goals that the feed itself took back.
    A match of `sides` without a goal in this feed stands at 0-0 if the feed has any event of it.
    """
    e = events.filter("period < 5").drop("home_id", "away_id").join(sides.select("match_id", "home_id", "away_id"), "match_id")
    if disallowed is not None:
        e = e.join(disallowed.select("match_id", "event_id", F.lit(True).alias("__off")), ["match_id", "event_id"], "left").filter("__off IS NULL")
    home, goal, own = F.col("team_id") == F.col("home_id"), P.is_goal(), P.is_own_goal()
    n = lambda cond: F.count(F.when(cond, 1)).cast("string")
    score = F.concat(n((goal & home) | (own & ~home)), F.lit("-"), n((goal & ~home) | (own & home)))
    return _fact(e.groupBy("match_id").agg(score.alias("value")), "score", feed)


def lineup_facts(lineups: DataFrame, feed: str) -> DataFrame:
    """Who starts: the players' ids in order.  `lineups` has `match_id`, `player_id`, `started`, `updated_at`."""
    ids = F.array_join(F.sort_array(F.collect_set(F.col("player_id").cast("string"))), ",")  # a team sheet
    return _fact(lineups.filter("started").groupBy("match_id", "updated_at").agg(ids.alias("value")), "lineup", feed)


def _fact(rows: DataFrame, fact: str, feed: str) -> DataFrame:
    at = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None)
    return rows.select(F.col("match_id").cast("long").alias("match_id"), F.lit(fact).alias("fact"), F.lit(feed).alias("feed"), F.col("value").cast("string").alias("value"), at.cast("timestamp").alias("updated_at"))


def kickoff_facts(matches: DataFrame, kickoff: Column, feed: str) -> DataFrame:
    """When a match begins, in UTC; any offset counts, an unreadable time says nothing."""
    t = F.try_to_timestamp(kickoff.cast("string"))
    return _fact(matches.select("match_id", F.date_format(t, "yyyy-MM-dd HH:mm").alias("value")), "kickoff", feed)
