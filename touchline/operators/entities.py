"""Cross-feed entity resolution: known alias, exact, fuzzy, else for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import text as T

FUZZY = 0.92
# Hand-kept links, "<feed>:<id>" -> canonical id.
CURATED = {"football-data:44": "5503", "api-football:154": "5503", "api-football:278": "3009", "api-football:44": "4320",
           "api-football:47380": "5470", "football-data:81": "217", "api-football:529": "217", "football-data:86": "220", "api-football:541": "220"}


def curated(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(CURATED.items()), "feed_key string, canonical_id string")


def _normalise(c: str) -> Column:
    return T.normalise_name(T.fold(F.coalesce(c, F.lit(""))))


def candidate_names(candidates: DataFrame) -> DataFrame:
    """canonical_id, name, birth_date, team -> one row per distinct key set."""
    n = candidates.select("canonical_id", F.coalesce("birth_date", F.lit("")).alias("birth_date"), _normalise("name").alias("norm"), _normalise("team").alias("team_norm"))
    return n.withColumn("sorted_name", T.token_sorted(F.col("norm")))


def resolve(mentions: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """mentions: feed, feed_id, name, birth_date, team.  known: feed_key, canonical_id.

    Stages run on what the one before left over, and on distinct names rather
    than rows: each distinct (name, team) is scored once against the distinct
    names of its own team (a team can be named by one side only, then it blocks
    nothing and cannot link).  Ties go to the least id.  Only equal names score 1,
    so a name found among its team's is settled by a join and meets no other:
    names of one pattern would meet all of their team.
    """
    m = mentions.select("feed", "feed_id", F.coalesce("birth_date", F.lit("")).alias("birth_date"), _normalise("name").alias("norm"), _normalise("team").alias("team_norm"),
                        F.concat_ws(":", "feed", "feed_id").alias("feed_key"))
    c = candidate_names(candidates)
    exact = c.filter("birth_date <> ''").groupBy("norm", "birth_date").agg(F.min("canonical_id").alias("exact_id"))
    j = m.join(known.withColumnRenamed("canonical_id", "alias_id"), "feed_key", "left").join(exact, ["norm", "birth_date"], "left")
    # fuzzy: distinct names of one team, scored once
    open_ = j.filter(F.col("alias_id").isNull() & F.col("exact_id").isNull() & (F.col("team_norm") != ""))
    left = open_.select("team_norm", T.token_sorted(F.col("norm")).alias("target")).distinct()
    # a candidate without a team is compared with every team's mentions
    mine = c.filter("team_norm <> ''").groupBy("team_norm", "sorted_name").agg(F.min("canonical_id").alias("canonical_id"))
    free = c.filter("team_norm = ''").groupBy("sorted_name").agg(F.min("canonical_id").alias("canonical_id"))
    key, named = ["team_norm", "target"], left.filter("target <> ''")
    equal = named.join(mine.withColumnRenamed("sorted_name", "target"), key).unionByName(named.join(free.withColumnRenamed("sorted_name", "target"), "target"))
    equal = equal.groupBy(*key).agg(F.min("canonical_id").alias("fuzzy_id"))
    left = left.join(equal, key, "left_anti")
    pairs = _possible(left, mine, ["team_norm"]).unionByName(_possible(left, free, []))
    scored = pairs.withColumn("score", T.jaro_winkler("target", "sorted_name")).filter(F.col("score") >= FUZZY)
    best = scored.groupBy(*key).agg(F.min_by("canonical_id", F.struct(-F.col("score"), "canonical_id")).alias("fuzzy_id")).unionByName(equal)
    j = j.withColumn("target", T.token_sorted(F.col("norm"))).join(best, ["team_norm", "target"], "left")
    method = (F.when(F.col("alias_id").isNotNull(), "alias").when(F.col("exact_id").isNotNull(), "exact")
              .when(F.col("fuzzy_id").isNotNull(), "fuzzy").otherwise("unresolved"))
    return j.select("feed", "feed_id", F.coalesce("alias_id", "exact_id", "fuzzy_id").alias("canonical_id"), method.alias("method")).withColumns({
        "confidence": F.when(F.col("method").isin("alias", "exact"), 1.0).when(F.col("method") == "fuzzy", 0.8).otherwise(0.0),
        "needs_review": F.col("method") == "unresolved"})


# Letters from rare to common, and stand-ins whose order is that order.
_RARE, _CODE = "zqxjkvbpygfwmucldrhsnioate ", "0123456789ABCDEFGHIJKLMNOPQ"


def _letters(c: str) -> Column:
    """A name's letters, each numbered by its occurrence, rare ones first."""
    arr = F.filter(F.split(F.translate(c, _RARE, _CODE), ""), lambda x: x != "")
    return F.array_sort(F.transform(arr, lambda x, i: F.concat(x, F.size(F.filter(F.slice(arr, 1, i + 1), lambda y: y == x)).cast("string"))))


def _possible(left: DataFrame, right: DataFrame, block: list[str]) -> DataFrame:
    """Pairs of names that can reach the threshold, found by equality.

    With the largest prefix bonus a similarity of 0.92 needs a plain Jaro of
    13/15, hence matched letters m with m/a + m/b >= 1.6, lengths within 0.6 of
    each other, and at least 0.6 of either name's letters in common.  Two sets
    sharing that much share one of their first (size - 0.6 size + 1) members in
    any fixed order, so names are joined on those members alone; what is joined
    is then held to the full bound.  Nothing that could score is left out.
    """
    def member(df: DataFrame, c: str, out: str) -> DataFrame:
        d = df.withColumn(out, _letters(c))
        n = F.size(out)
        return d.withColumn("member", F.explode(F.slice(F.col(out), F.lit(1), n - F.floor(n * 0.6).cast("int") + 1)))

    j = member(left, "target", "l").join(member(right, "sorted_name", "r"), [*block, "member"])
    a, b, m = F.size("l"), F.size("r"), F.size(F.array_intersect("l", "r"))
    near = (F.least(a, b) * 10 >= F.greatest(a, b) * 6) & (m * 10 * (a + b) >= a * b * 16)
    return j.filter(near).select("team_norm", "target", "sorted_name", "canonical_id").distinct()


def unresolved(resolutions: DataFrame) -> DataFrame:
    """What could not be matched, by feed."""
    return resolutions.filter("needs_review").groupBy("feed").agg(F.count(F.lit(1)).alias("unresolved"))
