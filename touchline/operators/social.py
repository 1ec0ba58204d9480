"""Posts: which topics they are about, which are kept, and what trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.session import cut, spread

# Ages, caps, labels and the words that make a post football.
MAX_AGE_H, KEEP_ALL, KEEP_EACH = 72, 3000, 600
AUTHOR_CAP, AUTHOR_WINDOW_H = 8, 6
NETWORKS = ("bluesky", "mastodon", "reddit", "x")
BLOCKED = ("porn", "sexual", "nudity", "graphic-media", "gore", "nsfl", "!no-unauthenticated", "!hide")
FOOTBALL = (r"(?iu)\b(football|soccer|futbol|fútbol|fussball|goal|goals|scored|scorer|match|matchday|fixture|kick-?off|half-?time|full-?time|"
            r"penalty|var|derby|league|cup|keeper|striker|midfielder|defender|manager|transfer|lineup|line-up|xi|stadium|clean sheet|hat-?trick)\b")
WORD = r"(?U)\w+"


def blocked(labels: Column) -> Column:
    return F.coalesce(F.arrays_overlap(labels, F.array(*[F.lit(b) for b in BLOCKED])), F.lit(False))


def is_football(text: Column, has_topic: Column) -> Column:
    """Placed under a topic, or a football word outside the hashtags."""
    return has_topic | F.when(text.contains("#"), F.regexp_replace(text, r"(?U)#\w+", " ")).otherwise(text).rlike(FOOTBALL)


def recent(posts: DataFrame, now: Column, hours: int = MAX_AGE_H) -> DataFrame:
    """Drop posts without a readable time and those older than the limit."""
    return posts.filter(F.col("ts").isNotNull() & (F.col("ts") >= now - F.make_interval(hours=F.lit(hours))))


# ---- classification


def classify(posts: DataFrame, aliases: DataFrame, lookalikes: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(post_id, topic) for every topic a post is about.

    posts: post_id, text and optionally `via` (the topic whose search found it).
    aliases: topic, kind, code, side, alias, strong.

    Posts never meet aliases pairwise: a post's words are joined with the longest
    word of each alias, and only those candidates are held against the text.  A
    fixture needs both teams by a strong alias, or either team by any alias when
    its own search found the post; a competition needs its name, with the names
    of look-alikes taken out, or one of its fixtures.
    """
    lookalikes = lookalikes or {}
    via = F.col("via") if "via" in posts.columns else F.lit(None).cast("string")
    p = spread(posts.select("post_id", via.alias("via"), "text"), "post_id").select("post_id", "via", T.folded(F.col("text")).alias("txt"))
    # one more version of the text per competition whose look-alikes occur in it
    versions = [F.struct(F.lit(None).cast("string").alias("only"), F.col("txt").alias("txt"))]
    replaced = []
    for code, names in lookalikes.items():
        t = F.col("txt")
        for name in names:
            t = F.replace(t, F.lit(T._fold(name)), F.lit(" "))
        versions.append(F.when(t != F.col("txt"), F.struct(F.lit(code).alias("only"), t.alias("txt"))))
        replaced.append(F.when(t != F.col("txt"), F.lit(code)))
    cut_for = F.array_compact(F.array(*replaced)) if replaced else F.array().cast("array<string>")
    v = cut(p.select("post_id", "via", cut_for.alias("cut_for"), F.inline(F.array_compact(F.array(*versions)))), "texts")
    # the words of a text, once each; the text itself is not carried along.  Of ASCII alone they are the same by the quick pattern
    found = F.when(T.is_ascii(F.col("txt")), F.regexp_extract_all("txt", F.lit(r"\w+"), F.lit(0))).otherwise(F.regexp_extract_all("txt", F.lit(WORD), F.lit(0)))
    words = v.select("post_id", "via", "cut_for", "only", F.explode(F.array_distinct(found)).alias("word"))
    tokens = F.regexp_extract_all("alias", F.lit(WORD), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    a = aliases.filter(F.size(tokens) > 0).withColumns({"word": longest, "whole": F.col("alias") == longest})
    comp = F.col("kind") == "competition"
    right_text = F.when(F.col("only").isNull(), ~(comp & F.array_contains("cut_for", F.col("code")))).otherwise(comp & (F.col("only") == F.col("code")))
    near = words.join(a, "word").filter(right_text).select("post_id", "via", "only", "topic", "kind", "code", "side", "alias", "strong", "whole")
    near = cut(near, "near")
    # a one-word alias is settled; of the rest, the text decides
    literal = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.col("alias"), F.lit(r"\E(?!\w)"))
    check = near.filter("NOT whole").withColumn("only", F.coalesce("only", F.lit("")))
    texts = v.select("post_id", F.coalesce("only", F.lit("")).alias("only"), "txt").join(check.select("post_id", "only").distinct(), ["post_id", "only"], "left_semi")
    checked = check.join(texts, ["post_id", "only"]).filter(F.regexp_like("txt", literal)).drop("txt")
    named = near.filter("whole").unionByName(checked)
    side = lambda s, cond=F.lit(True): F.bool_or((F.col("side") == s) & cond)
    hits = named.groupBy("post_id", "topic", "kind", "code").agg(
        side("home", F.col("strong")).alias("h"), side("away", F.col("strong")).alias("a"),
        F.bool_or(F.col("via") == F.col("topic")).alias("searched"))
    fixtures = hits.filter((F.col("kind") == "fixture") & ((F.col("h") & F.col("a")) | F.coalesce("searched", F.lit(False))))
    competitions = aliases.filter(comp).select("code", F.col("topic").alias("comp_topic")).distinct()
    of_fixture = fixtures.select("post_id", "code").distinct().join(competitions, "code").select("post_id", F.col("comp_topic").alias("topic"))
    return (fixtures.select("post_id", "topic").unionByName(hits.filter(comp).select("post_id", "topic")).unionByName(of_fixture).distinct())


def merge_topics(posts: DataFrame, key: str = "id") -> DataFrame:
    """The same post found twice is one post with both sets of topics."""
    rest = [c for c in posts.columns if c not in (key, "topics")]
    t = posts.select(key, F.explode_outer("topics").alias("topic")).distinct().groupBy(key).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    w = Window.partitionBy(key).orderBy(F.xxhash64(*rest))
    one = posts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(key, *rest)
    return one.join(t, key)


# ---- admission


def unseen(posts: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    return posts.join(stored.select(key).distinct(), key, "left_anti")


def first_of_each(posts: DataFrame) -> DataFrame:
    """The earliest post of every fingerprint within the retention."""
    w = Window.partitionBy("fp").orderBy("ts", "post_id")
    return posts.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def author_windows(posts: DataFrame, author: Sequence[str], hours: int = AUTHOR_WINDOW_H) -> DataFrame:
    """Start of every counting window of each author.

    A window opens at the author's first post after the one before has run out,
    so each is the least time past the last: one small aggregate a round, every
    author at once, as many rounds as windows fit into the span of the posts.
    """
    keys = list(author)
    starts = cut(posts.groupBy(*keys).agg(F.min("ts").alias("start")), "windows")
    every, last = starts, starts
    while True:
        j = posts.select(*keys, "ts").join(last, keys).filter(F.col("ts") >= F.col("start") + F.make_interval(hours=F.lit(hours)))
        nxt = cut(j.groupBy(*keys).agg(F.min("ts").alias("start")), "windows")
        if nxt.isEmpty():
            return every
        every, last = every.unionByName(nxt), nxt


def cap_authors(posts: DataFrame, author: Sequence[str], cap: int = AUTHOR_CAP, hours: int = AUTHOR_WINDOW_H) -> DataFrame:
    """At most `cap` posts of an author per window; adds the window's start.

    An author with very many posts is not gathered: the windows are a few rows
    an author, and the first posts of each are picked by a rank that is also
    applied before the shuffle.
    """
    keys = list(author)
    starts = author_windows(posts, keys, hours).groupBy(*keys).agg(F.array_sort(F.collect_list("start")).alias("starts"))
    inside = posts.join(starts, keys).withColumn("window_start", F.array_max(F.filter("starts", lambda s: s <= F.col("ts")))).drop("starts")
    w = Window.partitionBy(*keys, "window_start").orderBy("ts", "post_id")
    return inside.withColumn("n_in_window", F.row_number().over(w)).filter(F.col("n_in_window") <= cap)


# ---- reading


def page(posts: DataFrame, *, topic: str | None = None, network: str | None = None, lang: str | None = None, before=None, limit: int = 30) -> DataFrame:
    """Newest first; a post without a language passes the language filter."""
    rows = posts
    if topic and topic != "all":
        rows = rows.filter(F.array_contains("topics", topic))
    if network:
        rows = rows.filter(F.col("network") == network)
    if lang:
        rows = rows.filter(F.col("lang").isNull() | (F.col("lang") == "") | F.col("lang").startswith(lang))
    if before is not None:
        rows = rows.filter(F.col("ts") < before)
    return rows.orderBy(F.col("ts").desc(), F.col("post_id").desc()).limit(limit)


def retained(posts: DataFrame, key: str, keep: int) -> DataFrame:
    """The newest `keep` posts of each network or topic."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("post_id").desc())
    return posts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def retained_overall(posts: DataFrame, keep: int = KEEP_ALL) -> DataFrame:
    return posts.orderBy(F.col("ts").desc(), F.col("post_id").desc()).limit(keep)


def volume(posts: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Posts per network in each of the last hours, 0 = the hour up to now."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    h = (F.ceil(age) - 1).cast("int")
    return posts.withColumn("hours_ago", h).filter(F.col("hours_ago").between(0, hours - 1)).groupBy("network", "hours_ago").agg(F.count(F.lit(1)).alias("posts"))


def since(posts: DataFrame, now: Column, hours: int) -> DataFrame:
    return posts.filter((F.col("ts").cast("timestamp") >= now - F.make_interval(hours=F.lit(hours))) & (F.col("ts").cast("timestamp") <= now))


def trends(posts: DataFrame, now: Column, top: int = 12) -> DataFrame:
    """Most used hashtags of the last six hours, each post counting once."""
    tags = since(posts, now, 6).select(F.explode(T.hashtags(F.col("text"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("posts")).orderBy(F.col("posts").desc(), "tag").limit(top)


def per_topic(placed: DataFrame, now: Column) -> DataFrame:
    """Posts of the last day by topic; `placed`: post_id, topic, ts."""
    return since(placed, now, 24).groupBy("topic").agg(F.count(F.lit(1)).alias("posts"))


def total_day(posts: DataFrame, now: Column) -> DataFrame:
    return since(posts, now, 24).agg(F.count(F.lit(1)).alias("total_24h"))
