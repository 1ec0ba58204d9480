"""Registered queries: posts, topics, trends, entities, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions import text as T
from touchline.operators import entities as EN
from touchline.operators import social as SO
from touchline.plans.fixture import table, with_views
from touchline.session import spread

LOOK = {"PL": ("scottish liga", "then thing"), "SA": ()}
# two fixtures and two competitions, by words that occur in the documents
ALIASES = [
    ("f1", "fixture", "PL", "home", "thor", True), ("f1", "fixture", "PL", "home", "thing", True), ("f1", "fixture", "PL", "away", "eron", True),
    ("f1", "fixture", "PL", "away", "erth", True), ("f2", "fixture", "SA", "home", "le", False), ("f2", "fixture", "SA", "home", "anchoi", True),
    ("f2", "fixture", "SA", "away", "sch", True), ("f2", "fixture", "SA", "away", "der", True),
    ("PL", "competition", "PL", "name", "thing", True), ("PL", "competition", "PL", "name", "thor thing", True), ("SA", "competition", "SA", "name", "que tion", True),
    ("SA", "competition", "SA", "name", "ea", True),
]
A_SCHEMA = "topic string, kind string, code string, side string, alias string, strong boolean"
A_SQL = "SELECT * FROM (VALUES " + ", ".join(str(a).replace("True", "TRUE").replace("False", "FALSE") for a in ALIASES) + ") t(topic, kind, code, side, alias, strong)"


def documents(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("post_id"), "text", F.when(F.col("doc_id") % 7 == 0, "f2").when(F.col("doc_id") % 11 == 0, "f1").alias("via"))


def classify(spark, d):
    return SO.classify(documents(spark, d), spark.createDataFrame(ALIASES, A_SCHEMA), LOOK)


def football(spark, d):
    """Relevance of documents and of conversation turns."""
    placed = classify(spark, d).select("post_id").distinct().withColumn("hit", F.lit(True))
    docs = spread(documents(spark, d), "post_id").join(placed, "post_id", "left")
    conv = spread(table(spark, d, "conversations"), "conv_id").select((F.col("conv_id") * 1000 + F.col("turn") + 10_000_000).alias("post_id"), "text", F.lit(False).alias("hit"))
    both = docs.select("post_id", "text", F.coalesce("hit", F.lit(False)).alias("hit")).unionByName(conv)
    return both.select("post_id", SO.is_football(F.col("text"), F.col("hit")).alias("football"))


def posts(spark, d):
    p = table(spark, d, "posts").withColumn("ts", F.col("ts").cast("timestamp"))
    handle = F.concat(F.lit("@a"), F.col("author_id").cast("string"))
    return p.withColumns({"handle": handle, "topics": F.array(F.lit("all"), F.concat(F.lit("t"), (F.col("post_id") % 5).cast("string"))),
                          "lang": F.when(F.col("post_id") % 3 == 0, "en").when(F.col("post_id") % 3 == 1, "de-AT").otherwise("")})


def _now(spark, d):
    """The time of the newest post, read from its own small aggregate."""
    return F.lit(posts(spark, d).agg(F.max("ts")).first()[0])


def fingerprints(spark, d):
    p = posts(spark, d)
    return p.select("post_id", T.fingerprint(F.col("network"), F.col("handle"), F.concat(F.col("text"), F.lit("  https://x.example/"), F.col("post_id").cast("string"))).alias("fp"))


def _fp(p):
    return p.withColumn("fp", T.fingerprint(F.col("network"), F.col("handle"), F.col("text")))


def blocked(spark, d):
    e = table(spark, d, "events")
    labels = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("news"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("gore"))).otherwise(F.lit(None))
    return e.select("event_id", SO.blocked(labels).alias("blocked"))


def author_cap(spark, d):
    p = SO.recent(posts(spark, d), _now(spark, d))
    return SO.cap_authors(p, ["network", "author_id"]).select("post_id", "network", "author_id", "n_in_window", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("window_start"))


def admitted(spark, d):
    """Repeats out first, then the author cap, as posts are admitted."""
    p = SO.first_of_each(_fp(SO.recent(posts(spark, d), _now(spark, d))))
    return SO.cap_authors(p, ["network", "author_id"]).select("post_id", "network", "author_id", "n_in_window")


def merged(spark, d):
    p = posts(spark, d)
    again = p.filter("post_id % 4 = 0").withColumn("topics", F.array(F.lit("found-again"), F.lit("all")))
    return SO.merge_topics(p.unionByName(again), "post_id").select("post_id", F.array_join("topics", ",").alias("topics"))


def unseen(spark, d):
    p = posts(spark, d)
    return SO.unseen(p, p.filter("post_id % 3 <> 0"), "post_id").select("post_id")


def topic_counts(spark, d):
    p = posts(spark, d)
    return SO.per_topic(p.select("post_id", "ts", F.explode("topics").alias("topic")), _now(spark, d))


def trends(spark, d):
    p = posts(spark, d)
    return SO.trends(p.withColumn("text", F.concat_ws(" ", "tag", "text", "tag")), _now(spark, d))


def hashtags(spark, d):
    p = posts(spark, d).withColumn("text", F.concat_ws(" ", "text", "tag", F.upper("tag"), F.lit("#a #1x"), F.concat(F.lit("#Ab"), F.col("post_id").cast("string"))))
    return p.select("post_id", F.array_join(F.array_sort(T.hashtags(F.col("text"))), ",").alias("tags"))


def iso_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+02:00'")).when(F.col("event_id") % 4 == 2, F.lit("yesterday"))
    return e.select("event_id", F.round(T.epoch_seconds(iso), 3).alias("at"))


# ---- names: parts stand for players, brands for teams
def mentions(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 4 == 0, F.initcap("p_name")).when(F.col("p_partkey") % 4 == 1, F.regexp_replace("p_name", "i", "í")).when(
        F.col("p_partkey") % 4 == 2, F.regexp_replace("p_name", "(.)$", "")).otherwise(F.reverse("p_name"))
    feed = F.when(F.col("p_partkey") % 2 == 0, "football-data").otherwise("api-football")
    return p.select(feed.alias("feed"), F.col("p_partkey").cast("string").alias("feed_id"), name.alias("name"),
                    F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("199"), (F.col("p_size") % 10).cast("string"))).alias("birth_date"),
                    F.when(F.col("p_partkey") % 13 == 0, F.lit(None)).otherwise(F.upper("p_brand")).alias("team"))


def candidates(spark, d):
    p = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"), F.min_by("p_size", "p_partkey").alias("size"))
    return p.select(F.format_string("c%07d", "k").alias("canonical_id"), F.col("p_name").alias("name"), F.concat(F.lit("199"), (F.col("size") % 10).cast("string")).alias("birth_date"),
                    F.when(F.col("k") % 17 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("team"))


def entities(spark, d):
    c = candidates(spark, d)
    return EN.resolve(mentions(spark, d), c, EN.curated(c))


def team_identity(spark, d):
    """Teams between feeds: the same stages, a country as the block."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    m = s.select(F.lit("api-football").alias("feed"), F.col("s_suppkey").cast("string").alias("feed_id"), F.regexp_replace("s_name", "#", " ").alias("name"),
                 F.lit(None).cast("string").alias("birth_date"), F.col("n_name").alias("team"))
    c = s.select(F.format_string("t%06d", "s_suppkey").alias("canonical_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("birth_date"), F.lower("n_name").alias("team"))
    return EN.resolve(m, c, EN.curated(c))


def names(spark, d):
    docs = table(spark, d, "documents")
    n = T.normalise_name(T.fold("text"))
    return docs.select("doc_id", F.md5(n).alias("normalised"), F.md5(T.token_sorted(n)).alias("sorted_tokens"))


def similarity(spark, d):
    c = candidates(spark, d).select("name").distinct()
    # the checking engine halves an odd number of transpositions downwards, so
    # only pairs without one are compared here; tests/ covers the rest
    pairs = c.withColumn("b", F.regexp_replace("name", "(.)$", "")).unionByName(c.withColumn("b", F.concat(F.reverse(F.substring("name", 1, 2)), F.substr(F.col("name"), F.lit(3)))))
    pinned = spark.createDataFrame([("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx")], "name string, b string")
    return pairs.unionByName(pinned).distinct().select("name", "b", F.round(T.jaro_winkler("name", "b"), 4).alias("score"))


QUERIES = {
    "topics": classify,
    "football_relevance": football,
    "blocked_labels": blocked,
    "posts_recent": lambda s, d: SO.recent(posts(s, d), _now(s, d)).select("post_id"),
    "posts_merged": merged,
    "posts_unseen": unseen,
    "fingerprint": fingerprints,
    "posts_first_of_fingerprint": lambda s, d: SO.first_of_each(_fp(posts(s, d))).select("post_id", "fp"),
    "author_cap": author_cap,
    "posts_admitted": admitted,
    "volume": lambda s, d: SO.volume(posts(s, d), _now(s, d)),
    "trends": trends,
    "posts_per_topic": topic_counts,
    "posts_total_day": lambda s, d: SO.total_day(posts(s, d), _now(s, d)),
    "social_page": lambda s, d: SO.page(posts(s, d), network="bluesky", lang="de").select("post_id", "network", "lang"),
    "social_page_topic": lambda s, d: SO.page(posts(s, d), topic="t3", before=F.lit("2024-01-20").cast("timestamp"), limit=40).select("post_id"),
    "posts_retained": lambda s, d: SO.retained(SO.recent(posts(s, d), _now(s, d)), "network", SO.KEEP_EACH).select("post_id", "network", "rank"),
    "posts_retained_topic": lambda s, d: SO.retained(SO.recent(posts(s, d), _now(s, d)).select("post_id", "ts", F.explode("topics").alias("topic")), "topic", SO.KEEP_EACH).select("post_id", "topic", "rank"),
    "posts_retained_overall": lambda s, d: SO.retained_overall(SO.recent(posts(s, d), _now(s, d))).select("post_id"),
    "hashtags": hashtags,
    "iso_time": iso_times,
    "fold": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.fold("text")).alias("folded")),
    "normalise_name": names,
    "slug": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(T.slug(T.fold("text"))).alias("slug")),
    "html_text": lambda s, d: table(s, d, "pages").select("page_id", T.plain_text("html").alias("text")),
    "similarity": similarity,
    "entities": entities,
    "entities_unresolved": lambda s, d: EN.unresolved(entities(s, d)),
    "team_identity": team_identity,
}

FOLD = "lower(strip_accents(text))"
NW = "[^\\p{L}\\p{N}_]"
_m = lambda txt, a: f"regexp_matches({txt}, concat('(^|{NW})', {a}, '($|{NW})'))"
DOCS = f"SELECT doc_id AS post_id, {FOLD} AS txt, replace(replace({FOLD}, 'scottish liga', ' '), 'then thing', ' ') AS txt_pl, CASE WHEN doc_id % 7 = 0 THEN 'f2' WHEN doc_id % 11 = 0 THEN 'f1' END AS via, text FROM documents"
FIXT = f"""SELECT post_id, topic, code FROM docs, aliases WHERE kind = 'fixture' AND {_m('txt', 'alias')} GROUP BY post_id, topic, code
   HAVING (bool_or(side = 'home' AND strong) AND bool_or(side = 'away' AND strong)) OR coalesce(bool_or(via = topic), FALSE)"""
PLACED = f"""SELECT post_id, topic FROM fixt UNION SELECT post_id, code FROM fixt UNION
   SELECT post_id, topic FROM docs, aliases WHERE kind = 'competition' AND {_m("CASE WHEN code = 'PL' THEN txt_pl ELSE txt END", 'alias')}"""
TOPIC = dict(aliases=A_SQL, docs=DOCS, fixt=FIXT, placed=PLACED)
WORDS = SO.FOOTBALL.replace("(?iu)", "").replace("\\b", "")
FB = f"regexp_matches(regexp_replace(text, '#\\w+', ' ', 'g'), '(?i)(^|{NW}){WORDS}($|{NW})')"
NOW = "(SELECT max(ts) FROM posts)"
P = "SELECT *, concat('@a', author_id) AS handle, ['all', concat('t', post_id % 5)] AS topics, CASE post_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de-AT' ELSE '' END AS lang FROM posts"
RECENT = f"SELECT * FROM p WHERE ts >= {NOW} - INTERVAL 72 HOUR"
_fpq = lambda text: f"sha1(concat_ws('|', network, handle, substr(trim(regexp_replace(regexp_replace(lower({text}), 'https?://\\S+', '', 'g'), '\\s+', ' ', 'g')), 1, 160)))"


def _cap(src):
    """The anchored windows, one recursion step per window."""
    return dict(
        src=src,
        win="""SELECT network, author_id, min(ts) AS start FROM src GROUP BY network, author_id
          UNION ALL SELECT * FROM (SELECT w.network, w.author_id, min(s.ts) AS start FROM win w JOIN src s ON s.network = w.network AND s.author_id = w.author_id AND s.ts >= w.start + INTERVAL 6 HOUR GROUP BY w.network, w.author_id, w.start)""",
        capped="""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY network, author_id, start ORDER BY ts, post_id) AS INT) AS n_in_window FROM (
          SELECT s.*, (SELECT max(start) FROM win w WHERE w.network = s.network AND w.author_id = s.author_id AND w.start <= s.ts) AS start FROM src s)) WHERE n_in_window <= 8""")


def sql(q, recursive=False, **extra):
    return with_views(q, "posts", recursive=recursive, p=P, recent=RECENT, **extra)


FIRSTS = f"SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY ts, post_id) AS r FROM (SELECT *, {_fpq('text')} AS fp FROM {{src}})) WHERE r = 1"
_norm = lambda c: f"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_tok = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
MENTIONS = """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'football-data' ELSE 'api-football' END AS feed, CAST(p_partkey AS VARCHAR) AS feed_id,
   CASE p_partkey % 4 WHEN 0 THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') WHEN 1 THEN replace(p_name, 'i', 'í')
     WHEN 2 THEN left(p_name, length(p_name) - 1) ELSE reverse(p_name) END AS name,
   CASE WHEN p_partkey % 5 = 0 THEN concat('199', p_size % 10) ELSE '' END AS birth_date, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE upper(p_brand) END AS team FROM part"""
CANDIDATES = """SELECT printf('c%07d', k) AS canonical_id, name, concat('199', size % 10) AS birth_date, CASE WHEN k % 17 = 0 THEN NULL ELSE brand END AS team FROM (
   SELECT p_name AS name, p_brand AS brand, min(p_partkey) AS k, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_name, p_brand)"""
CURATED = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EN.CURATED.items()) + ") t(feed_key, canonical_id)"


def _resolve(mentions, cands):
    return dict(
        m0=mentions, c0=cands, known=CURATED,
        m=f"SELECT *, {_norm('name')} AS norm, {_norm('team')} AS team_norm, {_tok(_norm('name'))} AS target FROM m0",
        c=f"SELECT *, {_norm('name')} AS norm, {_norm('team')} AS team_norm, {_tok(_norm('name'))} AS sorted_name FROM c0",
        best="""SELECT team_norm, target, arg_min(canonical_id, (-score, canonical_id)) AS fuzzy_id FROM (
          SELECT m.team_norm, m.target, c.canonical_id, jaro_winkler_similarity(m.target, c.sorted_name) AS score FROM (SELECT DISTINCT team_norm, target FROM m WHERE team_norm <> '') m
          JOIN c ON c.team_norm = m.team_norm OR c.team_norm = '') WHERE score >= 0.92 GROUP BY team_norm, target""",
        resolved="""SELECT feed, feed_id, coalesce(a, e, f) AS canonical_id, method, CASE method WHEN 'unresolved' THEN 0e0 WHEN 'fuzzy' THEN 0.8e0 ELSE 1e0 END AS confidence, method = 'unresolved' AS needs_review FROM (
          SELECT *, CASE WHEN a IS NOT NULL THEN 'alias' WHEN e IS NOT NULL THEN 'exact' WHEN f IS NOT NULL THEN 'fuzzy' ELSE 'unresolved' END AS method FROM (
            SELECT m.feed, m.feed_id, k.canonical_id AS a, x.canonical_id AS e, CASE WHEN m.team_norm <> '' THEN b.fuzzy_id END AS f FROM m
            LEFT JOIN known k ON k.feed_key = concat(m.feed, ':', m.feed_id)
            LEFT JOIN (SELECT norm, birth_date, min(canonical_id) AS canonical_id FROM c WHERE birth_date <> '' GROUP BY norm, birth_date) x ON x.norm = m.norm AND x.birth_date = m.birth_date
            LEFT JOIN best b ON b.team_norm = m.team_norm AND b.target = m.target))""")


def _w(q, **ctes):
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + " " + q


TEAM_M = "SELECT 'api-football' AS feed, CAST(s_suppkey AS VARCHAR) AS feed_id, replace(s_name, '#', ' ') AS name, '' AS birth_date, n_name AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey"
TEAM_C = "SELECT printf('t%06d', s_suppkey) AS canonical_id, s_name AS name, '' AS birth_date, lower(n_name) AS team FROM supplier JOIN nation ON s_nationkey = n_nationkey"
ORACLE = {
    "topics": _w("SELECT * FROM placed", **TOPIC),
    "football_relevance": _w(f"""SELECT post_id, {FB} OR post_id IN (SELECT post_id FROM placed) AS football FROM docs UNION ALL
       SELECT conv_id * 1000 + turn + 10000000, {FB} FROM conversations""", **TOPIC),
    "blocked_labels": "SELECT event_id, event_id % 3 = 1 AS blocked FROM events",
    "posts_recent": sql("SELECT post_id FROM recent"),
    "posts_merged": sql("SELECT post_id, concat('all,', CASE WHEN post_id % 4 = 0 THEN 'found-again,' ELSE '' END, 't', post_id % 5) AS topics FROM posts"),
    "posts_unseen": sql("SELECT post_id FROM posts WHERE post_id % 3 = 0"),
    "fingerprint": sql(f"SELECT post_id, {_fpq('''concat(text, '  https://x.example/', post_id)''')} AS fp FROM p"),
    "posts_first_of_fingerprint": sql(f"SELECT post_id, fp FROM ({FIRSTS.format(src='p')})"),
    "author_cap": sql("SELECT post_id, network, author_id, n_in_window, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS window_start FROM capped", True, **_cap("SELECT * FROM recent")),
    "posts_admitted": sql("SELECT post_id, network, author_id, n_in_window FROM capped", True, **_cap(FIRSTS.format(src="recent"))),
    "volume": sql(f"SELECT network, h AS hours_ago, count(*) AS posts FROM (SELECT network, CAST(ceil((epoch_us({NOW}) - epoch_us(ts)) / 3.6e9) - 1 AS INT) AS h FROM p) WHERE h BETWEEN 0 AND 11 GROUP BY network, h"),
    "trends": sql(f"SELECT tag, posts FROM (SELECT lower(substr(tag, 2)) AS tag, count(*) AS posts FROM p WHERE ts >= {NOW} - INTERVAL 6 HOUR GROUP BY 1) ORDER BY posts DESC, tag LIMIT 12"),
    "posts_per_topic": sql(f"SELECT topic, count(*) AS posts FROM (SELECT unnest(topics) AS topic FROM p WHERE ts >= {NOW} - INTERVAL 24 HOUR) GROUP BY topic"),
    "posts_total_day": sql(f"SELECT count(*) AS total_24h FROM p WHERE ts >= {NOW} - INTERVAL 24 HOUR"),
    "social_page": sql("SELECT post_id, network, lang FROM p WHERE network = 'bluesky' AND (lang = '' OR starts_with(lang, 'de')) ORDER BY ts DESC, post_id DESC LIMIT 30"),
    "social_page_topic": sql("SELECT post_id FROM p WHERE list_contains(topics, 't3') AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, post_id DESC LIMIT 40"),
    "posts_retained": sql("SELECT * FROM (SELECT post_id, network, CAST(row_number() OVER (PARTITION BY network ORDER BY ts DESC, post_id DESC) AS INT) AS rank FROM recent) WHERE rank <= 600"),
    "posts_retained_topic": sql("SELECT * FROM (SELECT post_id, topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY ts DESC, post_id DESC) AS INT) AS rank FROM (SELECT post_id, ts, unnest(topics) AS topic FROM recent)) WHERE rank <= 600"),
    "posts_retained_overall": sql("SELECT post_id FROM recent ORDER BY ts DESC, post_id DESC LIMIT 3000"),
    "hashtags": sql("SELECT post_id, array_to_string(list_sort([lower(substr(tag, 2)), concat('ab', post_id)]), ',') AS tags FROM p"),
    "iso_time": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(floor(epoch(ts)), 3) WHEN 1 THEN round(floor(epoch_us(ts) / 1000) / 1000 - 7200, 3) ELSE 0e0 END AS at FROM events""",
    "fold": f"SELECT doc_id, md5({FOLD}) AS folded FROM documents",
    "normalise_name": f"SELECT doc_id, md5({_norm('text')}) AS normalised, md5({_tok(_norm('text'))}) AS sorted_tokens FROM documents",
    "slug": f"SELECT doc_id, md5(regexp_replace({FOLD}, '[^a-z0-9]', '', 'g')) AS slug FROM documents",
    "similarity": _w("""SELECT name, b, round(jaro_winkler_similarity(name, b), 4) AS score FROM (SELECT name, left(name, length(name) - 1) AS b FROM c0
       UNION SELECT name, concat(reverse(substr(name, 1, 2)), substr(name, 3)) FROM c0 UNION SELECT * FROM (VALUES ('martha', 'marhta'), ('dwayne', 'duane'), ('dixon', 'dicksonx')))""", c0=CANDIDATES),
    "entities": _w("SELECT * FROM resolved", **_resolve(MENTIONS, CANDIDATES)),
    "entities_unresolved": _w("SELECT feed, count(*) AS unresolved FROM resolved WHERE needs_review GROUP BY feed", **_resolve(MENTIONS, CANDIDATES)),
    "team_identity": _w("SELECT * FROM resolved", **_resolve(TEAM_M, TEAM_C)),
}
