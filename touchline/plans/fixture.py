"""Match data derived from the driver's tables.

The same SQL text runs in Spark and in the checking engine, so both sides start
from identical rows.  Real deployments read the archive (sources/archive.py)
instead; nothing here is needed by the operators.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from touchline.session import scratch, spread

MATCH_EVENTS = """
WITH base AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(floor(event_id / 500) AS INT) AS match_id,
         CAST(event_id % 500 AS INT) AS i
  FROM events
), m AS (
  SELECT *, CAST(floor(match_id / 20) AS INT) AS season_id, CAST(floor((match_id % 20) / 4) AS INT) AS home_id,
         CAST((match_id % 20) % 4 AS INT) AS a0
  FROM base
), t AS (
  SELECT *, a0 + CASE WHEN a0 >= home_id THEN 1 ELSE 0 END AS away_id,
         CASE WHEN match_id % 10 = 9 AND i BETWEEN 480 AND 498 THEN 5 WHEN i < 250 THEN 1 ELSE 2 END AS period
  FROM m
), e AS (
  SELECT *, CASE WHEN i = 0 THEN home_id WHEN i = 1 THEN away_id WHEN user_id % 2 = 0 THEN home_id ELSE away_id END AS team_id,
         CAST(CASE WHEN period = 1 THEN floor(i * 48 / 250) WHEN period = 2 THEN 45 + floor((i - 250) * 50 / 250) ELSE 120 + (i - 480) END AS INT) AS minute,
         CAST((i * 7) % 60 AS INT) AS second,
         CASE WHEN i IN (0, 1) THEN 'Starting XI' WHEN i IN (249, 499) THEN 'Half End' WHEN i = 250 THEN 'Half Start'
              WHEN period = 5 AND k % 2 = 0 THEN 'Shot'
              WHEN event_type = 'purchase' AND k < 25 THEN 'Shot'
              WHEN event_type = 'purchase' THEN 'Carry'
              WHEN event_type IN ('view', 'click') THEN 'Pass'
              WHEN event_type = 'error' AND k = 0 AND event_id % 5 = 0 THEN 'Own Goal Against'
              WHEN event_type = 'error' AND k < 30 THEN 'Foul Committed'
              WHEN event_type = 'error' AND k < 55 THEN 'Interception'
              WHEN event_type = 'error' AND k < 80 THEN 'Duel'
              WHEN event_type = 'error' THEN 'Bad Behaviour'
              WHEN event_type = 'signup' AND k = 50 THEN 'Substitution'
              WHEN event_type = 'signup' AND k < 40 THEN 'Dribble'
              ELSE 'Pressure' END AS type
  FROM t
), p AS (
  SELECT *, CAST(floor(user_id / 2) % 11 AS INT) AS slot FROM e
)
SELECT event_id, 11 AS competition_id, season_id, match_id, home_id, away_id, period, minute, second, i AS idx, type,
       team_id, concat('Team ', CAST(team_id AS VARCHAR(20))) AS team,
       team_id * 100 + slot AS player_id, concat('Player ', CAST(team_id * 100 + slot AS VARCHAR(20))) AS player,
       CASE WHEN slot = 0 THEN 'Goalkeeper' WHEN slot < 5 THEN 'Defender' WHEN slot < 8 THEN 'Midfielder' ELSE 'Forward' END AS position,
       CAST(floor(i / 6) AS INT) AS possession, event_id % 4 = 0 AS under_pressure,
       CAST((event_id * 37 % 1200) / 10.0 AS DOUBLE) AS x, CAST((event_id * 53 % 800) / 10.0 AS DOUBLE) AS y,
       CASE WHEN type IN ('Pass', 'Shot') THEN CAST((event_id * 71 % 1200) / 10.0 AS DOUBLE) END AS end_x,
       CASE WHEN type IN ('Pass', 'Shot') THEN CAST((event_id * 91 % 800) / 10.0 AS DOUBLE) END AS end_y,
       CASE WHEN type = 'Pass' THEN CASE WHEN k < 75 THEN 'Complete' ELSE 'Incomplete' END END AS pass_outcome,
       CASE WHEN type = 'Pass' THEN CASE WHEN k % 20 = 0 THEN 'Corner' WHEN k % 20 = 1 THEN 'Throw-in' END END AS pass_type,
       CASE WHEN type = 'Pass' AND k < 75 THEN team_id * 100 + CAST((floor(user_id / 2) + 1 + k % 3) % 11 AS INT) END AS pass_recipient_id,
       type = 'Pass' AND k IN (7, 8, 9) AS pass_shot_assist, type = 'Pass' AND k = 9 AS pass_goal_assist,
       CASE WHEN type = 'Shot' THEN least(0.95, value / 300) END AS shot_xg,
       CASE WHEN type = 'Shot' THEN CASE WHEN period = 5 AND k % 4 = 0 THEN 'Goal' WHEN period < 5 AND k < 3 THEN 'Goal'
            WHEN k % 3 = 0 THEN 'Saved' WHEN k % 3 = 1 THEN 'Off T' ELSE 'Blocked' END END AS shot_outcome,
       CASE WHEN type = 'Shot' THEN CASE WHEN period = 5 OR k IN (2, 12) THEN 'Penalty' ELSE 'Open Play' END END AS shot_type,
       CASE WHEN type = 'Shot' THEN CASE WHEN k % 4 = 3 THEN 'Head' WHEN k % 2 = 0 THEN 'Right Foot' ELSE 'Left Foot' END END AS shot_body_part,
       CASE WHEN type = 'Duel' THEN CASE WHEN k % 2 = 0 THEN 'Tackle' ELSE 'Aerial Lost' END END AS duel_type,
       CASE WHEN type = 'Bad Behaviour' AND k BETWEEN 80 AND 84 THEN 'Yellow Card' WHEN type = 'Bad Behaviour' AND k = 85 AND event_id % 2 = 0 THEN 'Red Card'
            WHEN type = 'Bad Behaviour' AND k = 86 AND event_id % 2 = 0 THEN 'Second Yellow' END AS card,
       CASE WHEN type = 'Substitution' THEN team_id * 100 + 11 + CAST(event_id % 5 AS INT) END AS sub_player_id,
       CAST(ts AS DATE) AS match_day
FROM p
"""

MATCHES = """
SELECT match_id, min(competition_id) AS competition_id, min(season_id) AS season_id, min(home_id) AS home_id, min(away_id) AS away_id,
       concat('Team ', CAST(min(home_id) AS VARCHAR(20))) AS home, concat('Team ', CAST(min(away_id) AS VARCHAR(20))) AS away,
       CAST(min(match_day) AS VARCHAR(10)) AS match_date, concat(CAST(12 + match_id % 9 AS VARCHAR(2)), ':00:00') AS kick_off,
       CASE WHEN match_id % 10 = 9 THEN 'Final' WHEN match_id % 7 = 3 THEN 'Semi-finals' ELSE 'Regular Season' END AS stage
FROM match_events GROUP BY match_id
"""

CORRECTIONS = """
SELECT concat('c1-', CAST(event_id AS VARCHAR(20))) AS correction_id, match_id, event_id AS supersedes,
       CASE WHEN shot_outcome = 'Goal' AND event_id % 3 = 0 THEN 'disallow' WHEN shot_outcome = 'Goal' THEN 'reassign' ELSE 'amend' END AS kind,
       CASE WHEN shot_outcome = 'Goal' AND event_id % 3 = 0 THEN 'Offside in the build-up' WHEN shot_outcome = 'Goal' THEN 'Scorer reviewed' ELSE 'Chance value revised' END AS reason,
       CASE WHEN shot_outcome = 'Goal' AND event_id % 3 = 0 THEN 'VAR' ELSE 'feed_correction' END AS authority,
       period, minute + 2 + CAST(event_id % 3 AS INT) AS decided_at_minute, event_id % 2 = 0 AS synthesised,
       CASE WHEN shot_outcome = 'Goal' AND event_id % 3 <> 0 THEN CAST(event_id % 55 AS INT) END AS new_player_id,
       CASE WHEN shot_outcome = 'Goal' AND event_id % 3 <> 0 THEN concat('Player ', CAST(event_id % 55 AS VARCHAR(20))) END AS new_player,
       CAST(NULL AS INT) AS new_team_id, CAST(NULL AS VARCHAR(20)) AS new_team, CAST(NULL AS INT) AS new_minute,
       CASE WHEN shot_outcome <> 'Goal' THEN CAST(0.05 + shot_xg * 0.5 AS DOUBLE) END AS new_xg
FROM match_events WHERE type = 'Shot' AND period < 5 AND ((shot_outcome = 'Goal' AND event_id % 3 < 2) OR (shot_outcome <> 'Goal' AND event_id % 7 = 0))
UNION ALL
SELECT concat('c2-', CAST(event_id AS VARCHAR(20))), match_id, event_id, 'reinstate', 'Goal stands after review', 'official_review', period, minute + 6, FALSE,
       CAST(NULL AS INT), CAST(NULL AS VARCHAR(20)), CAST(NULL AS INT), CAST(NULL AS VARCHAR(20)), CAST(NULL AS INT), CAST(NULL AS DOUBLE)
FROM match_events WHERE type = 'Shot' AND period < 5 AND shot_outcome = 'Goal' AND event_id % 6 = 0
"""

#: Events with what only the deep feed sends: ends of carries, and the pass that made a shot.
BALL_EVENTS = """
SELECT match_id, event_id, period, minute, second, idx, type, team_id, team, player_id, player, possession, x, y,
       CASE WHEN type = 'Carry' AND event_id % 50 <> 0 THEN CAST((event_id * 71 % 1200) / 10.0 AS DOUBLE) ELSE end_x END AS end_x,
       CASE WHEN type = 'Carry' AND event_id % 50 <> 0 THEN CAST((event_id * 91 % 800) / 10.0 AS DOUBLE) ELSE end_y END AS end_y,
       pass_outcome, shot_xg, shot_outcome, shot_type,
       CASE WHEN type = 'Shot' AND event_id % 17 = 0 THEN -event_id WHEN type = 'Shot' AND event_id % 3 <> 0 THEN max(CASE WHEN type = 'Pass' AND pass_outcome = 'Complete' THEN event_id END)
            OVER (PARTITION BY match_id, team_id, period ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END AS shot_key_pass_id
FROM match_events
"""

#: Players in view of every second pass, ten to fourteen of them.
FRAMES = """
SELECT e.match_id, e.event_id, s.slot, CAST((e.event_id * 29 + s.slot * 137) % 1200 / 10.0 AS DOUBLE) AS x, CAST((e.event_id * 43 + s.slot * 211) % 800 / 10.0 AS DOUBLE) AS y,
       s.slot % 3 = 0 AS teammate, s.slot = 4 AS keeper
FROM match_events e JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12), (13)) AS s(slot) ON s.slot < 10 + e.event_id % 5
WHERE e.type = 'Pass' AND e.event_id % 2 = 0
"""

RESULTS_REGION = """
WITH places AS (
  SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos,
         count(*) OVER (PARTITION BY n_regionkey) AS n
  FROM nation
)
SELECT o.o_orderkey * 25 + a.n_nationkey AS match_id, CAST(year(o.o_orderdate) AS INT) AS season_id, o.o_orderdate AS kickoff,
       h.n_nationkey AS home_id, a.n_nationkey AS away_id, h.n_regionkey AS region_id,
       CAST((o.o_orderkey * 7 + o.o_custkey) % 5 AS INT) AS home_goals,
       CAST((o.o_orderkey * 11 + o.o_custkey * 3) % 4 AS INT) AS away_goals
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN places h ON h.n_nationkey = c.c_nationkey
JOIN places a ON a.n_regionkey = h.n_regionkey AND a.pos = (h.pos + 1 + o.o_orderkey % (h.n - 1)) % h.n
"""

POSTS = """
SELECT event_id AS post_id,
       CASE user_id % 4 WHEN 0 THEN 'bluesky' WHEN 1 THEN 'mastodon' WHEN 2 THEN 'reddit' ELSE 'x' END AS network,
       CAST(user_id % 8 AS INT) AS author_id,
       concat('#', event_type, regexp_extract(props, '([0-9])[^0-9]*$', 1)) AS tag,
       concat(event_type, ' ', regexp_extract(props, '([0-9]+)', 1)) AS text,
       ts
FROM events
"""

#: name -> (SQL, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "match_events": (MATCH_EVENTS, ("events",)),
    "matches": (MATCHES, ("match_events",)),
    "corrections": (CORRECTIONS, ("match_events",)),
    "results_region": (RESULTS_REGION, ("orders", "customer", "nation")),
    "posts": (POSTS, ("events",)),
    "ball_events": (BALL_EVENTS, ("match_events",)),
    "frames": (FRAMES, ("match_events",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view derived from driver tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    def derive() -> DataFrame:
        sql, needs = VIEWS[name]
        frames = {n: table(spark, sf_dir, n) for n in needs}
        if needs == ("events",):
            frames["events"] = spread(frames["events"], "event_id")
        for n in needs:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
        return spark.sql(sql, **frames)

    return once(spark, sf_dir, name, derive)


@contextmanager
def _compiled(spark: SparkSession):
    """For a write of very many expressions: those that give methods the JVM would only interpret (above 8000 bytes) are generated in parts."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(spark: SparkSession, sf_dir: str, name: str, derive) -> DataFrame:
    """Derive a table the first time this application asks for it.

    It is written to the shared folder and scanned from there, like any archive:
    pruned columns, pushed filters, and no lineage to lose with an executor.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch(spark, name)
        df = derive()
        with _compiled(spark):
            df.write.parquet(path)
        _written[key] = (path, df.schema)
    path, schema = _written[key]
    return spark.read.schema(schema).parquet(path)


_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def with_views(query: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """The checking SQL: `query` behind the CTEs it needs.

    `extra` adds further CTEs (name=SQL) after the views, in the order given.
    """
    order: list[str] = []

    def add(n: str) -> None:
        for dep in VIEWS[n][1]:
            if dep in VIEWS:
                add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][0]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {query}"


def half_up(expr: str, places: int) -> str:
    """The SQL twin of functions.numeric.half_up."""
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{places} + 0.5) / 1e{places})"


def micro(expr: str) -> str:
    """The SQL twin of functions.numeric.micro."""
    return f"CAST(round(CAST({expr} AS DOUBLE) * 1e6) AS BIGINT)"


def long(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"
