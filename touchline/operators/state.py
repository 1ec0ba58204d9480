"""Match state from the corrected log: score, statistics, clock, goals, cards.

Events are reduced to one row per match and team before they meet the two
sides, so nothing match-wide is ever gathered from raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P

#: Types that count as defensive on the score page.
DEFENSIVE = ("Pressure", "Interception", "Clearance", "Block", "Duel", "Foul Committed", "Ball Recovery")


def discover_sides(events: DataFrame) -> DataFrame:
    """Home and away without metadata: the first two teams to name a line-up,
    else the first two seen in match order."""
    key = P.event_key()
    teams = events.filter(F.col("team_id").isNotNull()).groupBy("match_id", "team_id").agg(
        F.min(F.when(F.col("type") == "Starting XI", key)).alias("xi"), F.min(key).alias("seen"))
    w = Window.partitionBy("match_id").orderBy(F.col("xi").isNull(), F.coalesce("xi", "seen"))
    two = teams.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    return two.groupBy("match_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("team_id"))).alias("home_id"),
        F.max(F.when(F.col("n") == 2, F.col("team_id"))).alias("away_id"))


def sides_for(events: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Metadata where there is some, discovery otherwise."""
    if matches is not None:
        return matches.select("match_id", "home_id", "away_id")
    return discover_sides(events)


def _order() -> Column:
    return F.struct("period", "order_minute", "second", "idx", "event_id")


def team_counters(corrected: DataFrame) -> DataFrame:
    """One pass over the corrected events: counters per match and team."""
    n = N.count_if
    has_team = F.col("team_id").isNotNull()
    pens = P.is_shot() & (F.col("period") == 5)
    play = ~F.coalesce(pens, F.lit(False))
    stands = ~F.col("disallowed")
    shot = P.is_shot() & play
    goal = shot & (F.col("shot_outcome") == P.GOAL) & has_team & stands
    own = P.is_own_goal() & has_team & stands
    card = F.col("card").isNotNull() & has_team & stands & play
    red = F.col("card").isin(*P.RED_CARDS)
    first_half = F.col("period") == 1
    marker = ((F.col("type") == "Half End") & first_half) | (F.col("type") == "Half Start")
    return corrected.groupBy("match_id", "team_id").agg(
        n(has_team).alias("touches"),
        n(shot).alias("shots"),
        F.coalesce(F.sum(F.when(shot, N.micro("shot_xg"))), F.lit(0)).alias("xg_micro"),
        n(shot & F.col("shot_outcome").isin(*P.ON_TARGET_RAW)).alias("on_target"),
        n(goal).alias("goals"), n(goal & first_half).alias("goals_ht"),
        n(own).alias("own"), n(own & first_half).alias("own_ht"),
        n(pens & has_team).alias("pens"),
        n(pens & has_team & (F.col("shot_outcome") == P.GOAL)).alias("pens_scored"),
        n(card & ~red).alias("yellows"), n(card & red).alias("reds"),
        n(P.is_pass() & play).alias("passes"), n(P.complete() & play).alias("passes_completed"),
        n(P.is_pass() & play & (F.col("pass_type") == "Corner")).alias("corners"),
        n(P.is_pass() & play & (F.col("end_x") >= P.FINAL_THIRD_X)).alias("final_third_passes"),
        n((F.col("type") == "Foul Committed") & play).alias("fouls"),
        n(F.col("type").isin(*DEFENSIVE) & play & (F.col("x") >= P.PRESS_ZONE_X)).alias("defensive_actions_opp_half"),
        F.max(F.struct(_order().alias("o"), "period", "minute", "second", "type")).alias("last"),
        F.max(F.when(marker, F.struct(_order().alias("o"), "type"))).alias("marker"),
    )


STATS = ("shots", "on_target", "passes", "passes_completed", "final_third_passes",
         "defensive_actions_opp_half", "corners", "fouls", "yellows", "reds")


def match_state(corrected: DataFrame, sides: DataFrame) -> DataFrame:
    """The projected state of every match, one wide row each.

    An own goal is credited to the other side.  Events without a team, or with a
    third one, fall into the away statistics as on the score page.
    """
    t = team_counters(corrected).join(sides, "match_id", "left")
    home = F.coalesce(F.col("team_id") == F.col("home_id"), F.lit(False))
    away = F.coalesce(F.col("team_id") == F.col("away_id"), F.lit(False))

    def total(c: str, cond: Column | None = None) -> Column:
        return F.sum(F.col(c) if cond is None else F.when(cond, F.col(c)).otherwise(0))

    per_side = []
    for c in STATS:
        per_side += [total(c, home).alias(f"home_{c}"), total(c, ~home).alias(f"away_{c}")]
    m = t.groupBy("match_id").agg(
        F.max("home_id").alias("home_id"), F.max("away_id").alias("away_id"),
        (total("goals", home) + total("own", ~home)).alias("home_score"),
        (total("goals", away) + total("own", home)).alias("away_score"),
        (total("goals_ht", home) + total("own_ht", ~home)).alias("home_half_time"),
        (total("goals_ht", ~home) + total("own_ht", home)).alias("away_half_time"),
        (total("pens") > 0).alias("shootout"),
        total("pens_scored", home).alias("home_shootout"), total("pens_scored", away).alias("away_shootout"),
        total("reds", home).alias("home_red_cards"), total("reds", away).alias("away_red_cards"),
        *per_side,
        total("xg_micro", home).alias("home_xg_micro"), total("xg_micro", ~home).alias("away_xg_micro"),
        N.ratio(total("touches", home), total("touches"), 0.5).alias("possession_home"),
        F.max("last").alias("last"), F.max("marker").alias("marker"),
    )
    ended = (F.col("last.type") == "Half End") & (F.col("last.period") >= 2)
    status = (F.when(ended, "finished").when(F.col("marker.type") == "Half End", "half_time").otherwise("live"))
    scoreline = F.when(
        (F.col("home_shootout") > 0) | (F.col("away_shootout") > 0),
        F.concat(P.score_text("home_score", "away_score"), F.lit(" ("),
                 P.score_text("home_shootout", "away_shootout"), F.lit(" on penalties)")),
    ).otherwise(P.score_text("home_score", "away_score"))
    return m.withColumns({
        "home_xg": N.from_micro("home_xg_micro"), "away_xg": N.from_micro("away_xg_micro"),
        "home_pass_accuracy": N.ratio("home_passes_completed", "home_passes", 0.0),
        "away_pass_accuracy": N.ratio("away_passes_completed", "away_passes", 0.0),
        "period": F.col("last.period"), "minute": F.col("last.minute"), "second": F.col("last.second"),
        "status": status, "scoreline": scoreline,
        "clock": P.clock_text(F.col("last.period"), F.col("last.minute")),
    }).drop("last", "marker", "home_xg_micro", "away_xg_micro")


def scheduled(matches: DataFrame, state: DataFrame) -> DataFrame:
    """States for every known match: those without events are scheduled, 0-0."""
    out = matches.select("match_id").join(state, "match_id", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("scheduled"))).fillna(0, ["home_score", "away_score"])


def goals(corrected: DataFrame, sides: DataFrame) -> DataFrame:
    """Every goal, the disallowed ones included and flagged."""
    scored = corrected.filter(
        F.col("team_id").isNotNull() & ((P.is_goal() & (F.col("period") != 5)) | P.is_own_goal())
    ).drop("home_id", "away_id").join(sides, "match_id", "left")
    own = P.is_own_goal()
    scored = scored.filter(~own | (F.col("home_id").isNotNull() & F.col("away_id").isNotNull()))
    credited = F.when(~own, F.col("team_id")).when(F.col("team_id") == F.col("home_id"), F.col("away_id")).otherwise(F.col("home_id"))
    return scored.select(
        "match_id", "event_id", "period", "minute", "second", "order_minute", "idx",
        credited.alias("team_id"), (credited == F.col("home_id")).alias("home"),
        F.coalesce("player", F.when(own, F.lit("Own goal")).otherwise(F.lit("Unknown"))).alias("scorer"),
        F.col("player_id").alias("scorer_id"),
        F.when(~own, F.col("shot_xg")).alias("xg"),
        F.when(own, F.lit("Own Goal")).otherwise(F.col("shot_type")).alias("shot_type"),
        own.alias("own_goal"), "disallowed", "correction_reason", "correction_authority", "corrected_at",
        "correction_synthesised",
    )


def cards(corrected: DataFrame, sides: DataFrame) -> DataFrame:
    """Cards that stand.  A second yellow is a red."""
    pens = P.is_shot() & (F.col("period") == 5)
    shown = corrected.filter(F.col("card").isNotNull() & F.col("team_id").isNotNull() & ~F.col("disallowed") & ~pens)
    return shown.drop("home_id", "away_id").join(sides, "match_id", "left").select(
        "match_id", "event_id", "period", "minute", "team_id", (F.col("team_id") == F.col("home_id")).alias("home"),
        F.coalesce("player", F.lit("")).alias("player"), "card", F.col("card").isin(*P.RED_CARDS).alias("is_red"))


def with_names(per_match: DataFrame, matches: DataFrame) -> DataFrame:
    """Attach the match's metadata and team names to a per-match result."""
    extra = [c for c in matches.columns if c == "match_id" or c not in per_match.columns]
    return per_match.join(matches.select(*extra), "match_id")


def score_changes(events: DataFrame, corrections: DataFrame, sides: DataFrame) -> DataFrame:
    """The score as it stood after every minute in which it changed.

    The all-minutes form of "what was the score at 43'?": each goal adds one
    when it is scored, and each correction moves it between sides or off the
    board when it is decided.  Only score *changes* are accumulated, at most one
    row per match and minute.
    """
    scoring = events.filter(
        F.col("team_id").isNotNull() & ((P.is_goal() & (F.col("period") != 5)) | P.is_own_goal())
    ).select("match_id", "event_id", "team_id", P.is_own_goal().alias("own"), F.struct("period", "minute").alias("at"))
    # per event and minute only the last ruling and last team count
    key = F.struct(*P.CORRECTION_ORDER)
    ruling = F.col("kind").isin("disallow", "reinstate")
    moved = F.col("kind").isin("reassign", "amend") & F.col("new_team_id").isNotNull()
    steps = corrections.groupBy(
        "match_id", F.col("supersedes").alias("event_id"), F.struct("period", F.col("decided_at_minute").alias("minute")).alias("at")
    ).agg(F.max_by(F.col("kind") == "disallow", F.when(ruling, key)).alias("off"),
          F.max_by("new_team_id", F.when(moved, key)).alias("new_team"))
    of_goal = Window.partitionBy("match_id", "event_id").orderBy("at")
    upto = of_goal.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumns({"off": F.coalesce(F.last("off", True).over(upto), F.lit(False)),
                               "new_team": F.last("new_team", True).over(upto)})
    after = scoring.join(steps.withColumnRenamed("at", "decided"), ["match_id", "event_id"]).select(
        "match_id", "event_id", "own", "decided", "off", F.coalesce("new_team", "team_id").alias("team_id"),
        F.lag("off", 1, False).over(Window.partitionBy("match_id", "event_id").orderBy("decided")).alias("was_off"),
        F.coalesce(F.lag(F.coalesce("new_team", "team_id")).over(Window.partitionBy("match_id", "event_id").orderBy("decided")),
                   "team_id").alias("was_team"),
        F.greatest("at", "decided").alias("at"))

    def credit(df: DataFrame, team: str, weight: Column) -> DataFrame:
        mine = F.col(team) == F.col("home_id")
        return df.select("match_id", "at",
                         F.when(F.col("own") != mine, weight).otherwise(0).alias("dh"),
                         F.when((F.col("own") & mine) | (~F.col("own") & (F.col(team) == F.col("away_id"))), weight).otherwise(0).alias("da"))

    s = scoring.join(sides, "match_id")
    a = after.join(sides, "match_id")
    moves = (credit(s, "team_id", F.lit(1))
             .unionByName(credit(a, "was_team", F.when(F.col("was_off"), 0).otherwise(-1)))
             .unionByName(credit(a, "team_id", F.when(F.col("off"), 0).otherwise(1))))
    per_minute = moves.groupBy("match_id", "at").agg(F.sum("dh").alias("dh"), F.sum("da").alias("da"))
    run = Window.partitionBy("match_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return per_minute.select("match_id", "at.period", "at.minute", F.sum("dh").over(run).alias("home"), F.sum("da").over(run).alias("away"),
                             "dh", "da").filter("dh <> 0 OR da <> 0").drop("dh", "da")


def score_at(changes: DataFrame, period: int, minute: int) -> DataFrame:
    """The last change at or before a moment, per match."""
    upto = (F.col("period") < period) | ((F.col("period") == period) & (F.col("minute") <= minute))
    return changes.filter(upto).groupBy("match_id").agg(
        F.max_by("home", F.struct("period", "minute")).alias("home"), F.max_by("away", F.struct("period", "minute")).alias("away"))


def ever(changes: DataFrame, home: int, away: int) -> DataFrame:
    """Matches that stood at this score at any time, and when first."""
    return changes.filter((F.col("home") == home) & (F.col("away") == away)).groupBy("match_id").agg(
        F.min(F.struct("period", "minute")).alias("at")).select("match_id", "at.period", "at.minute")


def archived_score_at(goal_rows: DataFrame, period: int, minute: int) -> DataFrame:
    """For finished matches: goals so far by final verdict."""
    upto = (F.col("period") < period) | ((F.col("period") == period) & (F.col("minute") <= minute))
    stands = ~F.col("disallowed")
    return goal_rows.groupBy("match_id").agg(
        N.count_if(upto & stands & F.col("home")).alias("home"), N.count_if(upto & stands & ~F.col("home")).alias("away"),
        N.count_if(upto).alias("goals_so_far"))
