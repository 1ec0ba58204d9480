"""Geometry and match-clock expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the event model: a 120 x 80 pitch, the acting team attacks
# left to right; box, thirds and zones are given in that frame.
LENGTH, WIDTH = 120.0, 80.0
GOAL_X, GOAL_Y = 120.0, 40.0
BOX_X, BOX_LOW, BOX_HIGH = 102.0, 18.0, 62.0
FINAL_THIRD_X = 80.0
PRESS_ZONE_X = 48.0
DEEP_X = 72.0
BIG_CHANCE = 0.3
REGULATION = 90

# Names used in the event taxonomy.
GOAL = "Goal"
GOAL_DISALLOWED = "Goal (disallowed)"
RED_CARDS = ("Red Card", "Second Yellow")
ON_TARGET_RAW = ("Goal", "Saved", "Saved to Post")
ON_TARGET_EFFECTIVE = ON_TARGET_RAW + (GOAL_DISALLOWED,)
RESTARTS = ("Kick Off", "Goal Kick", "Throw-in", "Corner", "Free Kick")

#: Match order of events, and of corrections.
EVENT_ORDER = ("period", "minute", "second", "idx", "event_id")
CORRECTION_ORDER = ("period", "decided_at_minute", "correction_id")


def c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def distance_to_goal(x: str | Column, y: str | Column) -> Column:
    dx, dy = F.lit(GOAL_X) - c(x), F.lit(GOAL_Y) - c(y)
    return F.sqrt(dx * dx + dy * dy)


def in_box(x: str | Column, y: str | Column) -> Column:
    return (c(x) >= BOX_X) & c(y).between(BOX_LOW, BOX_HIGH)


def outside_box(x: str = "x", y: str = "y") -> Column:
    """Three-valued on purpose: an unknown x is kept only if y alone decides."""
    return ~in_box(x, y)


def progressive(x: str = "x", y: str = "y", end_x: str = "end_x", end_y: str = "end_y") -> Column:
    """A quarter nearer to goal, or ending in the box; false when unknown.

    Used by the match metrics: it needs both ends of the pass.
    """
    start, end = distance_to_goal(x, y), distance_to_goal(end_x, end_y)
    nearer = (start > 0) & (end <= 0.75 * start)
    known = c(x).isNotNull() & c(end_x).isNotNull() & c(end_y).isNotNull()
    return F.coalesce(known & (nearer | in_box(end_x, end_y)), F.lit(False))


def progressive_archive() -> Column:
    """The leaderboard's variant: only the end is required, and a pass that
    starts exactly on the goal centre is not special."""
    nearer = distance_to_goal("end_x", "end_y") <= 0.75 * distance_to_goal("x", "y")
    return c("end_x").isNotNull() & (nearer | in_box("end_x", "end_y"))


def is_shot() -> Column:
    return c("type") == "Shot"


def is_goal() -> Column:
    return (c("type") == "Shot") & (c("shot_outcome") == GOAL)


def is_own_goal() -> Column:
    return c("type") == "Own Goal Against"


def is_pass() -> Column:
    return c("type") == "Pass"


def complete() -> Column:
    return is_pass() & (c("pass_outcome") == "Complete")


def period_from_minute(minute: str | Column) -> Column:
    m = c(minute)
    return F.when(m <= 45, 1).when(m <= 90, 2).when(m <= 105, 3).otherwise(4)


def clock_text(period: str | Column = "period", minute: str | Column = "minute") -> Column:
    return F.when(c(period) == 5, F.lit("PENS")).otherwise(F.concat(c(minute).cast("string"), F.lit("'")))


def score_text(home: str | Column, away: str | Column) -> Column:
    return F.concat(c(home).cast("string"), F.lit("-"), c(away).cast("string"))


def event_key() -> Column:
    return F.struct(*EVENT_ORDER)
