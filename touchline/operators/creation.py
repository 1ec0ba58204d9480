"""Expected assists: the worth of a shot goes to the pass that made it.

The shot names its pass, which came earlier in the same match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.functions import pitch as P


def created_shots(effective: DataFrame) -> DataFrame:
    """Shots in play that name a pass, with the player who made it.

    Returns `match_id`, `event_id`, `pass_id`, `passer_id`, `passer`, `xg_micro`, `goal`.  If
    the log doesn't hold the pass, `passer_id` is null: the shot is kept, and counted
    as nobody's.  Works on effective events, so a revised xG or a disallowed goal counts
    as it stands now.
    """
    shots = effective.filter(P.is_shot() & F.col("shot_key_pass_id").isNotNull() & (F.col("period") < 5)).select(
        "match_id", "event_id", F.col("shot_key_pass_id").alias("pass_id"), F.coalesce(N.micro("shot_xg"), F.lit(0).cast("long")).alias("xg_micro"), F.coalesce(P.is_goal(), F.lit(False)).alias("goal"))
    passes = effective.filter(P.is_pass()).select("match_id", F.col("event_id").alias("pass_id"), F.col("player_id").alias("passer_id"), F.col("player").alias("passer"))
    return shots.join(passes, ["match_id", "pass_id"], "left").select("match_id", "event_id", "pass_id", "passer_id", "passer", "xg_micro", "goal")


def players(created: DataFrame) -> DataFrame:
    """Per passer: shots made, assists, and xA, the xG of these shots."""
    return created.filter("passer_id IS NOT NULL").groupBy("passer_id").agg(
        F.count(F.lit(1)).alias("chances"), N.count_if(F.col("goal")).alias("assists"), N.from_micro(F.sum("xg_micro"), 4).alias("xa")).withColumnRenamed("passer_id", "player_id")


def balance(created: DataFrame) -> DataFrame:
    """One row: xG of all shots that name a pass, what of it players got, what is nobody's."""
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("xg_micro"))), F.lit(0)).cast("long")
    known = F.col("passer_id").isNotNull()
    return created.agg(N.count_if(known).alias("attributed"), N.count_if(~known).alias("unattributed"), total(F.lit(True)).alias("xg_micro"), total(known).alias("xa_micro"), total(~known).alias("nobody_micro"))
