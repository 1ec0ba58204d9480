"""Registered queries: features, labels, Elo, split, model and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import elo as EL
from touchline.operators import features as FT
from touchline.operators import model as MO
from touchline.operators import standings as SD
from touchline.plans import corrections as C
from touchline.plans import tables as TB
from touchline.plans.fixture import half_up, long, micro, table, with_views
from touchline.session import cut


def increments(spark, d):
    return FT.minute_increments(C.effective(spark, d), C.sides(spark, d))


def state(spark, d):
    return FT.minute_state(increments(spark, d), C.sides(spark, d))


def match_elo(spark, d):
    return EL.causal_elo(TB._match_results(spark, d))


def features(spark, d, elo=None):
    extra = None
    if elo is not None:
        m = table(spark, d, "matches").select("match_id", FT.neutral(F.col("competition_id")).alias("is_neutral_venue"))
        extra = m.join(elo, "match_id", "left")
    return FT.feature_rows(state(spark, d), extra)


def printed(rows):
    return rows.withColumns({"xg_diff": F.round("xg_diff", 6), "possession_diff": _r("possession_diff", 4)})


def _r(c, n):
    from touchline.functions.numeric import half_up as h

    return h(c, n)


def training_set(spark, d, elo=None):
    """Features, label and date of every match-minute."""
    lab = FT.labels(increments(spark, d), C.sides(spark, d))
    dates = table(spark, d, "matches").select("match_id", "match_date")
    return features(spark, d, elo).join(lab, "match_id").join(dates, "match_id")


def split(spark, d):
    return FT.date_split(training_set(spark, d))


def split_summary(spark, d):
    return split(spark, d).groupBy("cutoff", "is_train").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("match_id").alias("matches"))


def series(spark, d):
    """Stand-in probability series, the input of every query checked by SQL."""
    return MO.stand_in_series(features(spark, d))


def scored(spark, d):
    t = training_set(spark, d)
    return t.select("match_id", "minute", "label", *MO.stand_in(F.col("score_diff"), F.col("minute").cast("double")))


def elo_region(spark, d):
    r = table(spark, d, "results_region")
    return EL.causal_elo(r, "region_id", ("kickoff", "match_id")).withColumn("elo_diff", F.round("elo_diff", 4))


def elo_region_steps(spark, d):
    """The same ratings worked through in small steps."""
    r = table(spark, d, "results_region")
    return EL.causal_elo(r, "region_id", ("kickoff", "match_id"), step_rows=max(r.count() // 15, 1)).withColumn("elo_diff", F.round("elo_diff", 4))


def form(spark, d):
    r = TB._match_results(spark, d).select("match_id", "match_date", "home_id", "away_id", "home_goals", "away_goals")
    return EL.latest_first(r, SD.by_team(r))


def _split_frames(spark, d):
    s = cut(FT.date_split(training_set(spark, d, match_elo(spark, d))), "training")
    return s.filter("is_train"), s.filter("NOT is_train"), s


def model_logistic(spark, d):
    train, test, _ = _split_frames(spark, d)
    return MO.evaluate("logistic", MO.Logistic().fit(train).predict(test))


def model_boosted(spark, d):
    train, test, _ = _split_frames(spark, d)
    # The last days of the training part stop the boosting; the test part is not seen before it is scored.
    fit_on = FT.date_split(train.drop("cutoff", "is_train")).withColumn("is_valid", ~F.col("is_train"))
    m = MO.Boosted().fit(fit_on)
    return MO.evaluate("boosted", m.predict(test))


def model_series(spark, d):
    train, _, s = _split_frames(spark, d)
    return MO.series(MO.Logistic().fit(train), s.drop("label", "match_date", "cutoff", "is_train"))


QUERIES = {
    "minute_increments": increments,
    "minute_state": state,
    "possession_rolling": lambda s, d: features(s, d).select("match_id", "minute", _r("possession_diff", 4).alias("possession_diff")),
    "minute_features": lambda s, d: printed(features(s, d)),
    "labels": lambda s, d: FT.labels(increments(s, d), C.sides(s, d)),
    "training_set": lambda s, d: printed(training_set(s, d)),
    "split": split_summary,
    "elo": elo_region,
    "elo_in_steps": elo_region_steps,
    "elo_match_features": lambda s, d: features(s, d, match_elo(s, d)).select("match_id", "minute", F.round("elo_diff", 4).alias("elo_diff"), "is_neutral_venue"),
    "form": form,
    "probability_series": series,
    "brier": lambda s, d: MO.brier(scored(s, d)),
    "log_loss": lambda s, d: MO.log_loss(scored(s, d)),
    "reliability": lambda s, d: MO.reliability(scored(s, d)),
    "calibration": lambda s, d: MO.calibration(scored(s, d)),
    "baseline_prior": lambda s, d: MO.class_prior(split(s, d).filter("is_train")).select(*[F.round(c, 6).alias(c) for c in MO.CLASSES]),
    "baseline_score_decides": lambda s, d: MO.score_decides(split(s, d).filter("is_train")).select("sign", *[F.round(c, 6).alias(c) for c in MO.CLASSES]),
    "baseline_scores": lambda s, d: MO.baseline_scores(split(s, d)),
    "model_logistic": model_logistic,
    "model_boosted": model_boosted,
    "model_series": model_series,
}

n = C.n
HOME, AWAY = "team_id = home_id", "team_id <> home_id"
INC = f"""SELECT match_id, least(minute, 90) AS minute,
  {n(f"({HOME} AND type = 'Shot' AND shot_outcome = 'Goal') OR ({AWAY} AND type = 'Own Goal Against')")} AS home_goals,
  {n(f"({AWAY} AND type = 'Shot' AND shot_outcome = 'Goal') OR ({HOME} AND type = 'Own Goal Against')")} AS away_goals,
  """ + ", ".join(
    f"""{long(f"coalesce(sum({micro('shot_xg')}) FILTER (WHERE {t}), 0)")} AS {s}_xg_micro, {n(f"{t} AND type = 'Shot'")} AS {s}_shots,
  {n(f"{t} AND shot_outcome IN ('Goal', 'Saved', 'Saved to Post', 'Goal (disallowed)')")} AS {s}_on_target,
  {n(f"{t} AND card IN ('Red Card', 'Second Yellow')")} AS {s}_reds, {n(t)} AS {s}_touches""" for s, t in (("home", HOME), ("away", AWAY))
) + " FROM effective WHERE period <= 2 GROUP BY match_id, least(minute, 90)"
_cols = [f"{s}_{c}" for c in FT.SERIES for s in ("home", "away")]
MSTATE = f"""SELECT match_id, minute, {', '.join(long(f'coalesce(sum({c}) OVER b, 0)') + f' AS {c}' for c in _cols)},
  {long('coalesce(sum(home_touches) OVER t, 0)')} AS home_recent, {long('coalesce(sum(away_touches) OVER t, 0)')} AS away_recent
  FROM (SELECT match_id, CAST(minute AS INT) AS minute FROM matches, range(0, 91) r(minute)) LEFT JOIN inc USING (match_id, minute)
  WINDOW b AS (PARTITION BY match_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         t AS (PARTITION BY match_id ORDER BY minute ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
FEAT = f"""SELECT match_id, minute, CAST(90 - minute AS DOUBLE) AS minutes_remaining, CAST(home_goals - away_goals AS DOUBLE) AS score_diff,
  CAST(home_reds - away_reds AS DOUBLE) AS red_card_diff, round((home_xg_micro - away_xg_micro) / 1e6, 6) AS xg_diff, CAST(home_shots - away_shots AS DOUBLE) AS shots_diff,
  CAST(home_on_target - away_on_target AS DOUBLE) AS shots_on_target_diff,
  {half_up('coalesce((home_recent - away_recent) / nullif(home_recent + away_recent, 0), 0)', 4)} AS possession_diff,
  CAST(0 AS DOUBLE) AS elo_diff, CAST(1 AS DOUBLE) AS is_neutral_venue FROM mstate"""
LABEL = "SELECT match_id, CASE WHEN h > a THEN 0 WHEN h = a THEN 1 ELSE 2 END AS label FROM (SELECT match_id, sum(home_goals) AS h, sum(away_goals) AS a FROM inc GROUP BY match_id)"
TRAIN = "SELECT f.*, label, match_date FROM feat f JOIN label USING (match_id) JOIN (SELECT match_id, match_date FROM matches) USING (match_id)"
SPLIT = """SELECT *, match_date < cutoff AS is_train FROM train, (SELECT min(match_date) AS cutoff FROM (
   SELECT match_date, sum(count(*)) OVER (ORDER BY match_date) AS upto, sum(count(*)) OVER () AS total FROM train GROUP BY match_date) WHERE upto > floor(total * 0.8))"""
_L = "score_diff * (1e0 + minute / 45e0) * 0.4e0"
_Z = f"exp({_L} + 0.1e0) AS zh, exp(0.2e0 - abs({_L}) * 0.5e0) AS zd, exp(-({_L}) - 0.1e0) AS za"
SERIES = f"""SELECT match_id, minute, {half_up('zh / (zh + zd + za)', 4)} AS p_home, {half_up('zd / (zh + zd + za)', 4)} AS p_draw, {half_up('za / (zh + zd + za)', 4)} AS p_away
  FROM (SELECT match_id, minute, {_Z} FROM feat)"""
SCORED = "SELECT s.*, label FROM series s JOIN label USING (match_id)"
CTES = dict(inc=INC, mstate=MSTATE, feat=FEAT, label=LABEL, train=TRAIN, split=SPLIT, series=SERIES, scored=SCORED)
SQ = " + ".join(f"({c} - CASE WHEN label = {i} THEN 1e0 ELSE 0e0 END) * ({c} - CASE WHEN label = {i} THEN 1e0 ELSE 0e0 END)" for i, c in enumerate(MO.CLASSES))
NL = "-ln(greatest(CASE label WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1e-12))"


def avg(expr, places):
    return half_up(f"sum({micro(expr)}) / count(*) / 1e6", places)


def sql(query, recursive=False, **extra):
    return with_views(query, "match_events", "corrections", "matches", "results_region", recursive=recursive,
                      verdicts=C.VERDICTS, corrected=C.CORRECTED, effective=C.EFFECTIVE, **CTES, **extra)


def elo_ctes(src, comp, order):
    return dict(
        seq=f"SELECT *, row_number() OVER (PARTITION BY {comp} ORDER BY {order}) AS seq FROM {src}",
        elo=f"""SELECT DISTINCT {comp} AS comp, CAST(0 AS BIGINT) AS seq, CAST(MAP {{}} AS MAP(INTEGER, DOUBLE)) AS r, CAST(NULL AS BIGINT) AS match_id, CAST(0 AS DOUBLE) AS elo_diff FROM {src}
          UNION ALL SELECT comp, seq, map_concat(r, MAP {{home_id: rh + mv, away_id: ra - mv}}), match_id, rh - ra FROM (
            SELECT *, 24e0 * sqrt(greatest(abs(hg - ag), 1)) * ((CASE WHEN hg > ag THEN 1e0 WHEN hg = ag THEN 0.5e0 ELSE 0e0 END) - 1e0 / (1e0 + pow(10e0, (ra - rh) / 400e0))) AS mv FROM (
              SELECT e.comp, s.seq, e.r, s.match_id, s.home_id, s.away_id, s.home_goals AS hg, s.away_goals AS ag,
                coalesce(e.r[s.home_id], 1500e0) AS rh, coalesce(e.r[s.away_id], 1500e0) AS ra FROM elo e JOIN seq s ON s.{comp} = e.comp AND s.seq = e.seq + 1))""")


ELO_REGION = with_views("SELECT match_id, round(elo_diff, 4) AS elo_diff FROM elo WHERE seq > 0", "results_region", recursive=True,
                        **elo_ctes("results_region", "region_id", "kickoff, match_id"))
FREQ = ", ".join(f"round(count(*) FILTER (WHERE label = {i}) / count(*), 6) AS {c}" for i, c in enumerate(MO.CLASSES))
RAW = ", ".join(f"count(*) FILTER (WHERE label = {i}) / count(*) AS {c}" for i, c in enumerate(MO.CLASSES))
SIGNS = f"SELECT s.sign, coalesce(p_home, 1 / 3) AS p_home, coalesce(p_draw, 1 / 3) AS p_draw, coalesce(p_away, 1 / 3) AS p_away FROM (VALUES (-1), (0), (1)) s(sign) LEFT JOIN (SELECT CAST(sign(score_diff) AS INT) AS sign, {RAW} FROM split WHERE is_train GROUP BY 1) USING (sign)"
EDGE = " + ".join(f"(CASE WHEN p >= {i} * 0.1e0 THEN 1 ELSE 0 END)" for i in range(1, 10))
ORACLE = {
    "minute_increments": sql("SELECT * FROM inc"),
    "minute_state": sql("SELECT * FROM mstate"),
    "possession_rolling": sql("SELECT match_id, minute, possession_diff FROM feat"),
    "minute_features": sql("SELECT * FROM feat"),
    "labels": sql("SELECT * FROM label"),
    "training_set": sql("SELECT * FROM train"),
    "split": sql("SELECT cutoff, is_train, count(*) AS rows, count(DISTINCT match_id) AS matches FROM split GROUP BY ALL"),
    "elo": ELO_REGION,
    "elo_in_steps": ELO_REGION,
    "elo_match_features": sql("SELECT f.match_id, f.minute, round(e.elo_diff, 4) AS elo_diff, CAST(0 AS DOUBLE) AS is_neutral_venue FROM feat f JOIN elo e USING (match_id)", True,
                              state=C.STATE, results_match=TB.RESULTS_MATCH, **elo_ctes("results_match", "competition_id", "match_date, kick_off, match_id")),
    "form": sql("""SELECT team_id, CAST(n AS INT) AS n, match_id, match_date, opponent_id, CASE WHEN gf > ga THEN 'W' WHEN gf = ga THEN 'D' ELSE 'L' END AS result, concat(gf, '-', ga) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS n FROM (
          SELECT match_id, match_date, home_id AS team_id, away_id AS opponent_id, home_goals AS gf, away_goals AS ga FROM results_match UNION ALL
          SELECT match_id, match_date, away_id, home_id, away_goals, home_goals FROM results_match)) WHERE n <= 5""", state=C.STATE, results_match=TB.RESULTS_MATCH),
    "probability_series": sql("SELECT * FROM series"),
    "brier": sql(f"SELECT {avg(SQ, 4)} AS brier, count(*) AS n FROM scored"),
    "log_loss": sql(f"SELECT {avg(NL, 4)} AS log_loss, count(*) AS n FROM scored"),
    "reliability": sql(f"""SELECT {half_up('bin / 10e0', 3)} AS bin_lo, {half_up('(bin + 1) / 10e0', 3)} AS bin_hi, {avg('p', 4)} AS predicted, {avg('t', 4)} AS observed, count(*) AS n FROM (
        SELECT p, t, {EDGE} AS bin FROM (""" + " UNION ALL ".join(f"SELECT {c} AS p, CASE WHEN label = {i} THEN 1 ELSE 0 END AS t FROM scored" for i, c in enumerate(MO.CLASSES)) + ")) GROUP BY bin"),
    "calibration": sql(f"SELECT concat(lo, '-', lo + 15) AS bucket, {avg(SQ, 4)} AS brier, count(*) AS n FROM (SELECT *, CAST(floor(minute / 15) * 15 AS INT) AS lo FROM scored WHERE minute < 90) GROUP BY lo"),
    "baseline_prior": sql(f"SELECT {FREQ} FROM split WHERE is_train"),
    "baseline_score_decides": sql("SELECT sign, round(p_home, 6) AS p_home, round(p_draw, 6) AS p_draw, round(p_away, 6) AS p_away FROM signs", signs=SIGNS),
    "baseline_scores": sql(f"SELECT 'score_decides' AS model, {avg(SQ, 4)} AS brier, {avg(NL, 4)} AS log_loss FROM (SELECT label, g.* FROM split s JOIN signs g ON g.sign = sign(s.score_diff) WHERE NOT is_train) UNION ALL SELECT 'prior', {avg(SQ, 4)}, {avg(NL, 4)} FROM (SELECT label, p.* FROM split, (SELECT {RAW} FROM split WHERE is_train) p WHERE NOT is_train)", signs=SIGNS),
}
