"""Win probability: training, prediction, evaluation."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import numeric as N
from touchline.operators.features import FEATURES

CLASSES = ("p_home", "p_draw", "p_away")
BINS = 10


def stand_in(score_diff: Column, minute: Column) -> list[Column]:
    """A closed-form probability for checks that must not depend on training."""
    lead = score_diff * (1.0 + minute / 45.0) * 0.4
    z = [F.exp(lead + 0.1), F.exp(0.2 - F.abs(lead) * 0.5), F.exp(-lead - 0.1)]
    total = z[0] + z[1] + z[2]
    return [N.half_up(v / total, 4).alias(c) for v, c in zip(z, CLASSES)]


def stand_in_series(features: DataFrame) -> DataFrame:
    return features.select("match_id", "minute", *stand_in(F.col("score_diff"), F.col("minute").cast("double")))


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        rows.withColumn("minute", F.col("minute").cast("double")))


class Logistic:
    """Multinomial logistic regression; the L2 weight is that of C = 1 on the
    summed loss, hence 1/n here."""

    def fit(self, train: DataFrame) -> "Logistic":
        t = _vector(train)
        n = max(t.count(), 1)
        self.model = LogisticRegression(family="multinomial", regParam=1.0 / n, maxIter=200, standardization=True).fit(t)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        return self.model.transform(_vector(rows)).select(*rows.columns, *[p[i].alias(c) for i, c in enumerate(CLASSES)])


class Boosted:
    """One boosted-tree model per class, scores renormalised to sum to one.

    Rows flagged `is_valid` stop the boosting early.
    """

    def __init__(self, rounds: int = 60, depth: int = 5, rate: float = 0.1, min_leaf: int = 400) -> None:
        self.args = dict(maxIter=rounds, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, subsamplingRate=0.8, seed=7)

    def fit(self, train: DataFrame) -> "Boosted":
        t = _vector(train)
        valid = {"validationIndicatorCol": "is_valid"} if "is_valid" in train.columns else {}
        self.models = [
            GBTClassifier(labelCol="target", **self.args, **valid).fit(t.withColumn("target", (F.col("label") == i).cast("double")))
            for i in range(len(CLASSES))]
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        out = _vector(rows)
        for i, m in enumerate(self.models):
            m = m.copy()
            m.setProbabilityCol(f"pr{i}").setRawPredictionCol(f"raw{i}").setPredictionCol(f"pred{i}")
            out = m.transform(out)
        raw = [vector_to_array(f"pr{i}")[1] for i in range(len(CLASSES))]
        total = raw[0] + raw[1] + raw[2]
        return out.select(*rows.columns, *[(r / total).alias(c) for r, c in zip(raw, CLASSES)])


def series(model, features: DataFrame) -> DataFrame:
    """The printed series: probabilities to four places, for all matches."""
    return model.predict(features).select("match_id", "minute", *[N.half_up(c, 4).alias(c) for c in CLASSES])


# ---- evaluation


def _truth(i: int) -> Column:
    return F.when(F.col("label") == i, 1.0).otherwise(0.0)


def squared_error() -> Column:
    parts = [(F.col(c) - _truth(i)) * (F.col(c) - _truth(i)) for i, c in enumerate(CLASSES)]
    return parts[0] + parts[1] + parts[2]


def neg_log() -> Column:
    p = F.element_at(F.array(*CLASSES), F.col("label") + 1)
    return -F.log(F.greatest(p, F.lit(1e-12)))


def brier(scored: DataFrame, places: int = 4) -> DataFrame:
    return scored.agg(N.exact_avg(squared_error(), places).alias("brier"), F.count(F.lit(1)).alias("n"))


def log_loss(scored: DataFrame, places: int = 4) -> DataFrame:
    return scored.agg(N.exact_avg(neg_log(), places).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def reliability(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Predicted against observed, the three classes pooled; last bin closed."""
    edges = [i * (1.0 / bins) for i in range(bins + 1)]
    each = scored.select(F.inline(F.array(*[F.struct(F.col(c).alias("p"), _truth(i).alias("t")) for i, c in enumerate(CLASSES)])))
    bin_no = F.lit(0)
    for e in edges[1:-1]:
        bin_no = bin_no + F.when(F.col("p") >= e, 1).otherwise(0)
    b = each.groupBy(bin_no.alias("bin")).agg(N.exact_avg("p", 4).alias("predicted"), N.exact_avg("t", 4).alias("observed"), F.count(F.lit(1)).alias("n"))
    return b.select(N.half_up(F.col("bin") / float(bins), 3).alias("bin_lo"), N.half_up((F.col("bin") + 1) / float(bins), 3).alias("bin_hi"), "predicted", "observed", "n")


def calibration(scored: DataFrame) -> DataFrame:
    """Brier by quarter of an hour; minute 90 belongs to no bucket."""
    lo = (F.floor(F.col("minute") / 15) * 15).cast("int")
    return scored.filter(F.col("minute") < 90).groupBy(lo.alias("lo")).agg(
        N.exact_avg(squared_error(), 4).alias("brier"), F.count(F.lit(1)).alias("n")).select(
        F.concat(F.col("lo").cast("string"), F.lit("-"), (F.col("lo") + 15).cast("string")).alias("bucket"), "brier", "n")


def class_prior(train: DataFrame) -> DataFrame:
    """Frequency of each result."""
    n = F.count(F.lit(1))
    return train.agg(*[(N.count_if(F.col("label") == i) / n).alias(c) for i, c in enumerate(CLASSES)])


def _sign() -> Column:
    return F.signum("score_diff").cast("int").alias("sign")


def score_decides(train: DataFrame) -> DataFrame:
    """Result frequencies by who is ahead; uniform where nothing was seen."""
    n = F.count(F.lit(1))
    seen = train.groupBy(_sign()).agg(*[(N.count_if(F.col("label") == i) / n).alias(c) for i, c in enumerate(CLASSES)])
    all_signs = train.sparkSession.range(3).select((F.col("id") - 1).cast("int").alias("sign"))
    return all_signs.join(seen, "sign", "left").fillna(1.0 / 3, list(CLASSES))


def baseline_scores(split: DataFrame) -> DataFrame:
    """Brier and log loss of both baselines, from counts of the test rows alone.

    `split`: label, score_diff, is_train.
    """
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    counts = test.groupBy(_sign(), "label").agg(F.count(F.lit(1)).alias("k"))
    by_sign = counts.join(score_decides(train), "sign").withColumn("model", F.lit("score_decides"))
    # the prior beside each sign: totals over the three rows of counts
    seen = train.groupBy(_sign()).agg(*[N.count_if(F.col("label") == i).alias(f"n{i}") for i in range(len(CLASSES))])
    signs = train.sparkSession.range(3).select((F.col("id") - 1).cast("int").alias("sign")).join(seen, "sign", "left").fillna(0)
    three = Window.partitionBy(F.lit(1))
    total = F.sum(F.col("n0") + F.col("n1") + F.col("n2")).over(three)
    prior = signs.select("sign", *[(F.sum(f"n{i}").over(three) / total).alias(c) for i, c in enumerate(CLASSES)])
    by_prior = counts.join(prior, "sign").withColumn("model", F.lit("prior"))
    cols = ["model", "label", "k", *CLASSES]
    both = by_sign.select(*cols).unionByName(by_prior.select(*cols))
    weighted = lambda e: N.half_up(F.sum(N.micro(e) * F.col("k")) / F.sum("k") / float(N.MICRO), 4)
    return both.groupBy("model").agg(weighted(squared_error()).alias("brier"), weighted(neg_log()).alias("log_loss"))


def evaluate(name: str, scored: DataFrame) -> DataFrame:
    return scored.agg(F.lit(name).alias("model"), N.exact_avg(squared_error(), 4).alias("brier"), N.exact_avg(neg_log(), 4).alias("log_loss"),
                      F.count(F.lit(1)).alias("n"))
