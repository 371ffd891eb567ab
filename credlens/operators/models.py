"""Classifier, calibration and scoring (O-103..O-107, O-69, O-88).

Training runs on ``pyspark.ml`` (distributed L-BFGS over partitions); the
driver only holds model parameters (at most classes x ``max_features``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import rules


# ---------------------------------------------------------------------------
# split and labels
# ---------------------------------------------------------------------------
def with_split(df: DataFrame, key: str = "clean_text", buckets: int = 5, test_buckets: int = 1,
               col: str = "is_test") -> DataFrame:
    """Stable 80/20 split from an md5 bucket of the key: the same row lands
    in the same part on any cluster and after any recomputation (unlike
    ``randomSplit``, whose result depends on partitioning)."""
    return df.withColumn("_bucket", rules.hash_bucket(key, buckets)) \
             .withColumn(col, F.col("_bucket") < test_buckets)


def fit_label_indexer(df: DataFrame, label: str = "credibility_label") -> StringIndexerModel:
    """Classes in alphabetical order (index 0 = first name)."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc").fit(df)


# ---------------------------------------------------------------------------
# logistic regression
# ---------------------------------------------------------------------------
def logistic_regression(n_train: int, C: float = 1.0, max_iter: int = 1000,
                        features: str = "features", label: str = "label",
                        weight: str | None = None) -> LogisticRegression:
    """L2 logistic regression equal to C * sum(loss) + ||w||^2 / 2:
    Spark minimises mean(loss) + regParam / 2 * ||w||^2, so
    regParam = 1 / (C * n).  Intercept not penalised in either."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * max(1, n_train)), elasticNetParam=0.0,
                            standardization=False, family="auto", tol=1e-4)
    if weight:
        lr.setWeightCol(weight)
    return lr


def fit_classifier(train: DataFrame, C: float = 1.0, max_iter: int = 1000) -> LogisticRegressionModel:
    n = train.count()
    return logistic_regression(n, C, max_iter).fit(train)


# ---------------------------------------------------------------------------
# Platt calibration over k hash folds
# ---------------------------------------------------------------------------
@dataclass
class Calibrated:
    """k fold models with their sigmoids.  Two classes: (a, b) a fold, p(class 1)
    is the mean of sigmoid(a_k * margin_k + b_k) over the folds.  More classes:
    a sigmoid for each class against the rest, [(a, b), ...] a fold; a fold's
    values are divided by their sum, then the folds' mean is taken."""
    models: list = field(default_factory=list)
    platt: list = field(default_factory=list)

    @property
    def many(self) -> bool:
        return bool(self.platt) and isinstance(self.platt[0][0], (list, tuple))


def margin(model: LogisticRegressionModel, df: DataFrame, out: str = "margin") -> DataFrame:
    """Binary margin (raw score of class 1)."""
    m = model.setProbabilityCol("_p_tmp").setPredictionCol("_y_tmp").setRawPredictionCol("_raw_tmp")
    t = m.transform(df)
    return t.withColumn(out, vector_to_array("_raw_tmp")[1]).drop("_p_tmp", "_y_tmp", "_raw_tmp")


def fit_platt(scored: DataFrame, margin_col: str = "margin", label: str = "label",
              max_iter: int = 50, tol: float = 1e-10) -> tuple[float, float]:
    """Sigmoid fit p = 1 / (1 + exp(-(a * margin + b))) on smoothed targets:
    positives (N+ + 1) / (N+ + 2), negatives 1 / (N- + 2) (cross-entropy,
    unregularised).  Two parameters, so Newton steps: each step is one
    aggregate (gradient and 2x2 Hessian sums) over the fold's margins."""
    from pyspark import StorageLevel
    counts = scored.agg(F.sum(F.col(label)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = float(counts["pos"] or 0.0), float(counts["n"] - (counts["pos"] or 0.0))
    t = F.when(F.col(label) == 1, F.lit((pos + 1) / (pos + 2))).otherwise(F.lit(1 / (neg + 2)))
    data = scored.select(F.col(margin_col).alias("m"), t.alias("t")).persist(StorageLevel.MEMORY_AND_DISK)
    a, b = 0.0, float(np.log((neg + 1) / (pos + 1)) * -1.0)
    try:
        for _ in range(max_iter):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.col("m") + F.lit(b))))
            d = p - F.col("t")
            h = p * (F.lit(1.0) - p)
            r = data.agg(F.sum(d * F.col("m")).alias("ga"), F.sum(d).alias("gb"),
                         F.sum(h * F.col("m") * F.col("m")).alias("haa"), F.sum(h * F.col("m")).alias("hab"),
                         F.sum(h).alias("hbb")).first()
            haa, hab, hbb = r["haa"] + 1e-12, r["hab"], r["hbb"] + 1e-12
            det = haa * hbb - hab * hab
            if det <= 0:
                raise ValueError("the sigmoid cannot be fitted: all margins of the fold are equal")
            da = (hbb * r["ga"] - hab * r["gb"]) / det
            db = (haa * r["gb"] - hab * r["ga"]) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < tol:
                break
    finally:
        data.unpersist()
    return float(a), float(b)


def raw_margins(model: LogisticRegressionModel, df: DataFrame, out: str = "margins") -> DataFrame:
    """The raw score of every class, as an array."""
    m = model.setProbabilityCol("_p_tmp").setPredictionCol("_y_tmp").setRawPredictionCol("_raw_tmp")
    return m.transform(df).withColumn(out, vector_to_array("_raw_tmp")).drop("_p_tmp", "_y_tmp", "_raw_tmp")


def fit_platt_many(scored: DataFrame, classes: int, margins: str = "margins", label: str = "label",
                   max_iter: int = 50, tol: float = 1e-10) -> list[tuple[float, float]]:
    """A sigmoid for every class against the rest, targets as in ``fit_platt``.
    A Newton step of all classes together is one aggregate by class, whose
    sums (a row a class) are all that reaches the driver."""
    from pyspark import StorageLevel
    counts = {int(r[label]): r["n"] for r in scored.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = float(sum(counts.values()))
    pos = np.array([float(counts.get(c, 0)) for c in range(classes)])
    neg = total - pos

    def of(values) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("c"))
    data = scored.select(F.col(label).cast("int").alias("y"), F.posexplode(margins).alias("c", "m")) \
        .select("c", "m", F.when(F.col("y") == F.col("c"), of((pos + 1) / (pos + 2))).otherwise(of(1 / (neg + 2))).alias("t")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    a, b = np.zeros(classes), np.log((pos + 1) / (neg + 1))
    try:
        for _ in range(max_iter):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(of(a) * F.col("m") + of(b))))
            d, h = p - F.col("t"), p * (F.lit(1.0) - p)
            sums = np.zeros((classes, 5))
            for r in data.groupBy("c").agg(
                    F.sum(d * F.col("m")), F.sum(d), F.sum(h * F.col("m") * F.col("m")), F.sum(h * F.col("m")), F.sum(h)).collect():
                sums[r[0]] = r[1:]
            ga, gb, haa, hab, hbb = sums.T
            haa, hbb = haa + 1e-12, hbb + 1e-12
            det = haa * hbb - hab * hab
            # a class whose margins are all equal keeps its share as its value
            det = np.where(det > 0, det, np.inf)
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a - da, b - db
            if (np.abs(da) + np.abs(db)).max() < tol:
                break
    finally:
        data.unpersist()
    return [(float(x), float(y)) for x, y in zip(a, b, strict=True)]


#: Parts of a class that are dealt to the folds.
FOLD_PARTS = 1024


def with_folds(df: DataFrame, key: str, folds: int, label: str = "label") -> DataFrame:
    """``_fold`` of every row, stratified: each class is cut into parts by a
    hash of the key, and its parts go, largest first, to the fold that has the
    fewest of its rows.  Only counts (classes x parts) reach the driver."""
    parted = df.withColumn("_part", rules.hash_bucket(key, FOLD_PARTS))
    counts = parted.groupBy(label, "_part").agg(F.count("*").alias("n")).collect()
    load: dict = {}
    rows = []
    for r in sorted(counts, key=lambda r: (str(r[label]), -r["n"], r["_part"])):
        has = load.setdefault(r[label], [0] * folds)
        k = min(range(folds), key=lambda i: (has[i], i))
        has[k] += r["n"]
        rows.append((r[label], r["_part"], k))
    kind = df.schema[label].dataType.simpleString()
    dealt = df.sparkSession.createDataFrame(rows, f"{label} {kind}, _part int, _fold int")
    # at most classes x FOLD_PARTS rows
    return parted.join(F.broadcast(dealt), [label, "_part"]).drop("_part")


def fit_calibrated(train: DataFrame, key: str = "clean_text", folds: int = 3, C: float = 1.0,
                   max_iter: int = 1000) -> Calibrated:
    """k-fold Platt scaling: per (stratified) fold, fit on the other folds, fit
    the sigmoid, or one for each of several classes, on this fold's margins."""
    d = with_folds(train, key, folds)
    cal = Calibrated()
    for k in range(folds):
        fit_part = d.where(F.col("_fold") != k)
        held = d.where(F.col("_fold") == k)
        model = fit_classifier(fit_part, C, max_iter)
        cal.models.append(model)
        if model.numClasses > 2:
            cal.platt.append(fit_platt_many(raw_margins(model, held), model.numClasses))
        else:
            cal.platt.append(fit_platt(margin(model, held)))
    return cal


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibrated_probability(df: DataFrame, cal: Calibrated, out: str = "probabilities") -> DataFrame:
    """Mean over folds of the calibrated probabilities, an array by class."""
    if cal.many:
        return _calibrated_many(df, cal, out)
    parts = []
    cur = df
    for i, (model, (a, b)) in enumerate(zip(cal.models, cal.platt)):
        cur = margin(model, cur, f"_m{i}")
        parts.append(sigmoid(F.lit(a) * F.col(f"_m{i}") + F.lit(b)))
    p = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    cur = cur.withColumn("_p1", p)
    return cur.withColumn(out, F.array(1 - F.col("_p1"), F.col("_p1"))) \
              .drop("_p1", *[f"_m{i}" for i in range(len(parts))])


def _calibrated_many(df: DataFrame, cal: Calibrated, out: str) -> DataFrame:
    cur, names = df, [f"_m{i}" for i in range(len(cal.models))]
    for model, sigmoids, name in zip(cal.models, cal.platt, names, strict=True):
        cur = raw_margins(model, cur, name)
        each = F.array(*[sigmoid(F.lit(float(a)) * F.col(name)[c] + F.lit(float(b))) for c, (a, b) in enumerate(sigmoids)])
        # kept apart from its sum, which every class divides by
        cur = cur.withColumn(name, each).withColumn(
            f"{name}_sum", F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x))
    k = len(cal.platt[0])
    mean = F.array(*[sum((F.col(n)[c] / F.col(f"{n}_sum") for n in names), F.lit(0.0)) / F.lit(float(len(names)))
                     for c in range(k)])
    return cur.withColumn(out, mean).drop(*names, *[f"{n}_sum" for n in names])


def model_probability(df: DataFrame, model: LogisticRegressionModel, out: str = "probabilities") -> DataFrame:
    m = model.setProbabilityCol("_prob").setPredictionCol("plain_prediction").setRawPredictionCol("_raw")
    return m.transform(df).withColumn(out, vector_to_array("_prob")).drop("_prob", "_raw")


# ---------------------------------------------------------------------------
# decisions from probabilities
# ---------------------------------------------------------------------------
def best_class(probs: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def with_decision(df: DataFrame, classes: Sequence[str], probs: str = "probabilities",
                  threshold: float = DEFAULT.alert_threshold) -> DataFrame:
    """predicted index / label, confidence = max probability, alert."""
    names = F.array(*[F.lit(c) for c in classes])
    out = df.withColumn("pred_idx", best_class(F.col(probs)))
    out = out.withColumn("predicted_label", F.get(names, F.col("pred_idx")))
    out = out.withColumn("credibility_score", F.array_max(probs))
    return out.withColumn("alert", rules.alert("credibility_score", threshold))
