"""Classification metrics on (truth, prediction) tables (O-50)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(df: DataFrame, classes: Sequence[str], y: str = "y_true",
                     p: str = "y_pred") -> DataFrame:
    """Rows = true class, one count column per predicted class (zero-filled).
    The class list is the label encoder's (small, known), so the pivot runs
    no extra job."""
    return df.groupBy(y).pivot(p, list(classes)).count().na.fill(0, subset=list(classes))


def classification_report(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro and
    weighted averages (0 where a ratio has a zero denominator)."""
    pairs = df.groupBy(y, p).agg(F.count("*").alias("n"))
    by_true = pairs.groupBy(F.col(y).alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col(y) == F.col(p), F.col("n"))).alias("tp"))
    by_pred = pairs.groupBy(F.col(p).alias("label")).agg(F.sum("n").alias("npred"))
    cls = by_true.join(by_pred, "label", "full_outer").select(
        "label",
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("npred", F.lit(0)).alias("npred"),
        F.coalesce("support", F.lit(0)).alias("support"))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    m = cls.select("label", "tp", "support", prec.alias("precision"), rec.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
          .otherwise(F.lit(0.0))
    m = m.withColumn("f1_score", f1)
    rows = m.select("label", "precision", "recall", "f1_score", F.col("support").cast("long").alias("support"))
    total = F.sum("support")
    acc = m.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), (F.sum("tp") / total).alias("f1_score"),
                total.cast("long").alias("support"))
    macro = m.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                  total.cast("long").alias("support"))
    weighted = m.agg(F.lit("weighted avg").alias("label"),
                     (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                     (F.sum(F.col("f1_score") * F.col("support")) / total).alias("f1_score"),
                     total.cast("long").alias("support"))
    return rows.unionByName(acc).unionByName(macro).unionByName(weighted)
