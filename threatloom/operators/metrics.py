"""Evaluation metrics as aggregates over (label, prediction[, score]) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatloom.session import materialize


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """total / spam / ham of a 0-1 label."""
    spam = F.coalesce(F.sum(F.col(label)), F.lit(0)).cast("long")
    return df.agg(F.count("*").alias("total"), spam.alias("spam"), (F.count("*") - spam).alias("ham"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = F.col(label), F.col(prediction)
    return df.agg(
        _count((y == 0) & (p == 0)).alias("tn"), _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"), _count((y == 1) & (p == 1)).alias("tp"),
    )


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall, f1 of class 1."""
    return metrics_of(confusion(df, label, prediction))


def metrics_of(matrix: DataFrame) -> DataFrame:
    """The four metrics of a confusion row."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return matrix.select(
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(df: DataFrame, names: tuple[str, str] = ("Legitimate", "Phishing"),
                          label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per class, accuracy, macro avg and weighted avg, as name, precision, recall, f1, support."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp

    def row(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("name"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.cast("long").alias("support"),
        )

    neg = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp), tn + fp)
    pos = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    accuracy = _ratio(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(neg[:3], pos[:3], strict=True)]
    weighted = [_ratio(a * neg[3] + b * pos[3], total) for a, b in zip(neg[:3], pos[:3], strict=True)]
    rows = F.array(
        row(names[0], *neg), row(names[1], *pos), row("accuracy", accuracy, accuracy, accuracy, total),
        row("macro avg", *macro, total), row("weighted avg", *weighted, total),
    )
    return confusion(df, label, prediction).select(F.inline(rows))


AUC_RANGES = 256


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``roc_auc``: exact, ties count one half; null when a class is empty.

    Rows are pre-aggregated per distinct score (a score shared by a third of
    all rows is one row afterwards).  The running count of negatives is then
    taken in two levels: score ranges cut at approximate quantiles of the
    distinct scores, so no range is large, plus the broadcast totals of the
    ranges below (256 rows).  The cut points only place the work; the result
    is exact wherever they fall.
    """
    groups = materialize(df.groupBy(F.col(score).alias("__x")).agg(
        _count(F.col(label) == 1).alias("__p"), _count(F.col(label) == 0).alias("__q")
    ), "scores")
    quantiles = [F.lit(i / AUC_RANGES) for i in range(1, AUC_RANGES)]
    cuts = groups.agg(F.percentile_approx("__x", F.array(*quantiles)).alias("c")).first()["c"] or []
    inner = sorted(set(cuts))
    place = F.size(F.filter(F.array(*[F.lit(x) for x in inner]), lambda x: x < F.col("__x"))) if inner else F.lit(0)
    placed = groups.withColumns({"__b": place})
    whole = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    # at most 256 rows reach this unpartitioned window
    below = placed.groupBy("__b").agg(F.sum("__q").alias("__n")).select(
        "__b", F.coalesce(F.sum("__n").over(whole), F.lit(0)).alias("__base")
    )
    local = Window.partitionBy("__b").orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("__p") * (
        F.col("__base") + F.coalesce(F.sum("__q").over(local), F.lit(0)) + F.col("__q") / 2
    )
    return (
        placed.join(F.broadcast(below), "__b")
        .withColumns({"__area": area})
        .agg(F.sum("__area").alias("a"), F.sum("__p").alias("p"), F.sum("__q").alias("q"))
        .select((F.col("a") / F.nullif(F.col("p") * F.col("q"), F.lit(0))).alias("roc_auc"))
    )
