"""Binary classification metrics in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_binary(c: Column) -> Column:
    return F.coalesce(c.isin(0, 1), F.lit(False))


def confusion(df: DataFrame, *by: str) -> DataFrame:
    gt, pred = F.col("gt_label"), F.col("finally_result")
    valid = df.filter(is_binary(gt) & is_binary(pred))
    return valid.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if((gt == 1) & (pred == 1)).alias("tp"),
        F.count_if((gt == 0) & (pred == 1)).alias("fp"),
        F.count_if((gt == 1) & (pred == 0)).alias("fn"),
        F.count_if((gt == 0) & (pred == 0)).alias("tn"),
    )


def _share(n: Column, d: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0)), 4)


def metrics(df: DataFrame, *by: str) -> DataFrame:
    """Sample_Count, Accuracy, F1, Precision, Recall; undefined shares are 0; no row without valid labels."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = confusion(df, *by).filter("n > 0")
    return out.select(*by, F.col("n").alias("Sample_Count"), _share(tp + tn, F.col("n")).alias("Accuracy"), _share(2 * tp, 2 * tp + fp + fn).alias("F1"), _share(tp, tp + fp).alias("Precision"), _share(tp, tp + fn).alias("Recall"))
