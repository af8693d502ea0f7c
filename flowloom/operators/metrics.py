"""Metrics of predicted log changes, for each group, from one pass each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import dead_sign



def regression_metrics(rows: DataFrame, group: str = "year", p: str = "pred", t: str = "target_delta", value: str = "value_t", value_next: str = "value_t1") -> DataFrame:
    """mse, rmse, mae and r2 of the log changes; mape and smape of the values that they lead to, in percent."""
    e = F.col(t) - F.col(p)
    guess, true = F.expm1(F.log1p(value) + F.col(p)), F.col(value_next)
    miss = F.abs(guess - true)
    out = rows.groupBy(group).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("ss"), (F.count(t) * F.var_pop(t)).alias("total"),
        (F.avg(miss / F.greatest(F.abs(true), F.lit(1e-6))) * 100).alias("mape"), (F.avg(2 * miss / (F.abs(guess) + F.abs(true) + 1e-6)) * 100).alias("smape"),
    )
    return out.select(group, "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("ss", "total")).alias("r2"), "mape", "smape")


def direction_metrics(rows: DataFrame, eps: float = 1e-3, group: str = "year", p: str = "pred", t: str = "target_delta") -> DataFrame:
    """Shares of right signs, of all, gains and drops; precision, recall and F1 of drops."""
    right = dead_sign(F.col(p), eps) == dead_sign(F.col(t), eps)
    gain, fall = F.col(t) > eps, F.col(t) < -eps
    drop, said = dead_sign(F.col(t), eps) < 0, dead_sign(F.col(p), eps) < 0
    n = rows.groupBy(group).agg(
        F.avg(right.cast("double")).alias("direction_acc"), F.coalesce(F.avg(F.when(gain, right.cast("double"))), F.lit(0.0)).alias("gain_dir_acc"), F.coalesce(F.avg(F.when(fall, right.cast("double"))), F.lit(0.0)).alias("drop_dir_acc"),
        F.count_if(drop & said).alias("tp"), F.count_if(said).alias("said"), F.count_if(drop).alias("drops"),
    )
    n = n.withColumns({"drop_precision": F.col("tp") / (F.col("said") + 1e-8), "drop_recall": F.col("tp") / (F.col("drops") + 1e-8)})
    f1 = 2 * F.col("drop_precision") * F.col("drop_recall") / (F.col("drop_precision") + F.col("drop_recall") + 1e-8)
    return n.select(group, "direction_acc", "gain_dir_acc", "drop_dir_acc", "drop_precision", "drop_recall", f1.alias("drop_f1"))


def sign_distribution(rows: DataFrame, eps: float = 1e-3, group: str = "year", p: str = "pred", t: str = "target_delta") -> DataFrame:
    """Shares of negative, zero (at most eps) and positive targets and predictions."""
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(group).agg(*[x for name, c in (("target", F.col(t)), ("pred", F.col(p))) for x in (share(c < -eps).alias(f"{name}_neg_frac"), share(F.abs(c) <= eps).alias(f"{name}_zero_frac"), share(c > eps).alias(f"{name}_pos_frac"))])


def year_metrics(rows: DataFrame, eps: float = 1e-4, group: str = "year", p: str = "pred", t: str = "target_delta") -> DataFrame:
    """What model comparisons use: directions, errors, means, population deviations, percentages, and gains said for drops (fp) against drops said for gains (fn)."""
    a, b = F.col(p), F.col(t)
    right, e = (dead_sign(a, eps) == dead_sign(b, eps)).cast("double"), b - a
    pct = lambda c: F.avg(c.cast("double")) * 100
    out = rows.groupBy(group).agg(
        F.avg(right).alias("direction_acc"), F.coalesce(F.avg(F.when(b > eps, right)), F.lit(0.0)).alias("gain_dir_acc"), F.coalesce(F.avg(F.when(b < -eps, right)), F.lit(0.0)).alias("drop_dir_acc"),
        F.sum(e * e).alias("ss"), (F.count(b) * F.var_pop(b)).alias("total"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(b).alias("target_mean"), F.avg(a).alias("pred_mean"), F.stddev_pop(b).alias("target_std"), F.stddev_pop(a).alias("pred_std"),
        pct(b < -eps).alias("target_neg_pct"), pct(b > eps).alias("target_pos_pct"), pct(a < -eps).alias("pred_neg_pct"), pct(a > eps).alias("pred_pos_pct"),
        F.count_if((b < -eps) & (a > eps)).alias("false_positive"), F.count_if((b > eps) & (a < -eps)).alias("false_negative"), F.count(b).alias("n_samples"),
    )
    return out.withColumns({"r2": 1 - F.try_divide("ss", "total"), "fp_fn_ratio": F.col("false_positive") / (F.col("false_negative") + 1e-8)}).drop("ss", "total")
