"""Comparison of models: metrics by year and model, means, the best for each metric, formatted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalar import number_text, percent_text

METRICS = ("direction_acc", "drop_dir_acc", "gain_dir_acc", "pred_neg_pct", "fp_fn_ratio", "r2")
#: Metrics of which less is better.
LESS = ("rmse", "mae", "smape", "mse", "fp_fn_ratio")


def model_pivot(metrics: DataFrame, metric: str, models: list[str]) -> DataFrame:
    """year and the metric of each model."""
    return metrics.groupBy("year").pivot("model", models).agg(F.first(metric))


def model_means(metrics: DataFrame, names: tuple[str, ...] = METRICS) -> DataFrame:
    return metrics.groupBy("model").agg(*[F.avg(c).alias(c) for c in names])


def best_models(means: DataFrame, names: tuple[str, ...] = METRICS, less: tuple[str, ...] = LESS) -> DataFrame:
    """metric, model, value: the best model by each metric; of equals the first by name. NaN counts as missing."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value"), F.lit(-1.0 if c in less else 1.0).alias("way")) for c in names]))
    rows = means.select("model", each.alias("e")).select("model", "e.*").where("value IS NOT NULL")
    return rows.groupBy("metric").agg(F.min(F.struct((-F.col("value") * F.col("way")).alias("order"), F.col("model"), F.col("value"))).alias("b")).select("metric", "b.model", "b.value")


def metric_table(results: DataFrame) -> DataFrame:
    """Ten metrics of each loss as text, and the best epoch; N/A where one is missing. results: loss, test_metrics, best_epoch."""
    m = lambda c: F.col(f"test_metrics.{c}")
    percent = {c: percent_text(m(c)) for c in ("direction_acc", "gain_dir_acc", "drop_dir_acc", "target_neg_frac", "pred_neg_frac")}
    plain = {c: number_text(m(c)) for c in ("drop_f1", "r2", "rmse", "mae")}
    cells = percent | plain | {"smape": number_text(m("smape"), 1, "%"), "best_epoch": F.coalesce(F.col("best_epoch").cast("string"), F.lit("N/A"))}
    return results.select("loss", *[e.alias(c) for c, e in cells.items()])


def plotted(results: DataFrame) -> DataFrame:
    """The three metrics of the comparison chart, 0 where missing."""
    return results.select("loss", *[F.coalesce(F.nanvl(F.col(f"test_metrics.{c}"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in ("gain_dir_acc", "drop_dir_acc", "r2")])
