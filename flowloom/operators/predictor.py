"""Predictors of log changes: regressions on edge, node and neighbour features, and training loops around any fit.

No trained weights are published, so accuracies of other models can't be reproduced; the interface is the same:
fit or load, then predict with and without a shock.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Predictor(Protocol):
    def predict(self, edges: DataFrame) -> DataFrame:
        """edges with a column pred."""


def neighbour_means(edges: DataFrame, values: DataFrame, columns: list[str], rounds: int = 1) -> DataFrame:
    """year, node and, for each round and column, the mean over the nodes that supply it: join and aggregation, no gathering of neighbours."""
    out, now = values, values.select("year", "node", *columns)
    for k in range(1, rounds + 1):
        now = edges.select("year", "target", F.col("source").alias("node")).join(now, ["year", "node"]).groupBy("year", F.col("target").alias("node")).agg(*[F.avg(c).alias(c) for c in columns])
        out = out.join(now.select("year", "node", *[F.col(c).alias(f"{c}_hop{k}") for c in columns]), ["year", "node"], "left").fillna(0.0, [f"{c}_hop{k}" for c in columns])
    return out


class EdgeRegression:
    """Spark ML regression on columns of edges; gaps count as 0."""

    def __init__(self, columns: list[str], trees: bool = False, model: PipelineModel | None = None) -> None:
        self.columns, self.trees, self.model = columns, trees, model

    def filled(self, edges: DataFrame) -> DataFrame:
        return edges.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns})

    def fit(self, edges: DataFrame, target: str = "target_delta", seed: int = 0) -> EdgeRegression:
        vector = VectorAssembler(inputCols=[f"__{c}" for c in self.columns], outputCol="__features")
        model = GBTRegressor(featuresCol="__features", labelCol=target, predictionCol="pred", maxIter=20, seed=seed) if self.trees else LinearRegression(featuresCol="__features", labelCol=target, predictionCol="pred", regParam=1e-4)
        self.model = Pipeline(stages=[vector, model]).fit(self.filled(edges))
        return self

    def predict(self, edges: DataFrame) -> DataFrame:
        if self.model is None:
            raise ValueError("not fitted")
        return self.model.transform(self.filled(edges)).drop("__features", *[f"__{c}" for c in self.columns])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def load(self, path: str) -> EdgeRegression:
        self.model = PipelineModel.load(path)
        return self


#: Metrics of which more is better.
LARGER = ("r2", "direction_acc", "gain_dir_acc", "drop_dir_acc", "drop_f1")


def larger_is_better(metric: str) -> bool:
    return metric in LARGER


def better(metric: str, value: Column) -> Column:
    """A value that is larger the better: accuracies and r2 as they are, others negated."""
    return value if larger_is_better(metric) else -value


def train_on_plateau(fit, evaluate, rate: float, rounds: int = 20, patience: int = 15, flat: int = 5, factor: float = 0.5, least: float = 1e-6, metric: str = "r2") -> tuple[object, list[tuple[float, float]]]:
    """The best of the models that fit(rate, model before) gives round by round, and each round's (rate, value).

    After more than `flat` rounds without a better value the rate falls by factor, down to least; after `patience` rounds without one training ends.
    """
    sign = 1.0 if larger_is_better(metric) else -1.0
    best, top, model, idle, waited, seen = None, float("-inf"), None, 0, 0, []
    for _ in range(rounds):
        model = fit(rate, model)
        value = evaluate(model)
        seen.append((rate, value))
        if sign * value > top:
            best, top, idle, waited = model, sign * value, 0, 0
            continue
        idle, waited = idle + 1, waited + 1
        if idle >= patience:
            break
        if waited > flat:
            rate, waited = max(least, rate * factor), 0
    return best, seen


def train_with_patience(fit, evaluate, rates: list[float], patience: int = 2, metric: str = "r2") -> tuple[object, list[float]]:
    """The best of the models that fit(rate) gives one after the other; stops after `patience` without an improvement of evaluate(model)."""
    sign = 1.0 if larger_is_better(metric) else -1.0
    best, held, flat, seen = None, float("-inf"), 0, []
    for rate in rates:
        model = fit(rate)
        value = evaluate(model)
        seen.append(value)
        if sign * value > held:
            best, held, flat = model, sign * value, 0
        else:
            flat += 1
            if flat >= patience:
                break
    return best, seen
