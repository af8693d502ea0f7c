"""Linear fits under direction-aware losses, by iteratively reweighted least squares.

A loss of p against t has the same slope as a square with weight slope / (2 (p - t)); with these weights at the fit so
far, the next fit solves weighted normal equations, whose sums come from one pass over the rows. As a sign's step can
make a full move worse, the loss is measured at several parts of the move, all in one more pass, and the best is taken.
The driver sees sums only, one for each pair of columns.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators import losses


def weight(name: str, p: Column, t: Column, alpha: float = 1.0, gamma: float | None = None, boost: float = 1.5) -> Column:
    """The weight of a row's square: the loss's slope over that of the square; 1 for mse."""
    e, wrong = p - t, losses.wrong(p, t)
    if name == "mse":
        return F.lit(1.0)
    if name == "sign_corrected":
        return F.exp(alpha * wrong)
    if name == "focal":
        g = 1.0 if gamma is None else gamma
        size = F.lit(1.0) if g == 1.0 else F.pow(F.greatest(F.abs(e), F.lit(1e-8)), F.lit(g - 1))
        return (1 + g) / 2 * size * (1 + wrong * (boost - 1))
    if name == "hybrid":
        g, q = (1.5 if gamma is None else gamma), e * e + 1e-8
        return F.exp(alpha * wrong) * (F.pow(q, F.lit((g - 1) / 2)) + (g - 1) / 2 * e * e * F.pow(q, F.lit((g - 3) / 2)))
    raise ValueError(f"no loss {name!r}")


class Reweighted:
    """A linear model of columns of rows, fitted under a loss; gaps count as 0. coefficients: the constant's first."""

    def __init__(self, columns: list[str], loss: str = "mse", ridge: float = 0.0, **params: float) -> None:
        self.columns, self.loss, self.ridge, self.params = columns, loss, ridge, params
        self.coefficients: list[float] | None = None
        self.history: list[float] = []

    def terms(self) -> list[Column]:
        return [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns]]

    def value(self, coefficients) -> Column:
        return reduce(lambda a, b: a + b, [x * F.lit(float(c)) for x, c in zip(self.terms(), coefficients, strict=True)])

    def solved(self, rows: DataFrame, target: str, w: Column) -> np.ndarray | None:
        """The solution of the weighted normal equations; None without rows."""
        x, n = self.terms(), len(self.columns) + 1
        pairs = [(i, j) for i in range(n) for j in range(i, n)]
        sums = [F.sum(w * x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs] + [F.sum(w * x[i] * F.col(target)).alias(f"r{i}") for i in range(n)]
        one = rows.agg(*sums).first()
        if one["r0"] is None:
            return None
        a = np.zeros((n, n))
        for i, j in pairs:
            a[i, j] = a[j, i] = one[f"s{i}_{j}"]
        a += self.ridge * np.diag([0.0] + [1.0] * (n - 1))
        return np.linalg.lstsq(a, np.array([one[f"r{i}"] for i in range(n)]), rcond=None)[0]

    def losses_at(self, rows: DataFrame, target: str, tries: list[np.ndarray]) -> list[float]:
        """The mean loss at each of several fits, from one pass."""
        own = {k: v for k, v in self.params.items() if v is not None}
        one = rows.agg(*[F.avg(losses.loss(self.loss, self.value(c), F.col(target), **own)).alias(f"l{i}") for i, c in enumerate(tries)]).first()
        return [one[f"l{i}"] for i in range(len(tries))]

    def fit(self, rows: DataFrame, target: str = "target_delta", rounds: int = 10, least: float = 1e-9, parts: tuple[float, ...] = (1.0, 0.5, 0.25, 0.1)) -> Reweighted:
        """rows are read twice a round: write them once if they are dear. Ends when the loss falls by no more than `least` of itself."""
        rows = rows.where(F.col(target).isNotNull())
        now = self.solved(rows, target, F.lit(1.0))
        if now is None:
            raise ValueError("no rows to fit")
        self.history = self.losses_at(rows, target, [now])
        for _ in range(rounds if self.loss != "mse" else 0):
            move = self.solved(rows, target, weight(self.loss, self.value(now), F.col(target), **self.params)) - now
            tries = [now + part * move for part in parts]
            found = self.losses_at(rows, target, tries)
            best = int(np.argmin(found))
            if found[best] >= self.history[-1] * (1 - least):
                break
            now = tries[best]
            self.history.append(found[best])
        self.coefficients = [float(c) for c in now]
        return self

    def predict(self, rows: DataFrame, name: str = "pred") -> DataFrame:
        if self.coefficients is None:
            raise ValueError("not fitted")
        return rows.withColumn(name, self.value(self.coefficients))
