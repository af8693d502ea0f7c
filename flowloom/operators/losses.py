"""Losses of predictions p against targets t, as columns for each edge; a loss of a batch is their mean."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrong(p: Column, t: Column) -> Column:
    return F.when(F.signum(p) == F.signum(t), 0.0).otherwise(1.0)


def mse(p: Column, t: Column) -> Column:
    return (p - t) * (p - t)


def sign_corrected(p: Column, t: Column, alpha: float = 1.0) -> Column:
    """Squared error, exp(alpha) times that where the sign is wrong."""
    return mse(p, t) * F.exp(alpha * wrong(p, t))


def focal(p: Column, t: Column, gamma: float = 1.0, boost: float = 1.5) -> Column:
    """Absolute error to the power 1 + gamma, boost times that where the sign is wrong."""
    return F.pow(F.abs(p - t), F.lit(1.0 + gamma)) * (1 + wrong(p, t) * (boost - 1))


def hybrid(p: Column, t: Column, alpha: float = 1.0, gamma: float = 1.5) -> Column:
    e = mse(p, t)
    return e * F.pow(F.sqrt(e + 1e-8), F.lit(gamma - 1)) * F.exp(alpha * wrong(p, t))


#: Losses by name. A further one is added by its name.
LOSSES: dict[str, Callable[..., Column]] = {"mse": mse, "sign_corrected": sign_corrected, "focal": focal, "hybrid": hybrid}


def loss(name: str, p: Column, t: Column, **params: float) -> Column:
    if name not in LOSSES:
        raise ValueError(f"no loss {name!r}; there are {', '.join(sorted(LOSSES))} and weighted_sign()")
    return LOSSES[name](p, t, **params)


def weighted_sign(rows: DataFrame, value: str, p: str = "pred", t: str = "target_delta", alpha: float = 1.0, power: float = 0.5, group: str = "year") -> DataFrame:
    """group and loss: sign_corrected, weighted by (value + 1)**power over its mean in the group, within 0.1 and 10."""
    weight = F.pow(F.col(value) + 1, F.lit(power))
    mean = rows.groupBy(group).agg(F.avg(weight).alias("mean_weight"))
    scaled = F.least(F.greatest(F.try_divide(weight, F.col("mean_weight")), F.lit(0.1)), F.lit(10.0))
    return rows.join(F.broadcast(mean), group).groupBy(group).agg(F.avg(sign_corrected(F.col(p), F.col(t), alpha) * scaled).alias("loss"))


def compare_losses(rows: DataFrame, p: str = "pred", t: str = "target_delta") -> DataFrame:
    """loss, value, relative (to mse), direction_acc, mae: a row for each of six settings, from one pass."""
    a, b = F.col(p), F.col(t)
    settings = [("mse", mse(a, b)), *[(f"sign_corrected alpha={x}", sign_corrected(a, b, x)) for x in (0.5, 1.0, 2.0)], ("focal gamma=1.0", focal(a, b)), ("hybrid", hybrid(a, b))]
    means = rows.agg(*[F.avg(e).alias(f"m{i}") for i, (_, e) in enumerate(settings)], F.avg(1 - wrong(a, b)).alias("direction_acc"), F.avg(F.abs(a - b)).alias("mae"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("loss"), F.col(f"m{i}").alias("value")) for i, (n, _) in enumerate(settings)]))
    return means.select(each.alias("e"), "m0", "direction_acc", "mae").select("e.loss", "e.value", F.try_divide("e.value", "m0").alias("relative"), "direction_acc", "mae")
