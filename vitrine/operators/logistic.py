"""Logistic regression by Newton's steps: each is one aggregate over the rows, whose size is that of the coefficients squared."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import discard, stored

#: More features would make the aggregate's row, and the driver's matrix, large.
MOST_FEATURES = 50


def probability(features: list[str], coefficients: list[float]) -> Column:
    """1 / (1 + exp(-z)) with z the first coefficient plus the weighted features; a null feature counts as 0."""
    z = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * float(w) for f, w in zip(features, coefficients[1:], strict=True)), F.lit(float(coefficients[0])))
    return 1 / (1 + F.exp(-z))


def fit(rows: DataFrame, features: list[str], trials: str, hits: str, ridge: float = 1.0, tolerance: float = 1e-8, steps: int = 50) -> list[float]:
    """Coefficients (the constant first) under which hits of trials are likeliest, less ridge / 2 times the squared weights.

    The ridge, which spares the constant, keeps weights finite where a feature tells hits apart without fault. A step that
    makes the likelihood worse is halved. Rows without trials say nothing, null hits are none, null features are 0; without any rows all
    coefficients are 0. Rows are stored once, read by each step, and partial sums are all that is shuffled.
    """
    if len(features) > MOST_FEATURES:
        raise ValueError(f"{len(features)} features; {MOST_FEATURES} at most")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    xs = [F.lit(1.0), *(F.col(f"x{j}") for j in range(len(features)))]
    size = len(xs)
    table = stored(rows.select(*(number(f).alias(f"x{j}") for j, f in enumerate(features)), number(trials).alias("n"), number(hits).alias("k")).filter("n > 0"), "trials")
    penalty = np.array([0.0, *[ridge] * len(features)])
    names = [f"x{j}" for j in range(len(features))]

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = probability(names, w.tolist())
        z = sum((x * float(v) for x, v in zip(xs[1:], w[1:])), F.lit(float(w[0])))
        softplus = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        held = table.select(*(x.alias(f"y{j}") for j, x in enumerate(xs)), (F.col("k") - F.col("n") * p).alias("miss"), (F.col("n") * p * (1 - p)).alias("v"), (F.col("k") * z - F.col("n") * softplus).alias("ll"))
        y = [F.col(f"y{j}") for j in range(size)]
        pairs = [(a, b) for a in range(size) for b in range(a, size)]
        row = held.agg(F.sum("ll"), *(F.sum(F.col("miss") * x) for x in y), *(F.sum(F.col("v") * y[a] * y[b]) for a, b in pairs)).first()
        values = np.array([0.0 if v is None else v for v in row])
        curve = np.zeros((size, size))
        for (a, b), v in zip(pairs, values[1 + size :]):
            curve[a, b] = curve[b, a] = v
        return values[0] - float(penalty @ w**2) / 2, values[1 : 1 + size] - penalty * w, curve + np.diag(penalty)

    w = np.zeros(size)
    best, slope, curve = sums(w)
    for _ in range(steps):
        move = np.linalg.lstsq(curve, slope, rcond=None)[0]
        while np.abs(move).max() > tolerance:
            found = sums(w + move)
            if found[0] >= best - 1e-9 * abs(best):
                break
            move = move / 2
        else:
            break
        w, (best, slope, curve) = w + move, found
    discard(table)
    return w.tolist()
