"""Chances of a click against a plain fit, on rows held out, and in the ranking."""

import numpy as np
import pytest

from vitrine.operators import logistic, recsys
from vitrine.queries import QUERIES
from vitrine.sources.model import Model


def plain(x, n, k, ridge=1.0):
    """Many small steps up the slope, without second derivatives."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.array([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(200_000):
        slope = x.T @ (k - n / (1 + np.exp(-x @ w))) - penalty * w
        w += slope / n.sum()
        if np.abs(slope).max() < 1e-9:
            break
    return w


def sample(seed, rows):
    rng = np.random.default_rng(seed)
    x, n = rng.normal(size=(rows, 2)), rng.integers(1, 20, rows)
    return x, n, rng.binomial(n, 1 / (1 + np.exp(1.5 - x @ np.array([0.8, -0.5]))))


def table(spark, x, n, k):
    return spark.createDataFrame([(float(a), float(b), int(c), int(d)) for (a, b), c, d in zip(x, n, k)], "a double, b double, n long, k long")


def test_coefficients_equal_a_plain_fit(spark):
    x, n, k = sample(1, 300)
    assert logistic.fit(table(spark, x, n, k), ["a", "b"], "n", "k") == pytest.approx(plain(x, n, k), abs=1e-6)


def test_chances_are_right_on_rows_held_out(spark):
    fitted = logistic.fit(table(spark, *sample(2, 2000)), ["a", "b"], "n", "k")
    held = table(spark, *sample(3, 4000)).withColumn("p", logistic.probability(["a", "b"], fitted)).toPandas().sort_values("p")
    for part in np.array_split(held, 10):
        assert (part.p * part.n).sum() / part.n.sum() == pytest.approx(part.k.sum() / part.n.sum(), abs=0.03)


def test_rows_that_say_nothing_and_too_much(spark):
    schema = "a double, n long, k long"
    fit = lambda rows: logistic.fit(spark.createDataFrame(rows, schema), ["a"], "n", "k")
    assert fit([]) == fit([(1.0, 0, 0), (2.0, None, 1)]) == [0.0, 0.0]
    assert fit([(None, 4, 1)])[0] == pytest.approx(np.log(1 / 3)) and fit([(None, 4, 1)])[1] == 0
    assert all(np.isfinite(fit([(float(a), 1, int(a > 0)) for a in range(-9, 10)])))  # told apart without fault
    assert all(np.isfinite(fit([(1e6, 1, 1), (-1e6, 1, 0)])))


def test_ranking_has_every_image_of_the_log(spark, data):
    got = QUERIES["interaction_ranked"](spark, data).toPandas()
    m = Model(spark, data)
    known = m.behaviors().select("image_id").join(m.images().withColumnRenamed("id", "image_id"), "image_id", "left_semi").distinct()
    assert sorted(got["id"]) == sorted(r["image_id"] for r in known.collect()) and got["chance"].between(0, 1).all()
    trials = recsys.interaction_trials(m.behaviors(), "2024-01-16 00:00:00", 2 * 86_400).toPandas()
    assert (trials["hits"] <= trials["exposures"]).all() and trials["exposures"].sum() == m.behaviors().filter("kind = 'VIEW' and ts >= timestamp_ntz'2024-01-16'").count()
