"""Quantiles by rounds of counting, against numpy, on values that are hard to bisect."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import selection as S

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def cases():
    rng = np.random.default_rng(8)
    return {
        "even": rng.uniform(-5, 5, 3000), "one value": np.full(500, 7.25), "two values": np.repeat([1.0, 2.0], [1999, 1]),
        "powers": 2.0 ** np.arange(-900, 900), "hot value": np.r_[np.zeros(1500), rng.normal(size=1500) * 1e-9],
        "widest": np.r_[rng.normal(size=700), 1.7e308, -1.7e308], "integers": rng.integers(0, 40, 2500).astype(float), "single": np.array([3.5]),
    }


@pytest.fixture
def small(monkeypatch):
    """Few cells and tiny leaves, so that small tables need many rounds."""
    monkeypatch.setattr(S, "CELLS", 64)
    monkeypatch.setattr(S, "LEAF_ROWS", 64)


def close(got, values, p):
    h = (len(values) - 1) * p
    v = np.sort(values)
    a, b = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
    return got == a + (h - int(h)) * (b - a)


@pytest.mark.parametrize("name", list(cases()))
def test_without_groups(spark, small, name):
    values = cases()[name]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    got = {r["p"]: r["q"] for r in S.quantiles(df, "x", PROBS).collect()}
    with np.errstate(over="ignore"):
        assert all(close(got[p], values, p) for p in PROBS)


def test_groups_together(spark, small):
    rows = [(name, float(v)) for name, values in cases().items() if name != "widest" for v in values] + [("nothing", None), (None, 1.0)]
    got = {(r["g"], r["p"]): r["q"] for r in S.quantiles(spark.createDataFrame(rows, "g string, x double"), "x", PROBS, ["g"]).collect()}
    names = {g for g, _ in got}
    assert names == {n for n in cases() if n != "widest"}
    assert all(close(got[n, p], cases()[n], p) for n in names for p in PROBS)


def test_many_groups_without_broadcast(spark, small, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_INTERVALS", 0)
    df = spark.range(4000).select((F.col("id") % 50).alias("g"), ((F.col("id") * 7919) % 1009).cast("double").alias("x"))
    want = {}
    for r in df.collect():
        want.setdefault(r["g"], []).append(r["x"])
    for r in S.quantiles(df, "x", [0.5], ["g"]).collect():
        assert close(r["q"], np.array(want[r["g"]]), 0.5)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert S.quantiles(empty, "x", [0.5]).count() == 0 and S.quantiles(empty, "x", [0.5], ["g"]).count() == 0


def test_a_pass_returns_cells_not_values(spark, monkeypatch):
    """Between rounds there are at most CELLS rows an interval, whatever the number of values."""
    monkeypatch.setattr(S, "CELLS", 16)
    seen = []
    pick = S._pick

    def spy(targets, counted, by, order):
        seen.append((order, counted.count(), targets.select(*by, "lo", "hi").distinct().count()))
        return pick(targets, counted, by, order)
    monkeypatch.setattr(S, "_pick", spy)
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5).alias("x"))
    S.quantiles(df, "x", [0.25, 0.5], ["g"]).collect()
    assert seen and all(rows <= n * (16 if order == "cell" else S.LEAF_ROWS) for order, rows, n in seen)
