"""KPI states over a hand-made cube; fold arithmetic; ridge against closed form."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators import dashboard as D
from tallyspark.operators import model as M

CUBE = "month string, location string, category string, rows long, valid long, quantity_valid long, sales double, units double"


def cube(spark, rows):
    return spark.createDataFrame(rows, CUBE)


def states(df):
    return {r["metric"]: (r["current"], r["previous"], r["state"]) for r in df.collect()}


def test_kpi_previous_period_states(spark):
    c = cube(spark, [("2024-01", "Online", "A", 2, 2, 2, 10.0, 2.0), ("2024-02", "Online", "A", 2, 2, 2, 15.0, 3.0),
                     ("2024-03", "Online", "A", 1, 0, 0, 0.0, 0.0)])
    s = states(D.kpi_period_over_period(c, "2024-02", "2024-02"))
    assert s["sales"] == (15.0, 10.0, "change")
    assert states(D.kpi_period_over_period(c, "2024-01", "2024-01"))["sales"][2] == "no_prior"
    s3 = states(D.kpi_period_over_period(c, "2024-03", "2024-03"))
    assert s3["average"][2] == "no_valid_sales"
    # start after end collapses to the start month
    assert states(D.kpi_period_over_period(c, "2024-02", "2024-01"))["sales"][0] == 15.0


def test_kpi_zero_states(spark):
    c = cube(spark, [("2024-01", "Online", "A", 1, 0, 0, 0.0, 0.0), ("2024-02", "Online", "A", 1, 0, 0, 0.0, 0.0),
                     ("2024-03", "Online", "A", 1, 1, 1, 5.0, 1.0)])
    assert states(D.kpi_period_over_period(c, "2024-02", "2024-02"))["sales"][2] == "no_change"
    assert states(D.kpi_period_over_period(c, "2024-03", "2024-03"))["sales"][2] == "previous_zero"


def test_breakdown_and_default_period(spark):
    c = cube(spark, [("2024-01", "Online", "A", 2, 1, 2, 10.0, 2.0), ("2024-01", "In-store", "B", 2, 0, 1, 0.0, 1.0),
                     ("2024-02", "Online", "A", 1, 1, 1, 4.0, 1.0)])
    b = {r["category"]: r for r in D.category_breakdown(c, "2024-01", "2024-02", category="B").collect()}
    assert b["A"]["value"] == 7.0 and b["B"]["value"] == 0.0 and b["B"]["selected"]
    last = c.sparkSession.createDataFrame([("2024-02-10",)], "transaction_date string")
    p = D.default_period(c, D.last_date_info(last)).first()
    assert (p["start_month"], p["end_month"]) == ("2024-01", "2024-01")
    q = D.quantity_coverage(c, "2024-01", "2024-02").first()[0]
    assert math.isclose(q, 4 / 5)


def test_fold_ranges():
    assert M.fold_ranges(9500) == [(2375, 2375, 4750), (4750, 4750, 7125), (7125, 7125, 9500)]
    assert M.fold_ranges(10) == [(4, 4, 6), (6, 6, 8), (8, 8, 10)]


def test_leakage_guard():
    import pytest
    with pytest.raises(ValueError):
        M.leakage_guard(M.FEATURES + ["quantity"])


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    n = 400
    cat = rng.choice(["a", "b", "c"], n)
    year = rng.integers(2020, 2024, n).astype(float)
    month = rng.integers(1, 13, n).astype(float)
    y = 3 * (cat == "b") - 2 * (cat == "c") + 0.5 * year + 0.1 * month + rng.normal(0, 1, n)
    rows = [("X", c, "L", "Monday", "Q1", int(yy), int(mm), float(v)) for c, yy, mm, v in zip(cat, year, month, y)]
    df = spark.createDataFrame(rows, "category string, item string, location string, weekday string, quarter string, "
                                     "year int, month int, y double").withColumn("row", F.monotonically_increasing_id())
    alpha = 10.0
    fit = M.fit_ridge(df, alpha)
    pred = np.array([r["prediction"] for r in fit.transform(df).orderBy("row").select("prediction").collect()])
    # closed form: one-hot (full) + standardised numerics, centred, unpenalised intercept
    cols = [(cat == v).astype(float) for v in ["a", "b", "c"]] + [np.ones(n)] * 3
    z = [(year - year.mean()) / year.std(), (month - month.mean()) / month.std()]
    X = np.column_stack(cols + z)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    ref = Xc @ w + y.mean()
    np.testing.assert_allclose(pred, ref, rtol=1e-6, atol=1e-6)


def test_ridge_many_items_matches_sparse_normal_equations(spark):
    """6,000 items of very different sizes, a null item and a null category, several alphas from one fit."""
    rng = np.random.default_rng(1)
    n, k = 30_000, 6_000
    item = np.where(rng.random(n) < 0.3, 0, rng.integers(0, k, n))
    cat, wd = rng.integers(0, 4, n), rng.integers(0, 7, n)
    year, month = rng.integers(2020, 2024, n), rng.integers(1, 13, n)
    y = rng.normal(0, 1, k)[item] + 0.5 * cat + 0.1 * month + rng.normal(0, 1, n)
    rows = [("c%d" % c if c else None, "i%d" % i if i != 1 else None, "L", "d%d" % w, "Q%d" % ((m + 2) // 3), int(yy), int(m), float(v))
            for c, i, w, yy, m, v in zip(cat, item, wd, year, month, y)]
    df = spark.createDataFrame(rows, "category string, item string, location string, weekday string, quarter string, "
                                     "year int, month int, y double").withColumn("row", F.monotonically_increasing_id())
    alphas = [0.1, 10.0]
    got = M.fit_ridges(df, alphas).predictions(df).orderBy("row").select("prediction_0", "prediction_1").toPandas().to_numpy()
    z = [(year - year.mean()) / year.std(), (month - month.mean()) / month.std()]
    quarter = (month + 2) // 3
    U = np.column_stack([np.ones(n), *[cat == v for v in range(4)], np.ones(n), *[wd == v for v in range(7)],
                         *[quarter == v for v in range(1, 5)], *z]).astype(float)
    for j, alpha in enumerate(alphas):
        # Optimality: the gradient of the objective in every coefficient is 0; w follows from the predictions' residuals.
        e = y - got[:, j]
        w_items = np.bincount(item, e, minlength=k) / alpha
        w = U.T @ e / alpha
        assert abs(e.sum()) < 1e-6
        b = got[:, j] - w_items[item] - U[:, 1:] @ w[1:]
        np.testing.assert_allclose(b, b.mean(), atol=1e-8 * max(1.0, abs(w).max() * 100))


def test_ridge_unseen_levels_add_nothing(spark):
    schema = "category string, item string, location string, weekday string, quarter string, year int, month int, y double"
    df = spark.createDataFrame([("a", "x", "L", "d", "Q1", 2020, 1, 1.0), ("b", "z", "L", "d", "Q1", 2020, 2, 3.0)], schema)
    new = spark.createDataFrame([("new", "new", "new", "new", "new", 2020, 1, 0.0), (None, None, None, None, None, None, None, 0.0)], schema)
    fit = M.fit_ridge(df, 1.0)
    got = [r["prediction"] for r in fit.transform(new).collect()]
    assert len(got) == 2 and all(math.isfinite(v) for v in got)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (4.0, 6.0)], "y double, prediction double")
    r = M.regression_metrics(df).first()
    e = np.array([-1, 0, 1, -2.0])
    assert math.isclose(r["MAE"], np.abs(e).mean()) and math.isclose(r["RMSE"], math.sqrt((e ** 2).mean()))
    yy = np.array([1, 2, 3, 4.0])
    assert math.isclose(r["R2"], 1 - (e ** 2).sum() / ((yy - yy.mean()) ** 2).sum())
    assert r["MedianAE"] == 1.0


def test_ridge_folds_share_their_cells(spark, monkeypatch):
    """Cells are made and written once for all folds; each fold's scores are those of a fit on its own rows."""
    rng = np.random.default_rng(2)
    n = 900
    rows = [(f"c{rng.integers(3)}" if i % 9 else None, f"i{rng.integers(40)}" if i % 7 else None, "L", f"d{rng.integers(7)}", f"Q{rng.integers(1, 5)}",
             2019 + i // 300 if i % 50 else None, int(rng.integers(1, 13)), float(rng.normal() + (i % 3)), i) for i in range(n)]
    df = spark.createDataFrame(rows, "category string, item string, location string, weekday string, quarter string, year int, month int, y double, idx long")
    names, once = [], M.written_once
    monkeypatch.setattr(M, "written_once", lambda d, name: (names.append(name), once(d, name))[1])
    alphas = [0.1, 10.0]
    got = {r["alpha"]: r["fold_MAE"] for r in M.ridge_cv(df, alphas).collect()}
    assert names.count("cells") == 1
    for i, (end, v0, v1) in enumerate(M.fold_ranges(n)):
        pred = M.fit_ridges(df.where(F.col("idx") < end), alphas).predictions(df.where(F.col("idx").between(v0, v1 - 1)))
        for k, a in enumerate(alphas):
            assert math.isclose(got[a][i], pred.agg(F.avg(F.abs(F.col("y") - F.col(f"prediction_{k}")))).first()[0], rel_tol=1e-9)
