"""Distributed ranks, quantiles and tests against brute force on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import ranks as R
from tallyspark.operators import stats as S


def midrank_np(x):
    x = np.asarray(x, dtype=float)
    order = np.argsort(x, kind="mergesort")
    ranks = np.empty(len(x))
    sx = x[order]
    i = 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and sx[j + 1] == sx[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
        i = j + 1
    return ranks


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_midranks_match_brute_force(spark, buckets):
    rnd = random.Random(7)
    vals = [float(rnd.randint(0, 40)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r["v"]: r["rank"] for r in R.midranks(df, "x", buckets).collect()}
    ref = midrank_np(vals)
    for v, r in zip(vals, ref):
        assert got[v] == r


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    vals = [round(rnd.uniform(0, 1000), 2) for _ in range(1001)] + [5.0] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.025, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = [r["q"] for r in sorted(R.exact_quantiles(df, "x", probs, buckets=8).collect(), key=lambda r: r["pi"])]
    np.testing.assert_allclose(got, np.quantile(vals, probs), rtol=1e-12)


def test_row_index_is_a_permutation(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    out = R.row_index(df, ["a", "b"], partitions=5).orderBy("idx").collect()
    assert [r["idx"] for r in out] == list(range(1000))
    keys = [(r["a"], r["b"]) for r in out]
    assert keys == sorted(keys)


def test_kruskal_wallis_formula(spark):
    rnd = random.Random(11)
    rows = [(g, float(rnd.randint(0, 30) + (3 if g == "b" else 0))) for g in "abc" for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = S.kruskal_wallis(df, "g", "v").first()
    vals = np.array([v for _, v in rows])
    ranks = midrank_np(vals)
    n = len(vals)
    h = 0.0
    for g in "abc":
        rg = ranks[[i for i, (gg, _) in enumerate(rows) if gg == g]]
        h += rg.sum() ** 2 / len(rg)
    h = 12.0 / (n * (n + 1)) * h - 3 * (n + 1)
    _, t = np.unique(vals, return_counts=True)
    h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert math.isclose(r["statistic"], h, rel_tol=1e-12)
    assert 0 <= r["p_value"] <= 1 and r["groups"] == 3


def test_mann_whitney_known_value(spark):
    # No ties: U of a = 3; n1 = n2 = 3
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), ("b", 3.0), ("b", 4.0), ("b", 5.0)], "g string, v double")
    r = S.mann_whitney(df, "g", "v", "a", "b").first()
    assert r["statistic"] == 3.0 and math.isclose(r["effect_size"], 2 * 3 / 9 - 1)
    sigma = math.sqrt(9 / 12 * 7)
    z = (6 - 4.5 - 0.5) / sigma
    assert math.isclose(r["p_value"], math.erfc(z / math.sqrt(2)), rel_tol=1e-9)


def test_spearman_matches_pearson_of_ranks(spark):
    rnd = random.Random(5)
    xs = [float(rnd.randint(0, 20)) for _ in range(300)]
    ys = [x + rnd.randint(-5, 5) for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    r = S.spearman(df, "x", "y").first()
    ref = np.corrcoef(midrank_np(xs), midrank_np(ys))[0, 1]
    assert math.isclose(r["statistic"], ref, rel_tol=1e-12)


def test_chi_square_yates_2x2(spark):
    # Table [[10, 20], [30, 40]]; Yates chi2 computed by hand.
    rows = [("x", "p")] * 10 + [("x", "q")] * 20 + [("y", "p")] * 30 + [("y", "q")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    r = S.chi_square(df, "a", "b").first()
    obs = np.array([[10, 20], [30, 40]], dtype=float)
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    adj = obs + np.minimum(0.5, np.abs(e - obs)) * np.sign(e - obs)
    chi2 = ((adj - e) ** 2 / e).sum()
    assert math.isclose(r["chi_square"], chi2, rel_tol=1e-12) and r["degrees_of_freedom"] == 1
    assert math.isclose(r["minimum_expected_count"], e.min())


def bh_np(p):
    p = np.asarray(p, dtype=float)
    order = np.argsort(p)
    ranked = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.clip(np.minimum.accumulate(ranked[::-1])[::-1], 0, 1)
    out = np.empty_like(adj)
    out[order] = adj
    return out


def test_fdr_bh_matches_numpy_with_ties(spark):
    rnd = random.Random(9)
    ps = [round(rnd.random(), 2) for _ in range(400)] + [0.0, 1.0]
    df = spark.createDataFrame([(p,) for p in ps], "p_value double")
    got = {r["p_value"]: r["fdr_p_value"] for r in S.fdr_bh(df, buckets=4).collect()}
    for p, a in zip(ps, bh_np(ps)):
        assert math.isclose(got[p], a, rel_tol=1e-12, abs_tol=1e-15)
    small = S.fdr_bh_small(df.withColumn("test_no", F.monotonically_increasing_id())).collect()
    for r in small:
        assert math.isclose(r["fdr_p_value"], got[r["p_value"]], rel_tol=1e-12, abs_tol=1e-15)


def _chi_brute(obs):
    obs = np.asarray(obs, dtype=float)
    e = obs.sum(1)[:, None] * obs.sum(0)[None, :] / obs.sum()
    dof = (obs.shape[0] - 1) * (obs.shape[1] - 1)
    if dof == 1:
        obs = obs + np.minimum(0.5, np.abs(e - obs)) * np.sign(e - obs)
    return ((obs - e) ** 2 / e).sum(), e.min()


@pytest.mark.parametrize("table", [[[0, 5], [7, 3]], [[4, 0, 2], [0, 6, 1], [3, 3, 0]], [[1, 0], [0, 1]]])
def test_chi_square_with_empty_cells(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(table) for j, n in enumerate(row) for _ in range(n)]
    r = S.chi_square(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    chi2, emin = _chi_brute(table)
    assert math.isclose(r["chi_square"], chi2, rel_tol=1e-12, abs_tol=1e-12)
    assert math.isclose(r["minimum_expected_count"], emin, rel_tol=1e-12)


def test_rank_desc_and_running_total(spark):
    rnd = random.Random(2)
    rows = [(f"i{k:03d}", float(rnd.randint(0, 9))) for k in range(200)]
    df = spark.createDataFrame(rows, "item string, u double")
    got = {r["item"]: r["rank_u"] for r in R.rank_desc(df, "u").collect()}
    for item, u in rows:
        assert got[item] == 1 + sum(1 for _, v in rows if v > u)
    rt = R.running_total(df, [F.col("u").desc(), F.col("item").asc()], "u", partitions=5).orderBy("idx").collect()
    ordered = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["item"] for r in rt] == [r[0] for r in ordered]
    assert [r["running"] for r in rt] == list(np.cumsum([r[1] for r in ordered]))


def test_materialized_builds_once(spark, tmp_path):
    from tallyspark.plans.materialize import materialized
    calls = []

    def write(path):
        calls.append(path)
        spark.range(5).write.parquet(path)
    src = str(tmp_path / "src")
    spark.range(3).write.parquet(src)
    assert materialized(spark, "unit-once", [src], write).count() == 5
    assert materialized(spark, "unit-once", [src], write).count() == 5
    assert len(calls) == 1
    spark.range(4).write.mode("overwrite").parquet(src)  # changed input -> rebuilt
    materialized(spark, "unit-once", [src], write)
    assert len(calls) == 2
