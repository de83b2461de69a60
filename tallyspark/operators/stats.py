"""Rank tests, correlation, contingency tests and FDR on distributed data.

Ranks come from ``ranks.cumulative_counts`` (no single-partition sort) and are
carried doubled, as integers, so rank sums and centred cross products are
exact DECIMAL sums; only the final formula is evaluated in double. Tail
probabilities are JVM-side Column expressions (``functions.tails``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.calendar import parsed_date
from tallyspark.functions.tails import chi2_sf, normal_sf, t_sf_two_sided
from tallyspark.operators.ranks import DEFAULT_BUCKETS, cumulative_counts, doubled_rank, with_bucket
from tallyspark.session import checkpoint_dir

BIG = "decimal(38,0)"


def kept(df: DataFrame) -> DataFrame:
    """A count table that several parts of a test read, written once to the shared folder instead of counted again for each."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _ranked_groups(df: DataFrame, group: str, value: str, buckets: int) -> DataFrame:
    """(g, n_g, r2_g) and tie term: per-group count and doubled rank sum over global mid-ranks."""
    src = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    vcg = kept(src.groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("ngv")))
    vc = vcg.groupBy("v").agg(F.sum("ngv").alias("t"))
    cum = cumulative_counts(vc, buckets)
    j = vcg.join(cum, "v")
    return j.select("g", "ngv", "t", doubled_rank(F.col("below"), F.col("t")).alias("d"))


def tie_term(t: Column) -> Column:
    """t^3 - t as an exact integer."""
    tt = t.cast(BIG)
    return tt * tt * tt - tt


def kruskal_wallis(df: DataFrame, group: str, value: str = "total_spent",
                   buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H, chi-square p-value and epsilon squared (H1, H2).

    Null groups and null values are dropped. One row.
    """
    j = _ranked_groups(df, group, value, buckets)
    per_g = j.groupBy("g").agg(F.sum("ngv").alias("ng"),
                               F.sum(F.col("ngv").cast(BIG) * F.col("d")).alias("r2"))
    ties = j.groupBy("d").agg(F.max("t").alias("t"))  # one row per distinct value
    tsum = ties.agg(F.sum(tie_term(F.col("t"))).alias("tt"))
    g = per_g.agg(F.sum("ng").alias("n"), F.count(F.lit(1)).alias("k"),
                  F.sum((F.col("r2").cast("double") / 2.0) * (F.col("r2").cast("double") / 2.0) / F.col("ng"))
                  .alias("ssum"))
    n = F.col("n").cast("double")
    h_raw = F.lit(12.0) / (n * (n + 1.0)) * F.col("ssum") - 3.0 * (n + 1.0)
    corr = F.lit(1.0) - F.col("tt").cast("double") / (n * n * n - n)
    out = g.crossJoin(tsum).select(
        F.lit("Kruskal-Wallis").alias("test"), F.lit(group).alias("group_column"), F.col("n").cast("long").alias("n"),
        F.col("k").cast("long").alias("groups"), (h_raw / corr).alias("statistic"))
    return out.select("*", chi2_sf(F.col("statistic"), F.col("groups") - 1).alias("p_value"),
                      F.greatest(F.lit(0.0), (F.col("statistic") - F.col("groups") + 1)
                                 / (F.col("n") - F.col("groups"))).alias("effect_size"))


def mann_whitney(df: DataFrame, group: str, value: str, a: str, b: str,
                 buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Two-sided Mann-Whitney U of group a vs b (asymptotic, tie- and continuity-corrected) (H3, H4).

    Statistic is U of sample a; effect size is the rank-biserial 2U/(n1 n2) - 1.
    (SciPy switches to an exact p-value for tiny tie-free samples; this
    implementation always uses the normal approximation.)
    """
    sub = df.where(F.col(group).isin(a, b))
    j = _ranked_groups(sub, group, value, buckets)
    ties = j.groupBy("t", "d").agg(F.lit(1).alias("_x")).select("t")
    tsum = ties.agg(F.coalesce(F.sum(tie_term(F.col("t"))), F.lit(0).cast(BIG)).alias("tt"))
    g = j.agg(F.sum(F.when(F.col("g") == a, F.col("ngv")).otherwise(0)).alias("n1"),
              F.sum(F.when(F.col("g") == b, F.col("ngv")).otherwise(0)).alias("n2"),
              F.sum(F.when(F.col("g") == a, F.col("ngv").cast(BIG) * F.col("d"))).alias("r2a"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u1 = F.col("r2a").cast("double") / 2.0 - n1 * (n1 + 1.0) / 2.0
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.col("tt").cast("double") / (n * (n - 1.0))))
    u = F.greatest(u1, n1 * n2 - u1)
    z = (u - n1 * n2 / 2.0 - 0.5) / sigma
    out = g.crossJoin(tsum).select(F.lit("Mann-Whitney U").alias("test"), (n1 + n2).cast("long").alias("n"),
                                   u1.alias("statistic"), z.alias("_z"),
                                   (F.lit(2.0) * u1 / (n1 * n2) - 1.0).alias("effect_size"))
    return out.select("test", "n", "statistic", F.least(F.lit(1.0), F.lit(2.0) * normal_sf(F.col("_z"))).alias("p_value"),
                      "effect_size")


def spearman_pairs(pairs: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Spearman rho of (x, y, n) pair counts, t-test p-value (H5).

    Mid-ranks of x and of y are joined onto the distinct pairs, never onto
    the rows; centred doubled ranks give exact DECIMAL cross products.
    """
    rx = cumulative_counts(pairs.groupBy(F.col("x").alias("v")).agg(F.sum("n").alias("t")), buckets)
    ry = cumulative_counts(pairs.groupBy(F.col("y").alias("v")).agg(F.sum("n").alias("t")), buckets)
    total = pairs.agg(F.sum("n").alias("_tot"))
    j = (pairs.join(rx.select(F.col("v").alias("x"), doubled_rank(F.col("below"), F.col("t")).alias("dx")), "x")
              .join(ry.select(F.col("v").alias("y"), doubled_rank(F.col("below"), F.col("t")).alias("dy")), "y")
              .crossJoin(F.broadcast(total)))
    cx = (F.col("dx") - F.col("_tot") - 1).cast(BIG)
    cy = (F.col("dy") - F.col("_tot") - 1).cast(BIG)
    nn = F.col("n").cast(BIG)
    g = j.agg(F.first("_tot").alias("_tot"), F.sum(nn * cx * cy).alias("sxy"), F.sum(nn * cx * cx).alias("sxx"),
              F.sum(nn * cy * cy).alias("syy"))
    rho = F.col("sxy").cast("double") / F.sqrt(F.col("sxx").cast("double") * F.col("syy").cast("double"))
    out = g.select(F.col("_tot").cast("long").alias("n"),
                   F.when((F.col("sxx") > 0) & (F.col("syy") > 0), rho).alias("statistic"))
    dof = F.col("n") - 2
    r = F.col("statistic")
    tstat = r * F.sqrt(F.greatest(dof / ((r + 1.0) * (1.0 - r)), F.lit(0.0)))
    p = F.when(F.abs(r) >= 1.0, F.lit(0.0)).otherwise(t_sf_two_sided(tstat, dof))
    return out.select("n", "statistic", p.alias("p_value"))


def spearman(df: DataFrame, x: str, y: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Spearman rho between two columns over complete pairs (H5)."""
    pairs = kept(df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
                   .groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n")))
    return spearman_pairs(pairs, buckets).select(F.lit("Spearman correlation").alias("test"), "*")


def complete_month_rows(df: DataFrame) -> DataFrame:
    """Rows outside the last month unless that month is complete (C5); rows without a date stay in either case."""
    d = parsed_date(F.col("transaction_date"))
    last = df.agg(F.max(d).alias("_ld")).select(
        F.date_format("_ld", "yyyy-MM").alias("_lm"), (F.last_day("_ld") == F.col("_ld")).alias("_lc"))
    return (df.crossJoin(F.broadcast(last))
              .where(F.coalesce(F.col("_lc"), F.lit(True)) | d.isNull() | (F.date_format(d, "yyyy-MM") != F.col("_lm")))
              .drop("_lm", "_lc"))


def monthly_trend_spearman(df: DataFrame, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Spearman trend of complete-month recorded sales against month order.

    Months present in the data, null month sums count as 0. The month order
    index is a window over the monthly aggregate (one row per month).
    """
    # Dates are parsed once a day (one row each, kept), not once a row.
    daily = kept(df.where(F.col("transaction_date").isNotNull()).groupBy("transaction_date")
                   .agg(F.sum(F.col("total_spent").cast("decimal(28,6)")).alias("y")))
    monthly = complete_month_rows(daily).groupBy(F.substring("transaction_date", 1, 7).alias("m")).agg(
        F.coalesce(F.sum("y"), F.lit(0).cast("decimal(28,6)")).alias("y"))
    idx = monthly.select((F.row_number().over(Window.orderBy("m")) - 1).cast("double").alias("x"),
                         F.col("y").cast("double").alias("y"), F.lit(1).cast("long").alias("n"))
    return spearman_pairs(idx, buckets).select(F.lit("Spearman trend test").alias("test"),
                                               F.col("n").alias("n_months"), "statistic", "p_value")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square test of independence with bias-corrected Cramer's V (H7, H8).

    Works on the non-empty cells and the margins only. An empty cell with
    expected count E contributes E to the statistic, so their total is
    N - (sum of E over non-empty cells). With one degree of freedom (a 2 x 2
    table) Yates' correction applies: each cell moves toward E by
    min(0.5, |E - O|); the four expected counts come from the two row and two
    column margins. The minimum expected count is min(row) * min(col) / N.
    """
    from tallyspark.operators.reports import contingency
    cells = kept(contingency(df, a, b))
    ra = cells.groupBy("a").agg(F.sum("n").alias("ra"))
    cb = cells.groupBy("b").agg(F.sum("n").alias("cb"))
    rm = ra.agg(F.sum("ra").alias("_tot"), F.count(F.lit(1)).alias("_r"), F.min("ra").alias("_rmin"),
                F.max("ra").alias("_rmax"))
    cm = cb.agg(F.count(F.lit(1)).alias("_k"), F.min("cb").alias("_cmin"), F.max("cb").alias("_cmax"))
    margins = rm.crossJoin(cm)  # two one-row aggregates
    n = F.col("_tot").cast("double")
    e = F.col("ra").cast("double") * F.col("cb").cast("double") / n
    obs = F.col("n").cast("double")
    dof = (F.col("_r") - 1) * (F.col("_k") - 1)
    yates = obs + F.least(F.lit(0.5), F.abs(e - obs)) * F.signum(e - obs)
    adj = F.when(dof == 1, yates).otherwise(obs)
    nz = (cells.join(ra, "a").join(cb, "b").crossJoin(F.broadcast(margins))
               .agg(F.sum((adj - e) * (adj - e) / e).alias("_nz"), F.sum(e).alias("_nze"),
                    F.sum(F.when(dof == 1, (F.least(F.lit(0.5), e) - e) * (F.least(F.lit(0.5), e) - e) / e))
                    .alias("_nzy"), F.count(F.lit(1)).alias("_cells")))

    def g(x):  # Yates-corrected contribution of an empty cell with expected count x
        return (F.least(F.lit(0.5), x) - x) * (F.least(F.lit(0.5), x) - x) / x
    r1, r2 = F.col("_rmin").cast("double"), F.col("_rmax").cast("double")
    c1, c2 = F.col("_cmin").cast("double"), F.col("_cmax").cast("double")
    all_yates = g(r1 * c1 / n) + g(r1 * c2 / n) + g(r2 * c1 / n) + g(r2 * c2 / n)
    empty = F.when(dof == 1, all_yates - F.coalesce(F.col("_nzy"), F.lit(0.0))).otherwise(n - F.col("_nze"))
    empty = F.when(F.col("_cells") == F.col("_r") * F.col("_k"), F.lit(0.0)).otherwise(empty)
    chi2 = F.when(dof == 0, F.lit(0.0)).otherwise(F.col("_nz") + empty)
    j = nz.crossJoin(margins)
    phi2c = F.greatest(F.lit(0.0), F.col("chi_square") / n - (F.col("_k") - 1) * (F.col("_r") - 1) / (n - 1.0))
    rc = F.col("_r") - (F.col("_r") - 1) * (F.col("_r") - 1) / (n - 1.0)
    kc = F.col("_k") - (F.col("_k") - 1) * (F.col("_k") - 1) / (n - 1.0)
    den = F.least(kc - 1.0, rc - 1.0)
    out = j.select(F.lit(f"{a} x {b}").alias("variables"), chi2.alias("chi_square"),
                   dof.cast("long").alias("degrees_of_freedom"), "_tot", "_r", "_k",
                   (r1 * c1 / n).alias("minimum_expected_count"))
    return out.select("variables", "chi_square", "degrees_of_freedom",
                      F.when(F.col("degrees_of_freedom") == 0, F.lit(1.0))
                       .otherwise(chi2_sf(F.col("chi_square"), F.col("degrees_of_freedom"))).alias("p_value"),
                      F.when(den > 0, F.sqrt(phi2c / den)).otherwise(F.lit(0.0)).alias("cramers_v_bias_corrected"),
                      "minimum_expected_count", F.col("_tot").cast("long").alias("n"))


def fdr_bh(df: DataFrame, p: str = "p_value", buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, one row per distinct p-value (v, n, fdr).

    Adjusted(v) = min over w >= v of w * m / #(p <= w), clipped to [0, 1].
    Tied p-values share one adjusted value. The reverse running minimum runs
    inside value buckets plus a suffix minimum over bucket minima (few rows).
    """
    vc = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("v")).agg(F.count(F.lit(1)).alias("t"))
    cum = cumulative_counts(vc, buckets)
    m = vc.agg(F.sum("t").alias("m"))
    raw = cum.crossJoin(F.broadcast(m)).select(
        "v", "t", (F.col("v") * F.col("m") / (F.col("below") + F.col("t"))).alias("raw"))
    b = with_bucket(raw, "v", buckets)
    bmin = b.groupBy("_b").agg(F.min("raw").alias("_bm"))
    later = bmin.select("_b", F.min("_bm").over(
        Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    inner = Window.partitionBy("_b").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adj = F.least(F.min("raw").over(inner), F.coalesce(F.col("_after"), F.lit(float("inf"))))
    return (b.join(F.broadcast(later), "_b")
              .select(F.col("v").alias("p_value"), F.col("t").alias("n"),
                      F.least(F.greatest(adj, F.lit(0.0)), F.lit(1.0)).alias("fdr_p_value")))


def fdr_bh_small(tests: DataFrame, p: str = "p_value") -> DataFrame:
    """BH over a small test family (a dozen rows): adds ``fdr_p_value`` to every row."""
    m = F.count(F.lit(1)).over(Window.partitionBy())
    rk = tests.select("*", m.alias("_m"), F.count(F.lit(1)).over(
        Window.orderBy(F.col(p).asc()).rangeBetween(Window.unboundedPreceding, 0)).alias("_c"))
    rk = rk.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_c"))
    adj = F.min("_raw").over(Window.orderBy(F.col(p).desc()).rangeBetween(Window.unboundedPreceding, 0))
    return rk.withColumn("fdr_p_value", F.least(F.greatest(adj, F.lit(0.0)), F.lit(1.0))).drop("_m", "_c", "_raw")
