"""Registered statistics, bootstrap and model queries (with oracles where SQL can express them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import model as MD
from tallyspark.operators import ranks as RK
from tallyspark.operators import resample as RS
from tallyspark.operators import stats as ST
from tallyspark.plans.catalog import cleaned, register
from tallyspark.session import written_once

DIGITS = 9  # statistics are compared at 9 decimals (engines sum doubles in different orders)


def rnd(c):
    return F.round(c, DIGITS)


# Mid-ranks of total_spent per distinct value: (v, t, below, rank)
_RANKS = """
, vc AS (SELECT total_spent AS v, COUNT(*) AS t FROM clean WHERE total_spent IS NOT NULL GROUP BY 1)
SELECT v, t, CAST(coalesce(SUM(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
       (2 * coalesce(SUM(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t + 1) / 2.0 AS rank
FROM vc"""


def _clean_then(rest: str) -> str:
    """WITH <cleaning CTEs> <more CTEs starting with ','> SELECT ..."""
    from tallyspark.plans.sqltext import CLEAN_CTE
    return f"WITH {CLEAN_CTE}{rest}"


@register("midranks", _clean_then(_RANKS))
def q_midranks(spark, sf_dir):
    r = RK.midranks(cleaned(spark, sf_dir), "total_spent")
    return r.select("v", "t", "below", F.col("rank").cast("double").alias("rank"))


def _kw_sql(col: str, label: str) -> str:
    return _clean_then(f"""
, src AS (SELECT {col} AS g, total_spent AS v FROM clean WHERE {col} IS NOT NULL AND total_spent IS NOT NULL),
vcg AS (SELECT g, v, COUNT(*) AS ngv FROM src GROUP BY 1, 2),
vc AS (SELECT v, SUM(ngv) AS t FROM vcg GROUP BY 1),
r AS (SELECT v, t, 2 * coalesce(SUM(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t + 1 AS d FROM vc),
pg AS (SELECT g, SUM(ngv) AS ng, SUM(CAST(ngv AS HUGEINT) * d) AS r2 FROM vcg JOIN r USING (v) GROUP BY g),
tt AS (SELECT SUM(CAST(t AS HUGEINT) * t * t - t) AS tt FROM vc),
a AS (SELECT CAST(SUM(ng) AS DOUBLE) AS n, COUNT(*) AS k,
             SUM((CAST(r2 AS DOUBLE) / 2.0) * (CAST(r2 AS DOUBLE) / 2.0) / ng) AS ssum FROM pg),
h AS (SELECT n, k, (12.0 / (n * (n + 1.0)) * ssum - 3.0 * (n + 1.0)) / (1.0 - CAST(tt AS DOUBLE) / (n * n * n - n)) AS stat
      FROM a, tt)
SELECT 'Kruskal-Wallis' AS test, '{label}' AS group_column, CAST(n AS BIGINT) AS n, k AS groups,
       round(stat, {DIGITS}) AS statistic, round(greatest(0.0, (stat - k + 1) / (n - k)), {DIGITS}) AS effect_size
FROM h""")


@register("kruskal_wallis", _kw_sql("category", "category"))
def q_kruskal_wallis(spark, sf_dir):
    r = ST.kruskal_wallis(cleaned(spark, sf_dir), "category")
    return r.select("test", "group_column", "n", "groups", rnd(F.col("statistic")).alias("statistic"),
                    rnd(F.col("effect_size")).alias("effect_size"))


@register("kruskal_wallis_payment", _kw_sql("payment_method", "payment_method"))
def q_kruskal_wallis_payment(spark, sf_dir):
    r = ST.kruskal_wallis(cleaned(spark, sf_dir), "payment_method")
    return r.select("test", "group_column", "n", "groups", rnd(F.col("statistic")).alias("statistic"),
                    rnd(F.col("effect_size")).alias("effect_size"))


@register("mann_whitney", _clean_then(f"""
, src AS (SELECT discount_applied AS g, total_spent AS v FROM clean
          WHERE discount_applied IN ('Yes', 'No') AND total_spent IS NOT NULL),
vcg AS (SELECT g, v, COUNT(*) AS ngv FROM src GROUP BY 1, 2),
vc AS (SELECT v, SUM(ngv) AS t FROM vcg GROUP BY 1),
r AS (SELECT v, t, 2 * coalesce(SUM(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t + 1 AS d FROM vc),
a AS (SELECT CAST(SUM(ngv) FILTER (WHERE g = 'Yes') AS DOUBLE) AS n1, CAST(SUM(ngv) FILTER (WHERE g = 'No') AS DOUBLE) AS n2,
             CAST(SUM(CAST(ngv AS HUGEINT) * d) FILTER (WHERE g = 'Yes') AS DOUBLE) AS r2a FROM vcg JOIN r USING (v))
SELECT 'Mann-Whitney U' AS test, CAST(n1 + n2 AS BIGINT) AS n, round(r2a / 2.0 - n1 * (n1 + 1.0) / 2.0, {DIGITS}) AS statistic,
       round(2.0 * (r2a / 2.0 - n1 * (n1 + 1.0) / 2.0) / (n1 * n2) - 1.0, {DIGITS}) AS effect_size
FROM a"""))
def q_mann_whitney(spark, sf_dir):
    r = ST.mann_whitney(cleaned(spark, sf_dir), "discount_applied", "total_spent", "Yes", "No")
    return r.select("test", "n", rnd(F.col("statistic")).alias("statistic"), rnd(F.col("effect_size")).alias("effect_size"))


def _spearman_sql(pairs_cte: str, n_name: str = "n", test: str = "Spearman correlation") -> str:
    return _clean_then(f"""
, pairs AS ({pairs_cte}),
tot AS (SELECT SUM(n) AS tot_n FROM pairs),
rx AS (SELECT x, 2 * coalesce(SUM(t) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t + 1 AS dx
       FROM (SELECT x, SUM(n) AS t FROM pairs GROUP BY x)),
ry AS (SELECT y, 2 * coalesce(SUM(t) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + t + 1 AS dy
       FROM (SELECT y, SUM(n) AS t FROM pairs GROUP BY y)),
sp AS (SELECT max(tot_n) AS tot_n,
             SUM(CAST(n AS HUGEINT) * (dx - tot_n - 1) * (dy - tot_n - 1)) AS sxy,
             SUM(CAST(n AS HUGEINT) * (dx - tot_n - 1) * (dx - tot_n - 1)) AS sxx,
             SUM(CAST(n AS HUGEINT) * (dy - tot_n - 1) * (dy - tot_n - 1)) AS syy
      FROM pairs JOIN rx USING (x) JOIN ry USING (y) CROSS JOIN tot)
SELECT '{test}' AS test, CAST(tot_n AS BIGINT) AS {n_name},
       round(CASE WHEN sxx > 0 AND syy > 0 THEN CAST(sxy AS DOUBLE) / sqrt(CAST(sxx AS DOUBLE) * CAST(syy AS DOUBLE)) END,
             {DIGITS}) AS statistic
FROM sp""")


@register("spearman_price_quantity", _spearman_sql(
    "SELECT price_per_unit AS x, CAST(quantity AS DOUBLE) AS y, COUNT(*) AS n FROM clean "
    "WHERE price_per_unit IS NOT NULL AND quantity IS NOT NULL GROUP BY 1, 2"))
def q_spearman(spark, sf_dir):
    r = ST.spearman(cleaned(spark, sf_dir), "price_per_unit", "quantity")
    return r.select("test", "n", rnd(F.col("statistic")).alias("statistic"))


@register("monthly_trend_spearman", _spearman_sql("""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY m) - 1 AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, 1 AS n FROM
  (SELECT substr(c.transaction_date, 1, 7) AS m, coalesce(SUM(CAST(c.total_spent AS DECIMAL(28,6))), 0) AS y
   FROM clean c, (SELECT strftime(max(d), '%Y-%m') AS lm, last_day(max(d)) = max(d) AS lc FROM cleanx) l
   WHERE c.transaction_date IS NOT NULL AND (l.lc OR substr(c.transaction_date, 1, 7) <> l.lm) GROUP BY 1)""",
    n_name="n_months", test="Spearman trend test"))
def q_monthly_trend_spearman(spark, sf_dir):
    r = ST.monthly_trend_spearman(cleaned(spark, sf_dir))
    return r.select("test", "n_months", rnd(F.col("statistic")).alias("statistic"))


def _chi_sql(a: str, b: str, src: str = "clean") -> str:
    return _clean_then(f"""
, cells0 AS (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT ra.a, cb.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM cells0) ra
          CROSS JOIN (SELECT DISTINCT b FROM cells0) cb LEFT JOIN cells0 c ON c.a = ra.a AND c.b = cb.b),
ra AS (SELECT a, SUM(n) AS ra FROM cells GROUP BY a),
cb AS (SELECT b, SUM(n) AS cb FROM cells GROUP BY b),
tot AS (SELECT SUM(n) AS tot_n, COUNT(DISTINCT a) AS r_lv, COUNT(DISTINCT b) AS k_lv FROM cells),
j AS (SELECT cells.n AS n, CAST(ra AS DOUBLE) * CAST(cb AS DOUBLE) / CAST(tot_n AS DOUBLE) AS e, tot_n, r_lv, k_lv, (r_lv - 1) * (k_lv - 1) AS dof
      FROM cells JOIN ra USING (a) JOIN cb USING (b) CROSS JOIN tot),
t AS (SELECT tot_n, r_lv, k_lv, dof, e,
             CASE WHEN dof = 1 THEN CAST(n AS DOUBLE) + least(0.5, abs(e - n)) * sign(e - n) ELSE CAST(n AS DOUBLE) END AS adj FROM j),
g AS (SELECT tot_n, r_lv, k_lv, dof, CASE WHEN dof = 0 THEN 0.0 ELSE SUM((adj - e) * (adj - e) / e) END AS chi2, min(e) AS min_e
      FROM t GROUP BY tot_n, r_lv, k_lv, dof),
v AS (SELECT *, greatest(0.0, chi2 / CAST(tot_n AS DOUBLE) - (k_lv - 1) * (r_lv - 1) / (CAST(tot_n AS DOUBLE) - 1.0)) AS phi2c,
             least((k_lv - (k_lv - 1) * (k_lv - 1) / (CAST(tot_n AS DOUBLE) - 1.0)) - 1.0, (r_lv - (r_lv - 1) * (r_lv - 1) / (CAST(tot_n AS DOUBLE) - 1.0)) - 1.0) AS den
      FROM g)
SELECT '{a} x {b}' AS variables, round(chi2, {DIGITS}) AS chi_square, CAST(dof AS BIGINT) AS degrees_of_freedom,
       round(CASE WHEN den > 0 THEN sqrt(phi2c / den) ELSE 0.0 END, {DIGITS}) AS cramers_v_bias_corrected,
       round(min_e, {DIGITS}) AS minimum_expected_count, CAST(tot_n AS BIGINT) AS n
FROM v""")


def _chi_q(a, b, missing=False):
    def q(spark, sf_dir):
        df = cleaned(spark, sf_dir)
        if missing:
            df = df.withColumn("missing_total", F.when(F.col("total_spent").isNull(), "Missing").otherwise("Present"))
        r = ST.chi_square(df, a, b)
        return r.select("variables", rnd(F.col("chi_square")).alias("chi_square"), "degrees_of_freedom",
                        rnd(F.col("cramers_v_bias_corrected")).alias("cramers_v_bias_corrected"),
                        rnd(F.col("minimum_expected_count")).alias("minimum_expected_count"), "n")
    return q


_MISSING_SRC = "(SELECT *, CASE WHEN total_spent IS NULL THEN 'Missing' ELSE 'Present' END AS missing_total FROM clean)"
register("chi_square", _chi_sql("location", "payment_method"))(_chi_q("location", "payment_method"))
register("chi_square_category_channel", _chi_sql("location", "category"))(_chi_q("location", "category"))
register("cramers_v", _chi_sql("category", "missing_total", _MISSING_SRC))(_chi_q("category", "missing_total", True))
register("chi_square_yates", _chi_sql("location", "missing_total", _MISSING_SRC))(_chi_q("location", "missing_total", True))
register("chi_square_payment_missing", _chi_sql("payment_method", "missing_total", _MISSING_SRC))(
    _chi_q("payment_method", "missing_total", True))


# BH over a p-value column derived from the line items (ties; the distinct values grow with the table).
_P_EXPR_SQL = "CAST((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 999999937 + 1 AS DOUBLE) / 1000000000.0"


@register("fdr_bh", f"""
WITH vc AS (SELECT {_P_EXPR_SQL} AS v, COUNT(*) AS t FROM lineitem GROUP BY 1),
c AS (SELECT v, t, SUM(t) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM vc),
m AS (SELECT SUM(t) AS m FROM vc),
r AS (SELECT v, t, v * m / cum AS raw FROM c, m)
SELECT v AS p_value, t AS n,
       least(greatest(MIN(raw) OVER (ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 1.0) AS fdr_p_value
FROM r""")
def q_fdr_bh(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        ((F.col("l_orderkey").cast("long") * 7919 + F.col("l_linenumber").cast("long") * 104729 + F.col("l_partkey").cast("long") * 31) % 999999937 + 1).cast("double").alias("_x"))
    return ST.fdr_bh(li.select((F.col("_x") / 1000000000.0).alias("p_value")))


def _bits(hash_: str, at: int, n: str) -> str:
    """How many of the first ``n`` (at most 60) of 60 bits of a digest are one."""
    return f"bit_count(('0x' || substr({hash_}, {at}, 15))::BIGINT & ((1::BIGINT << greatest(least({n}, 60), 0)) - 1))"


# Linear interpolation between the neighbours of position (n - 1) p of the sorted list v.
_QUANTILE = lambda p: f"v[floor((len(v) - 1) * {p})::INT + 1] + ((len(v) - 1) * {p} - floor((len(v) - 1) * {p})) * (v[least(floor((len(v) - 1) * {p})::INT + 2, len(v))] - v[floor((len(v) - 1) * {p})::INT + 1])"  # noqa: E731, E501
_WORD = "md5(concat_ws(':', '42', rep, lo, hi, i, w))"
_BORDER = lambda x: f"least(({x}) * {RS.BUCKET}, K)"
_LEFT = lambda lo, hi: f"{_BORDER(f'({lo} + {hi}) // 2')} - {_BORDER(lo)}"


@register("cluster_bootstrap", _clean_then(f"""
, facts AS (SELECT customer_id, location, CAST(total_spent AS DECIMAL(28,6)) AS v FROM clean WHERE total_spent IS NOT NULL),
partial AS (
  SELECT customer_id, ROW_NUMBER() OVER (ORDER BY customer_id) - 1 AS idx, (sum(v) FILTER (location = 'Online') * 1000000)::BIGINT AS sa, count(*) FILTER (location = 'Online') AS na,
         (sum(v) FILTER (location = 'In-store') * 1000000)::BIGINT AS sb, count(*) FILTER (location = 'In-store') AS nb
  FROM facts WHERE customer_id IS NOT NULL GROUP BY 1),
kk AS (SELECT count(*) AS K FROM partial),
shares AS (
  SELECT * FROM (
    WITH RECURSIVE node(rep, lo, hi, n, i, u, s, r) AS (
      SELECT rep, 0::BIGINT, ((K + {RS.BUCKET - 1}) // {RS.BUCKET})::BIGINT, K, 0, K, 0::BIGINT, {_LEFT("0", f"((K + {RS.BUCKET - 1}) // {RS.BUCKET})")}
      FROM range(2000) t(rep), kk
      UNION ALL
      SELECT rep, part.lo, part.hi, part.n, part.i, part.u, part.s, part.r FROM (
        SELECT rep, unnest(CASE WHEN u > 0 AND i < {RS.DIGITS} THEN
                 [{{lo: lo, hi: hi, n: n, i: i + 1, u: kept, s: s + CASE WHEN 2 * r >= size THEN u - kept ELSE 0 END, r: 2 * r - CASE WHEN 2 * r >= size THEN size ELSE 0 END}}]
               ELSE [{{lo: lo, hi: mid, n: s, i: 0, u: s, s: 0::BIGINT, r: {_LEFT("lo", "mid")}}}, {{lo: mid, hi: hi, n: n - s, i: 0, u: n - s, s: 0::BIGINT, r: {_LEFT("mid", "hi")}}}] END) AS part
        FROM (SELECT node.*, K, (lo + hi) // 2 AS mid, {_BORDER("hi")} - {_BORDER("lo")} AS size,
                     list_sum([{_bits(_WORD, 1, "u - w * 120")} + {_bits(_WORD, 16, "u - w * 120 - 60")} FOR w IN range(0, (u + 119) // 120)])::BIGINT AS kept
              FROM node, kk WHERE hi - lo > 1)))
    SELECT rep, lo AS bucket, n FROM node WHERE hi - lo = 1 AND n > 0)),
draws AS (SELECT rep, bucket, unnest(range(n)) AS j FROM shares),
hits AS (SELECT rep, bucket * {RS.BUCKET} + (CASE WHEN j % 2 = 0 THEN x >> 30 ELSE x & 1073741823 END) % least({RS.BUCKET}, K - bucket * {RS.BUCKET}) AS idx
         FROM (SELECT *, ('0x' || substr(md5(concat_ws(':', '42', rep, 'd', bucket, j // 4)), CASE WHEN j % 4 < 2 THEN 1 ELSE 16 END, 15))::BIGINT AS x FROM draws), kk),
pr AS (SELECT rep, sum(sa) AS sa, sum(na) AS na, sum(sb) AS sb, sum(nb) AS nb FROM hits JOIN partial USING (idx) GROUP BY rep),
diffs AS (SELECT CAST(sa AS DOUBLE) / 1000000 / CAST(na AS DOUBLE) - CAST(sb AS DOUBLE) / 1000000 / CAST(nb AS DOUBLE) AS diff FROM pr WHERE na > 0 AND nb > 0),
obs AS (SELECT CAST(SUM(v) FILTER (WHERE location = 'Online') AS DOUBLE) / COUNT(*) FILTER (WHERE location = 'Online')
             - CAST(SUM(v) FILTER (WHERE location = 'In-store') AS DOUBLE) / COUNT(*) FILTER (WHERE location = 'In-store') AS od
        FROM facts)
SELECT od AS observed_difference, {_QUANTILE("0.025::DOUBLE")} AS ci_low, {_QUANTILE("0.975::DOUBLE")} AS ci_high,
       (SELECT K FROM kk) AS clusters, 2000 AS repetitions, 42 AS seed, len(v) AS replicates_used
FROM (SELECT list_sort(list(diff)) AS v FROM diffs), obs"""))
def q_cluster_bootstrap(spark, sf_dir):
    return RS.cluster_bootstrap_diff(cleaned(spark, sf_dir), reps=2000, seed=42)


# ------------------------------------------------------------------ report ---

def statistics_report(df, reps: int = 2000, seed: int = 42):
    """The 12-test family with p-values and BH adjustment across it (H12); one row per test."""
    parts = []
    no = 0

    def add(frame, question, effect="effect_size"):
        nonlocal no
        no += 1
        cols = frame.columns
        parts.append(frame.select(
            F.lit(no).alias("test_no"), F.lit(question).alias("question"),
            F.col("test") if "test" in cols else F.lit("Chi-square independence").alias("test"),
            F.col("n").cast("long").alias("n") if "n" in cols else F.col("n_months").cast("long").alias("n"),
            (F.col("statistic") if "statistic" in cols else F.col("chi_square")).cast("double").alias("statistic"),
            F.col("p_value").cast("double").alias("p_value"),
            (F.col(effect) if effect in cols else F.lit(None)).cast("double").alias("effect_size"),
            (F.col("degrees_of_freedom") if "degrees_of_freedom" in cols else F.lit(None)).cast("long").alias("dof"),
            (F.col("minimum_expected_count") if "minimum_expected_count" in cols else F.lit(None))
            .cast("double").alias("minimum_expected_count")))

    for g in ["category", "location", "payment_method", "discount_applied"]:
        add(ST.kruskal_wallis(df, g), f"Transaction-value distributions differ by {g}")
    add(ST.mann_whitney(df, "discount_applied", "total_spent", "Yes", "No"),
        "Known recorded discount groups: Yes versus No")
    add(ST.spearman(df, "price_per_unit", "quantity").withColumn("effect_size", F.col("statistic")),
        "Unit price is monotonically associated with quantity")
    add(ST.monthly_trend_spearman(df).withColumn("effect_size", F.col("statistic")),
        "Complete-month recorded sales show a monotonic time trend")
    mt = df.withColumn("missing_total", F.when(F.col("total_spent").isNull(), "Missing").otherwise("Present"))
    for a, b, q in [("location", "payment_method", "Payment-method mix differs by channel"),
                    ("location", "category", "Category mix differs by channel"),
                    ("category", "missing_total", "Missing sales is associated with category"),
                    ("location", "missing_total", "Missing sales is associated with channel"),
                    ("payment_method", "missing_total", "Missing sales is associated with payment method")]:
        add(ST.chi_square(mt, a, b), q, effect="cramers_v_bias_corrected")
    fam = parts[0]
    for p in parts[1:]:
        fam = fam.unionByName(p)
    return ST.fdr_bh_small(fam)


@register("statistics_report")
def q_statistics_report(spark, sf_dir):
    return statistics_report(cleaned(spark, sf_dir))


# ------------------------------------------------------------------- model ---

@register("model_frame", _clean_then(f"""
SELECT transaction_id, transaction_date, category,
       CASE WHEN item_imputed = 'Yes' THEN '{MD.MASKED_ITEM}' ELSE item END AS item, location, weekday, quarter, year, month,
       total_spent AS y, ROW_NUMBER() OVER (ORDER BY transaction_date, transaction_id) - 1 AS idx
FROM clean WHERE total_spent IS NOT NULL"""))
def q_model_frame(spark, sf_dir):
    return MD.model_frame(cleaned(spark, sf_dir))


@register("chronological_split", _clean_then(f"""
SELECT CASE WHEN transaction_date < '{MD.HOLDOUT_START}' THEN 'train' ELSE 'holdout' END AS side, COUNT(*) AS rows,
       min(transaction_date) AS first_date, max(transaction_date) AS last_date
FROM clean WHERE total_spent IS NOT NULL GROUP BY 1"""))
def q_chronological_split(spark, sf_dir):
    mf = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull())
    side = F.when(F.col("transaction_date") < MD.HOLDOUT_START, "train").otherwise("holdout")
    return mf.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("rows"), F.min("transaction_date").alias("first_date"),
                                             F.max("transaction_date").alias("last_date"))


@register("time_series_folds", _clean_then(f"""
, tr AS (SELECT transaction_date, ROW_NUMBER() OVER (ORDER BY transaction_date, transaction_id) - 1 AS idx
         FROM clean WHERE total_spent IS NOT NULL AND transaction_date < '{MD.HOLDOUT_START}'),
nn AS (SELECT COUNT(*) AS n, COUNT(*) // 4 AS size FROM tr),
f AS (SELECT i AS fold, n - (3 - i) * size AS v0, n - (3 - i) * size + size AS v1 FROM nn CROSS JOIN range(3) t(i))
SELECT fold, v0 AS train_rows, v1 - v0 AS validation_rows,
       (SELECT max(transaction_date) FROM tr WHERE idx < v0) AS train_end,
       (SELECT min(transaction_date) FROM tr WHERE idx >= v0 AND idx < v1) AS validation_start,
       (SELECT max(transaction_date) FROM tr WHERE idx >= v0 AND idx < v1) AS validation_end
FROM f"""))
def q_time_series_folds(spark, sf_dir):
    mf = MD.model_frame(cleaned(spark, sf_dir))
    train, _ = MD.chronological_split(mf)
    n = train.count()
    aggs = []
    for i, (tr_end, v0, v1) in enumerate(MD.fold_ranges(n)):
        val = (F.col("idx") >= v0) & (F.col("idx") < v1)
        aggs += [F.max(F.when(F.col("idx") < tr_end, F.col("transaction_date"))).alias(f"te{i}"),
                 F.min(F.when(val, F.col("transaction_date"))).alias(f"vs{i}"),
                 F.max(F.when(val, F.col("transaction_date"))).alias(f"ve{i}")]
    one = train.agg(*aggs)
    rows = ", ".join(f"{i}L, {tr}L, {v1 - v0}L, te{i}, vs{i}, ve{i}"
                     for i, (tr, v0, v1) in enumerate(MD.fold_ranges(n)))
    return one.selectExpr(f"stack(3, {rows}) AS (fold, train_rows, validation_rows, train_end, "
                          "validation_start, validation_end)")


@register("baseline_metrics", _clean_then(f"""
, tr AS (SELECT total_spent AS y FROM clean WHERE total_spent IS NOT NULL AND transaction_date < '{MD.HOLDOUT_START}'),
te AS (SELECT total_spent AS y FROM clean WHERE total_spent IS NOT NULL AND transaction_date >= '{MD.HOLDOUT_START}'),
b AS (SELECT quantile_cont(y, 0.5) AS m FROM tr),
e AS (SELECT CAST(y AS DECIMAL(18,2)) - CAST(m AS DECIMAL(18,2)) AS e, CAST(y AS DECIMAL(18,2)) AS yd FROM te, b),
bs AS (SELECT COUNT(*) AS n, CAST(SUM(abs(e)) AS DOUBLE) AS sae, CAST(SUM(e * e) AS DOUBLE) AS sse,
             CAST(SUM(yd) AS DOUBLE) AS sy, CAST(SUM(yd * yd) AS DOUBLE) AS syy,
             quantile_cont(CAST(abs(e) AS DOUBLE), 0.5) AS mae_med FROM e)
SELECT (SELECT m FROM b) AS baseline, n, round(sae / n, {DIGITS}) AS MAE, round(sqrt(sse / n), {DIGITS}) AS RMSE,
       round(1.0 - sse / (syy - sy * sy / n), {DIGITS}) AS R2, mae_med AS MedianAE
FROM bs"""))
def q_baseline_metrics(spark, sf_dir):
    c = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull())
    tr = c.where(F.col("transaction_date") < MD.HOLDOUT_START).select(F.col("total_spent").alias("y"))
    te = c.where(F.col("transaction_date") >= MD.HOLDOUT_START).select(F.col("total_spent").alias("y"))
    b = RK.exact_quantiles(tr, "y", [0.5]).select(F.col("q").alias("baseline"))
    e = te.crossJoin(F.broadcast(b)).select(
        "baseline", (F.col("y").cast("decimal(18,2)") - F.col("baseline").cast("decimal(18,2)")).alias("e"),
        F.col("y").cast("decimal(18,2)").alias("yd"))
    med = RK.exact_quantiles(e.select(F.abs("e").cast("double").alias("ae")), "ae", [0.5]).select(F.col("q").alias("MedianAE"))
    s = e.agg(F.first("baseline").alias("baseline"), F.count(F.lit(1)).alias("n"),
              F.sum(F.abs("e")).cast("double").alias("sae"), F.sum(F.col("e") * F.col("e")).cast("double").alias("sse"),
              F.sum("yd").cast("double").alias("sy"), F.sum(F.col("yd") * F.col("yd")).cast("double").alias("syy"))
    return s.crossJoin(med).select(
        "baseline", "n", rnd(F.col("sae") / F.col("n")).alias("MAE"), rnd(F.sqrt(F.col("sse") / F.col("n"))).alias("RMSE"),
        rnd(1.0 - F.col("sse") / (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))).alias("R2"), "MedianAE")


@register("top_decile_rows", _clean_then(f"""
, te AS (SELECT total_spent AS y FROM clean WHERE total_spent IS NOT NULL AND transaction_date >= '{MD.HOLDOUT_START}'),
p AS (SELECT quantile_cont(y, 0.9) AS p90 FROM te)
SELECT p90, COUNT(*) AS n FROM te, p WHERE y >= p90 GROUP BY p90"""))
def q_top_decile_rows(spark, sf_dir):
    te = (cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull() & (F.col("transaction_date") >= MD.HOLDOUT_START))
          .select(F.col("total_spent").alias("y")))
    p = RK.exact_quantiles(te, "y", [0.9]).select(F.col("q").alias("p90"))
    return te.crossJoin(F.broadcast(p)).where(F.col("y") >= F.col("p90")).groupBy("p90").agg(F.count(F.lit(1)).alias("n"))


def _bench(spark, sf_dir):
    return MD.benchmark(cleaned(spark, sf_dir))


@register("ridge_cv")
def q_ridge_cv(spark, sf_dir):
    return _bench(spark, sf_dir)["cv"]


@register("holdout_metrics")
def q_holdout_metrics(spark, sf_dir):
    r = _bench(spark, sf_dir)
    return r["holdout"].crossJoin(r["baseline"].select(F.col("MAE").alias("baseline_MAE"))).select(
        "*", F.lit(r["alpha"]).alias("selected_alpha"),
        ((F.col("baseline_MAE") - F.col("MAE")) / F.col("baseline_MAE")).alias("relative_MAE_improvement"))


@register("subgroup_metrics")
def q_subgroup_metrics(spark, sf_dir):
    return _bench(spark, sf_dir)["subgroups"]


@register("select_alpha")
def q_select_alpha(spark, sf_dir):
    r = _bench(spark, sf_dir)
    return r["cv"].where(F.col("alpha") == r["alpha"]).select("alpha", "mean_MAE", "sd_MAE")


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """Holdout scores of the selected Ridge, a random forest on the same features, the
    training-median baseline and the arithmetic identity price x quantity (a leakage
    oracle: it uses the target's components) (I12)."""
    r = _bench(spark, sf_dir)
    test_rows = (cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull()
                                              & (F.col("transaction_date") >= MD.HOLDOUT_START))
                 .select(F.col("total_spent").alias("y"),
                         (F.col("price_per_unit") * F.col("quantity")).alias("prediction"))
                 .where(F.col("prediction").isNotNull()))
    forest, _ = written_once(MD.fit_forest(r["train"]).transform(r["test"]).select("y", "prediction"), "forest-predictions")
    parts = [r["holdout"].withColumn("model", F.lit(f"ridge alpha={r['alpha']}")),
             MD.regression_metrics(forest).withColumn("model", F.lit("random forest (50 trees, depth 10)")),
             r["baseline"].withColumn("model", F.lit("training median")),
             MD.regression_metrics(test_rows).withColumn("model", F.lit("price x quantity (leaks target)"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "n", "MAE", "RMSE", "R2", "MedianAE")


@register("baseline_median", _clean_then(f"""
SELECT quantile_cont(total_spent, 0.5) AS baseline FROM clean
WHERE total_spent IS NOT NULL AND transaction_date < '{MD.HOLDOUT_START}'"""))
def q_baseline_median(spark, sf_dir):
    tr = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull() & (F.col("transaction_date") < MD.HOLDOUT_START))
    return RK.exact_quantiles(tr, "total_spent", [0.5]).select(F.col("q").alias("baseline"))


@register("time_order_index", _clean_then("""
SELECT transaction_id, ROW_NUMBER() OVER (ORDER BY transaction_date, transaction_id) - 1 AS idx
FROM clean WHERE total_spent IS NOT NULL"""))
def q_time_order_index(spark, sf_dir):
    df = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull()).select("transaction_id", "transaction_date")
    return RK.row_index(df, ["transaction_date", "transaction_id"]).select("transaction_id", "idx")


@register("split_overlap_dates", _clean_then(f"""
SELECT COUNT(*) AS overlapping_dates FROM (
  SELECT DISTINCT transaction_date FROM clean WHERE total_spent IS NOT NULL AND transaction_date < '{MD.HOLDOUT_START}'
  INTERSECT
  SELECT DISTINCT transaction_date FROM clean WHERE total_spent IS NOT NULL AND transaction_date >= '{MD.HOLDOUT_START}')"""))
def q_split_overlap_dates(spark, sf_dir):
    mf = cleaned(spark, sf_dir).where(F.col("total_spent").isNotNull())
    tr = mf.where(F.col("transaction_date") < MD.HOLDOUT_START).select("transaction_date")
    te = mf.where(F.col("transaction_date") >= MD.HOLDOUT_START).select("transaction_date")
    return tr.intersect(te).agg(F.count(F.lit(1)).alias("overlapping_dates"))
