"""Leakage-safe, time-ordered Ridge benchmark.

Prediction moment: product identity and channel known, quantity and total
not yet. Preprocessing (one-hot encoders, standardisation) is fitted inside
every fold on that fold's training rows only; alpha is chosen by expanding
time-series cross-validation on the training period; the chronological
holdout is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import forest
from tallyspark.operators.cleaning import MASKED_ITEM
from tallyspark.operators.ranks import exact_quantiles, row_index
from tallyspark.session import written_once

# Model inputs, target and the columns kept out of the features.
CATEGORICAL_FEATURES = ["category", "item", "location", "weekday", "quarter"]
NUMERIC_FEATURES = ["year", "month"]
FEATURES = CATEGORICAL_FEATURES + NUMERIC_FEATURES
TARGET = "total_spent"
EXCLUDED = ["price_per_unit", "quantity", "payment_method", "discount_applied", "customer_id",
            "transaction_id", "item_imputed", "price_imputed", "arithmetic_issue", "total_outlier_iqr",
            "missing_pattern"]
ALPHAS = [0.1, 1.0, 10.0, 100.0]
HOLDOUT_START = "2000-06-01"
SMALL_FEATURES = [c for c in CATEGORICAL_FEATURES if c != "item"]
MAX_LEVELS = 1000  # per feature other than the item


def model_frame(clean: DataFrame) -> DataFrame:
    """Rows with a target, imputed items masked, positional index ``idx`` over (date, id)."""
    df = clean.where(F.col(TARGET).isNotNull())
    df = df.withColumn("item", F.when(F.col("item_imputed") == "Yes", F.lit(MASKED_ITEM)).otherwise(F.col("item")))
    df = df.select("transaction_id", "transaction_date", *FEATURES, F.col(TARGET).cast("double").alias("y"))
    return row_index(df, ["transaction_date", "transaction_id"])


def chronological_split(mf: DataFrame, start: str = HOLDOUT_START) -> tuple[DataFrame, DataFrame]:
    """Training rows before ``start``, holdout rows from it (I2); the date cut is pushed into the plan."""
    return mf.where(F.col("transaction_date") < start), mf.where(F.col("transaction_date") >= start)


def fold_ranges(n: int, n_splits: int = 3) -> list[tuple[int, int, int]]:
    """Expanding-window folds: (train_end, val_start, val_end) as half-open index ranges."""
    size = n // (n_splits + 1)
    if size < 1:
        raise ValueError("Too few rows for the requested number of folds")
    first = n - n_splits * size
    return [(first + i * size, first + i * size, first + (i + 1) * size) for i in range(n_splits)]


def leakage_guard(features: list[str] | None = None) -> list[tuple[str, bool]]:
    """(feature, allowed) pairs; raises if a target component or excluded column is a feature."""
    feats = features or FEATURES
    bad = set(feats) & (set(EXCLUDED) | {TARGET})
    if bad:
        raise ValueError(f"Leaking features: {sorted(bad)}")
    return [(f, True) for f in feats]


@dataclass
class FittedRidge:
    """Ridge models, one per alpha, on one training set: ``beta[k]`` belongs to ``basis``, the item effects follow from ``items``."""
    alphas: list[float]
    basis: list[Column]
    beta: list[list[float]]
    items: DataFrame

    def predictions(self, df: DataFrame) -> DataFrame:
        """``df`` with prediction_0, prediction_1, ... per alpha; levels that training has not seen add nothing."""
        def effect(k):
            dot = sum((F.lit(c) * F.get("b", F.lit(j)) for j, c in enumerate(self.beta[k])), F.lit(0.0))
            return ((F.col("r") - dot) / (F.col("n") + F.lit(self.alphas[k]))).alias(f"_effect_{k}")

        effects = self.items.select(F.col("item").alias("_fitted_item"), *[effect(k) for k in range(len(self.alphas))])
        x = df.join(effects, df["item"].eqNullSafe(F.col("_fitted_item")), "left")
        for k, beta in enumerate(self.beta):
            linear = sum((F.lit(c) * e for c, e in zip(beta, self.basis)), F.lit(0.0))
            x = x.withColumn(f"prediction_{k}", linear + F.coalesce(F.col(f"_effect_{k}"), F.lit(0.0)))
        return x.drop("_fitted_item", *[f"_effect_{k}" for k in range(len(self.alphas))])

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the prediction of the first alpha."""
        return self.predictions(df).withColumnRenamed("prediction_0", "prediction").drop(
            *[f"prediction_{k}" for k in range(1, len(self.alphas))])


def _levels(train: DataFrame) -> dict[str, list]:
    """The levels of each categorical but the item, null included; a wider feature raises and is never cut."""
    sets = train.agg(*[F.collect_set(F.struct(F.col(c).alias("v"))).alias(c) for c in SMALL_FEATURES]).first()
    levels = {c: sorted((r["v"] for r in sets[c]), key=lambda v: (v is None, v)) for c in SMALL_FEATURES}
    wide = [c for c, v in levels.items() if len(v) > MAX_LEVELS]
    if wide:
        raise ValueError(f"More than {MAX_LEVELS} levels in {wide}")
    return levels


def _gram(sums: DataFrame, alphas: list[float | None], p: int) -> np.ndarray:
    """Per alpha the sum over groups of alpha s s' / (n (n + alpha)), and of s s' / n for None; s holds the p sums of the
    basis and that of y. Each task sends (p + 1)^2 numbers per alpha, however many groups it reads."""
    def run(batches):
        total = np.zeros((len(alphas), p + 1, p + 1))
        for t in batches:
            n = t.column(0).to_numpy(zero_copy_only=False).astype(float)
            b = t.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(n), p)
            s = np.column_stack([b, t.column(1).to_numpy(zero_copy_only=False)])
            for k, a in enumerate(alphas):
                w = 1.0 / n if a is None else a / (n * (n + a))
                total[k] += (s * w[:, None]).T @ s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros((len(alphas), p + 1, p + 1))
    for r in sums.select("n", "r", "b").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out.flat[r["at"]] = r["v"]
    return out


def ridge_cells(train: DataFrame, ends: list[int] | None = None) -> DataFrame:
    """(segment, item, the other features, n, r): rows and sum of y of each combination, written once; ``segment`` is how
    many of ``ends`` are at most the row's position, so the training rows of every fold are some segments."""
    segment = sum(((F.col("idx") >= end).cast("int") for end in ends or []), F.lit(0))
    keyed = train.select(segment.alias("segment"), "item", *SMALL_FEATURES, *NUMERIC_FEATURES, "y")
    return written_once(keyed.groupBy("segment", "item", *SMALL_FEATURES, *NUMERIC_FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("r")), "cells")[0]


def fit_ridges(train: DataFrame, alphas: list[float], cells: DataFrame | None = None) -> FittedRidge:
    """Minimises ||y - Xw - b||^2 + alpha ||w||^2, the intercept b unpenalised, for all alphas from the same two aggregates.

    X has one column per level of the categoricals and the standardised numerics. The
    item block of the normal equations is diagonal, so it is eliminated: with n, r and
    B the row count, the sum of y and the sums of the other columns of an item, the other
    coefficients solve a system of their own (some tens of unknowns), and the item's
    effect is (r - B beta) / (n + alpha). Item labels never leave the executors. The
    system is written as the scatter within items, whose intercept row is exactly 0, plus
    the sum of alpha B B' / (n (n + alpha)), which avoids cancellation for large items.

    ``cells`` are those of ``train`` (``ridge_cells``), if they are there already; ``train`` is not read then.
    """
    # Rows are first added up per item and combination of levels, so only narrow rows are shuffled and no item, however
    # frequent, has more rows than there are combinations; the wide sums are made per item behind that, without a shuffle.
    cells = ridge_cells(train) if cells is None else cells
    number = {c: F.col(c).cast("double") for c in NUMERIC_FEATURES}
    weight = {c: F.sum(F.when(x.isNotNull(), F.col("n"))) for c, x in number.items()}
    stats = cells.agg(F.sum("n").alias("n"), *[(F.sum(x * F.col("n")) / weight[c]).alias(f"m_{c}") for c, x in number.items()]).first().asDict()
    if not stats["n"]:
        raise ValueError("No training rows")
    off = {c: x - F.lit(stats[f"m_{c}"]) for c, x in number.items()}
    stats |= cells.agg(*[F.sqrt(F.sum(d * d * F.col("n")) / weight[c]).alias(f"s_{c}") for c, d in off.items()]).first().asDict()
    basis = [F.lit(1.0)]
    for c, values in _levels(cells).items():
        basis += [F.when(F.col(c).eqNullSafe(F.lit(v)), 1.0).otherwise(0.0) for v in values]
    basis += [F.coalesce((F.col(c).cast("double") - F.lit(float(stats[f"m_{c}"] or 0.0))) / F.lit(float(stats[f"s_{c}"] or 1.0)), F.lit(0.0))
              for c in NUMERIC_FEATURES]
    p = len(basis)

    features = [*SMALL_FEATURES, *NUMERIC_FEATURES]

    def sums(frame, *keys):
        return frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("r").alias("r"), F.array(*[F.sum(e * F.col("n")) for e in basis]).alias("b"))

    items, _ = written_once(sums(cells.repartition("item"), "item"), "items")
    combined = cells.groupBy(*features).agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    whole = _gram(combined.select("n", "r", F.array(*[e * F.col("n") for e in basis]).alias("b")), [None], p)[0]
    by_item = _gram(items, [None, *alphas], p)
    within = whole - by_item[0]
    within[0, :] = within[:, 0] = 0.0
    beta = []
    for a, between in zip(alphas, by_item[1:]):
        m = within + between
        penalty = np.diag([0.0] + [float(a)] * (p - 1))
        beta.append([float(v) for v in np.linalg.solve(m[:p, :p] + penalty, m[:p, p])])
    return FittedRidge([float(a) for a in alphas], basis, beta, items)


def fit_ridge(train: DataFrame, alpha: float, cells: DataFrame | None = None) -> FittedRidge:
    return fit_ridges(train, [alpha], cells)


def fit_forest(train: DataFrame, num_trees: int = 50, max_depth: int = 10, seed: int = 42) -> forest.FittedForest:
    """Random-forest regressor on the same encoding (one-hot categoricals, numerics).

    The archived comparison model; trees see one binary feature per level, so
    no category needs more bins than two. ``train`` has the positions ``idx`` of its rows.
    """
    return forest.fit(train, _levels(train), NUMERIC_FEATURES, num_trees, max_depth, seed)


def regression_metrics(pred: DataFrame, y: str = "y", yhat: str = "prediction", by: str | None = None) -> DataFrame:
    """MAE, RMSE, R2 and median absolute error, optionally per group (I8).

    R2 is 1 - SSE / SST (1 if SST is 0 and SSE is 0, else 0 when SST is 0).
    """
    e = F.col(y) - F.col(yhat)
    keys = [by] if by else []
    g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("MAE"),
                                F.sqrt(F.avg(e * e)).alias("RMSE"), F.sum(e * e).alias("_sse"),
                                (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"))
    med = exact_quantiles(pred.select(*keys, F.abs(e).alias("_ae")), "_ae", [0.5], by=keys) \
        .select(*keys, F.col("q").alias("MedianAE"))
    g = g.join(med, keys) if keys else g.crossJoin(med)
    r2 = F.when(F.col("_sst") > 0, 1.0 - F.col("_sse") / F.col("_sst")) \
          .otherwise(F.when(F.col("_sse") == 0, 1.0).otherwise(0.0))
    return g.select(*keys, "n", "MAE", "RMSE", r2.alias("R2"), "MedianAE")


def ridge_cv(train: DataFrame, alphas: list[float] | None = None, n_splits: int = 3, cells: DataFrame | None = None) -> DataFrame:
    """Per alpha: fold MAEs, their mean and sample sd (I6). ``cells`` are those of ``train`` cut at the ends of the folds' training rows."""
    alphas = alphas or ALPHAS
    folds = fold_ranges(train.count(), n_splits)
    cells = ridge_cells(train, [end for end, _, _ in folds]) if cells is None else cells
    maes = [[] for _ in alphas]
    for i, (tr_end, v0, v1) in enumerate(folds):
        model = fit_ridges(train.where(F.col("idx") < tr_end), alphas, cells.where(F.col("segment") <= i))
        pred = model.predictions(train.where((F.col("idx") >= v0) & (F.col("idx") < v1)))
        scores = pred.agg(*[F.avg(F.abs(F.col("y") - F.col(f"prediction_{k}"))) for k in range(len(alphas))]).first()
        for k, v in enumerate(scores):
            maes[k].append(float(v))
    rows = []
    for a, m in zip(alphas, maes):
        mean = sum(m) / len(m)
        sd = (sum((v - mean) ** 2 for v in m) / (len(m) - 1)) ** 0.5 if len(m) > 1 else 0.0
        rows.append((float(a), m, mean, sd))
    return train.sparkSession.createDataFrame(rows, "alpha double, fold_MAE array<double>, mean_MAE double, sd_MAE double")


def select_alpha(cv: DataFrame) -> float:
    """Alpha with the lowest mean MAE; first in grid order wins ties."""
    best = None
    for r in cv.collect():
        if best is None or r["mean_MAE"] < best["mean_MAE"]:
            best = r
    return float(best["alpha"])


def benchmark(clean: DataFrame, start: str = HOLDOUT_START, alphas: list[float] | None = None):
    """Full benchmark: split, CV, refit, holdout and baseline metrics, subgroups.

    The model frame is written once to the shared checkpoint folder: every
    fit reads its columns of it, and its lineage (the whole cleaning plan) is cut.
    """
    leakage_guard()
    mf, _ = written_once(model_frame(clean), "model-frame")
    train, test = chronological_split(mf, start)
    if train.limit(1).count() == 0 or test.limit(1).count() == 0:
        raise ValueError("No rows before or from the holdout start")
    cells = ridge_cells(train, [end for end, _, _ in fold_ranges(train.count())])
    cv = ridge_cv(train, alphas, cells=cells)
    alpha = select_alpha(cv)
    model = fit_ridge(train, alpha, cells)
    # Each metric reads the predictions several times.
    pred, _ = written_once(model.transform(test).select("transaction_id", "item", "y", "prediction"), "predictions")
    med = exact_quantiles(train, "y", [0.5]).select(F.col("q").alias("baseline"))
    base = pred.crossJoin(F.broadcast(med)).select("y", F.col("baseline").alias("prediction"))
    p90 = exact_quantiles(test, "y", [0.9]).select(F.col("q").alias("p90"))
    tagged = (pred.crossJoin(F.broadcast(p90))
                  .select("y", "prediction", F.explode(F.array(
                      F.when(F.col("item") != MASKED_ITEM, F.lit("original_item_rows")),
                      F.when(F.col("item") == MASKED_ITEM, F.lit("item_unavailable_rows")),
                      F.when(F.col("y") >= F.col("p90"), F.lit("top_10pct_value_rows")))).alias("subgroup"))
                  .where(F.col("subgroup").isNotNull()))
    return {"cv": cv, "alpha": alpha, "holdout": regression_metrics(pred), "baseline": regression_metrics(base),
            "baseline_value": med, "subgroups": regression_metrics(tagged, by="subgroup"), "train": train,
            "test": test, "predictions": pred}
