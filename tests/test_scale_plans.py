"""Plans that must hold at size: parsing once, numbering without a window over the rows, narrow shuffles below the Ridge sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import text as X
from tallyspark.operators import cleaning as C
from tallyspark.operators import model as MD
from tallyspark.operators import ranks as RK
from tallyspark.schema import RAW_COLUMNS


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def raw_rows(spark):
    rows = [(f"t{i}", "c1", "a", None if i == 3 else "Item_1", "2.5", "2", "5.0", "Cash", "Online", "2000-01-31", "True") for i in range(8)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS))


def test_cleaning_reads_parsed_values_and_parses_nothing_again(spark):
    out = C.clean(raw_rows(spark), quantity_mode=False)
    assert not [w for w in ("regexp_replace", "RLIKE") if w in plan(out)]
    assert {(r["item"], r["item_imputed"], r["total_spent"]) for r in out.collect()} == {("Item_1", "No", 5.0), ("Item_1", "Yes", 5.0)}


def test_strip_text_of_plain_and_of_odd_texts(spark):
    texts = [None, "", "a", "Item_1", "  a\t\n b ", "a  b", " x　", "café", "\u0001a", "\u001fa\u001c", "a b", "~!", " "]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.strip_text(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in found} == {i: t if t is None else " ".join(t.split()) for i, t in enumerate(texts)}


def test_row_index_numbers_rows_without_a_window_over_them(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("d"), F.when(F.col("id") % 11 > 0, F.xxhash64("id")).alias("h"), "id").repartition(5)
    out = RK.row_index(df, ["d", "h"])
    assert "row_number" not in plan(out)
    rows = sorted(out.collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == list(range(5000)) and {r["id"] for r in rows} == set(range(5000))
    key = [(r["d"], r["h"] is not None, r["h"] or 0) for r in rows]
    assert key == sorted(key)


def test_ridge_sums_of_an_item_are_not_shuffled(spark, monkeypatch):
    written, seen = MD.written_once, {}
    monkeypatch.setattr(MD, "written_once", lambda df, name: (seen.setdefault(name, df), written(df, name))[1])
    train = spark.range(600).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 50)).alias("item"), F.when(F.col("id") % 5 > 0, F.lit("a")).alias("category"),
        F.when(F.col("id") % 3 == 0, "Online").otherwise("In-store").alias("location"), F.lit("Monday").alias("weekday"), F.lit("Q1").alias("quarter"),
        F.lit(2000).alias("year"), (F.col("id") % 3).cast("int").alias("month"), (F.col("id") % 13).cast("double").alias("y"))
    model = MD.fit_ridges(train, [1.0])
    text = seen["items"]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "REPARTITION_BY_COL" in text
    n = {r["item"]: r["n"] for r in model.items.collect()}
    assert n["hot"] == 300 and sum(n.values()) == 600 and len(n) == 26
