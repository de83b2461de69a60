"""The maintained cube equals the cube of all facts, and an update touches only its months."""

import os

from pyspark.sql import functions as F

from tallyspark.operators import cleaning as C
from tallyspark.operators import cube_store as S
from tallyspark.operators import dashboard as D


def rows_of(raw_df, months, n=30, tag="t"):
    return C.clean(raw_df([(f"{tag}{i}", f"CUST_{i % 3}", ["A", "B", ""][i % 3], "I1", "2.5", str(1 + i % 3), "" if i % 7 == 0 else str(2.5 * (1 + i % 3)), "Cash",
                            ["Online", "In-store"][i % 2], f"{months[i % len(months)]}-{1 + i % 27:02d}" if months[i % len(months)] else "bad", "True") for i in range(n)]),
                   quantity_mode=False)


def same(spark, folder, store):
    want = sorted(map(repr, (tuple(r) for r in D.build_cube(spark.read.parquet(folder)).collect())))
    assert sorted(map(repr, (tuple(r) for r in S.read_cube(spark, store).collect()))) == want
    assert S.last_date_info(spark, store).collect() == D.last_date_info(spark.read.parquet(folder)).collect()


def stamps(store):
    return {m: {f: os.stat(f"{store}/cube/{m}/{f}").st_mtime_ns for f in os.listdir(f"{store}/cube/{m}")} for m in os.listdir(f"{store}/cube") if m.startswith("month=")}


def test_updates(spark, raw_df, tmp_path):
    folder, store = f"file:{tmp_path}/clean", str(tmp_path / "store")
    rows_of(raw_df, ["2024-01", "2024-02", None]).coalesce(1).write.parquet(folder)
    assert S.update(spark, folder, store) == [None, "2024-01", "2024-02"]
    same(spark, folder, store)
    assert S.update(spark, folder, store) == []
    before = stamps(store)
    rows_of(raw_df, ["2024-02", "2024-03"], tag="u").coalesce(1).write.mode("append").parquet(folder)  # an added file
    assert S.update(spark, folder, store) == ["2024-02", "2024-03"]
    same(spark, folder, store)
    after = stamps(store)
    assert after["month=2024-01"] == before["month=2024-01"] and after["month=2024-02"] != before["month=2024-02"]
    # A vanished file: the month that only it had goes.
    first = next(p for p in S.input_files(spark, folder).values() if spark.read.parquet(p).where("transaction_date like '2024-03%'").count())
    os.remove(first.replace("file:", "").replace("//", "/"))
    assert S.update(spark, folder, store) == ["2024-02", "2024-03"]
    same(spark, folder, store)
    assert "month=2024-03" not in stamps(store) and len(os.listdir(f"{store}/parts")) == len([f for f in os.listdir(f"{store}/parts") if not f.startswith("file_id")]) + 1


def test_interrupted_update_is_done_again(spark, raw_df, tmp_path, monkeypatch):
    folder, store = str(tmp_path / "clean"), str(tmp_path / "store")
    rows_of(raw_df, ["2024-01"]).write.parquet(folder)

    def stop(*_):
        raise KeyboardInterrupt
    with monkeypatch.context() as m:
        m.setattr(S, "write_text", stop)
        try:
            S.update(spark, folder, store)
        except KeyboardInterrupt:
            pass
    assert S.update(spark, folder, store) == ["2024-01"]
    same(spark, folder, store)


def test_queries_prune_months_and_read_no_facts(spark, raw_df, tmp_path):
    folder, store = str(tmp_path / "clean"), str(tmp_path / "store")
    rows_of(raw_df, ["2024-01", "2024-02", "2024-03"]).write.parquet(folder)
    S.update(spark, folder, store)
    cube, last = S.read_cube(spark, store), S.last_date_info(spark, store)
    for d in (D.kpi_summary(cube, "2024-01", "2024-02"), D.kpi_period_over_period(cube, "2024-02", "2024-03"), D.monthly_trend(cube, last, "2024-01", "2024-03"),
              D.category_breakdown(cube, "2024-01", "2024-02"), D.quantity_coverage(cube, "2024-01", "2024-02"), D.default_period(cube, last)):
        assert all("/store/cube" in f for f in d.inputFiles())
    plan = D.kpi_summary(cube, "2024-01", "2024-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    whole = D.build_cube(spark.read.parquet(folder))
    for f in (lambda c: D.kpi_summary(c, "2024-01", "2024-02"), lambda c: D.kpi_period_over_period(c, "2024-02", "2024-03")):
        assert f(cube).collect() == f(whole).collect()


def test_inverted_range_collapses(spark, raw_df, tmp_path):
    cube = D.build_cube(rows_of(raw_df, ["2024-01", "2024-02"]))
    assert D.kpi_summary(cube, "2024-02", "2024-01").collect() == D.kpi_summary(cube, "2024-02", "2024-02").collect()
    assert cube.agg(F.sum("rows")).first()[0] == 30
