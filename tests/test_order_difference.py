"""Positions, table differences and report texts on small fixtures."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.difference import differing_ranges, table_difference
from tallyspark.operators.ordering import with_position


def test_positions_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, -2.0, None, 0.0]), i) for i in range(400)] + [("a", 1.5, 7)] * 3
    got = with_position(spark.createDataFrame(rows, "k string, v double, i int").repartition(7), [("v", "desc"), ("k", "asc")]).collect()
    key = lambda r: (r["v"] is None, -(r["v"] or 0.0), r["k"] is None, r["k"] or "", r["i"])
    assert [r["position"] for r in sorted(got, key=lambda r: r["position"])] == list(range(1, len(rows) + 1))
    assert [key(r) for r in sorted(got, key=lambda r: r["position"])] == sorted(key(r) for r in got)
    with pytest.raises(ValueError):
        with_position(spark.createDataFrame(rows, "k string, v double, i int"), [("v", "down")])
    assert with_position(spark.createDataFrame([], "k string"), [("k", "asc")]).count() == 0


def test_difference_equals_bags(spark):
    rng = random.Random(3)
    base = [(i, rng.choice(["x", "y", None]), rng.choice([1.0, None])) for i in range(500)] + [(3, "x", 1.0)] * 4 + [(None, None, None)] * 2
    other = [r for k, r in enumerate(base) if k % 97] + [(1000, None, None), (5, "z", 1.0), (3, "x", 1.0), (3, "x", 1.0)]
    schema = "k int, s string, v double"
    a, b = spark.createDataFrame(base, schema), spark.createDataFrame(other, schema).repartition(5)
    want = Counter(base)
    want.subtract(Counter(other))
    got = {(r["k"], r["s"], r["v"]): r["copies"] * (1 if r["side"] == "left_only" else -1) for r in table_difference(a, b, ["k"]).collect()}
    assert got == {r: n for r, n in want.items() if n}
    assert differing_ranges(a, b, ["k"]).count() < 20  # most ranges are never looked at again
    assert table_difference(a, a.repartition(3), ["k"]).count() == 0
    # The same values in other columns are another row.
    swapped = a.select("k", F.when(F.col("s") == "x", None).otherwise(F.col("s")).alias("s"), "v")
    assert table_difference(a, swapped, ["k"]).where("side = 'left_only'").agg(F.sum("copies")).first()[0] == Counter(r[1] for r in base)["x"]
    with pytest.raises(ValueError):
        table_difference(a, b.withColumn("v", F.col("v").cast("float")), ["k"])


def test_difference_in_turns_equals_bags_and_frees_its_shuffles(spark, monkeypatch):
    """Many differing rows are never in a shuffle all at once; nothing is lost or doubled between the turns."""
    from tallyspark.operators import difference as D

    monkeypatch.setattr(D, "TURN_ROWS", 150)
    rng = random.Random(5)
    base = [(rng.choice([None, "dup", *"abcdefgh"]) if i % 5 == 0 else f"k{i}", rng.choice(["x", None]), float(i % 7)) for i in range(900)]
    other = [(k, s, v + 1) if i % 3 == 0 else (k, s, v) for i, (k, s, v) in enumerate(base)] + base[:9] * 2
    a, b = (spark.createDataFrame(rows, "k string, s string, v double").repartition(3) for rows in (base, other))
    written, write = [], D.write_table
    monkeypatch.setattr(D, "write_table", lambda df, path, mode: (written.append(path), write(df, path, mode)))
    want = Counter(base)
    want.subtract(Counter(other))
    got = Counter()
    for r in table_difference(a, b, ["k"]).collect():
        got[r["k"], r["s"], r["v"]] += r["copies"] * (1 if r["side"] == "left_only" else -1)
    assert got == Counter({r: n for r, n in want.items() if n})
    assert 4 < len(written) <= D.MAX_TURNS and len(set(written)) == 1


def test_shuffles_of_a_written_table_are_freed(spark, tmp_path):
    """A table's write leaves no shuffle behind, and the session's setting is as before."""
    from tallyspark.session import write_table

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    kept = tracker.shuffleStatuses().size()
    df = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    write_table(df, str(tmp_path / "t"))
    assert tracker.shuffleStatuses().size() <= kept
    assert spark.conf.get(key, None) == before
    assert spark.read.parquet(str(tmp_path / "t")).count() == df.count() == 7
