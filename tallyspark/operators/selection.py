"""Exact order statistics by rounds of counting, for several quantiles and groups at once.

A position k of a group's sorted values is looked for in an interval of values. Each
round cuts every open interval into ``CELLS`` cells and counts the rows of each cell
(with its smallest and largest value) in one pass with partial aggregation; the cell
that holds the position becomes the next interval. Cells are evenly spaced in one
round and logarithmically in the next, so heavy tails do not slow the search down.
An interval is finished when it holds one value or at most ``LEAF_ROWS`` rows, which
a last pass sorts. No value table is written or shuffled: between rounds there are
only the targets (groups x quantiles), and a pass returns at most ``CELLS`` rows per
interval, whatever the number of rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import checkpoint_dir

CELLS = 1024
LEAF_ROWS = 4096
BROADCAST_INTERVALS = 100_000
MAX_ROUNDS = 200


def _cell(v: Column, lo: Column, hi: Column, logarithmic: bool) -> Column:
    """Number of the cell of ``v`` in [lo, hi]: never falls as v grows, 0 at lo and the last at hi."""
    # Halves, so that the width of the widest interval is finite.
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    if logarithmic:
        # The logarithm with the sign of the value; 746 is above the size of any finite double's logarithm.
        key = lambda x: F.signum(x) * F.when(x == 0, 0.0).otherwise(F.log(F.abs(x)) + 746)
        share = F.when(key(lo) == key(hi), share).otherwise((key(v) - key(lo)) / (key(hi) - key(lo)))
    return F.least(F.floor(share * CELLS).cast("int"), F.lit(CELLS - 1))


def _rows_in(facts: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """The rows of ``facts`` with each interval of their group that holds them."""
    if not by or intervals.count() <= BROADCAST_INTERVALS:
        intervals = F.broadcast(intervals)
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    if not by:
        return facts.join(intervals, inside)
    return facts.join(intervals, by).where(inside)


def _pick(targets: DataFrame, counted: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each target, the entry of its interval's counts that holds its position, and the rows below that entry."""
    w = Window.partitionBy(*by, "lo", "hi").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = counted.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return targets.join(below, [*by, "lo", "hi"]).where((F.col("k") >= F.col("below")) & (F.col("k") < F.col("below") + F.col("c")))


def select_positions(facts: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """(targets' columns less the interval, value): the value at position ``k`` of the group's rows ``v`` between ``lo`` and ``hi``.

    ``targets`` hold (by..., lo, hi, n, k) and any columns of their own; n is the number of rows in the interval."""
    own = [c for c in targets.columns if c not in (*by, "lo", "hi", "n", "k")]
    spark = facts.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tallyspark/selection-{uuid.uuid4().hex[:12]}"

    def written(df: DataFrame, name: str) -> DataFrame:
        # Not checkpoint(): that keeps the plan's size estimate, which would square from round to round.
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")
    state = written(targets, "targets")
    finished = (F.col("n") <= LEAF_ROWS) | (F.col("lo") == F.col("hi"))
    for turn in range(MAX_ROUNDS):
        left = state.agg(F.count_if(~finished).alias("open"), F.count_if(F.expr("lo < hi")).alias("several")).first()
        if not left["open"]:
            break
        open_ = state.where(~finished)
        cell = _cell(F.col("v"), F.col("lo"), F.col("hi"), logarithmic=turn % 2 == 1)
        counted = (_rows_in(facts, open_.select(*by, "lo", "hi").distinct(), by).groupBy(*by, "lo", "hi", cell.alias("cell"))
                   .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("first"), F.max("v").alias("last")))
        narrowed = _pick(open_, counted, by, "cell").select(*by, F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("c").alias("n"),
                                                            (F.col("k") - F.col("below")).alias("k"), *own)
        state = state.where(finished).unionByName(narrowed)
        state = written(state, f"round-{turn}")
    else:
        raise RuntimeError(f"quantile search did not end in {MAX_ROUNDS} rounds")
    found = state.where("lo = hi").select(*by, *own, F.col("lo").alias("value"))
    if left["several"]:
        small = state.where("lo < hi")
        counted = _rows_in(facts, small.select(*by, "lo", "hi").distinct(), by).groupBy(*by, "lo", "hi", "v").agg(F.count(F.lit(1)).alias("c"))
        found = found.unionByName(_pick(small, counted, by, "v").select(*by, *own, F.col("v").alias("value")))
    found = found.checkpoint()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def values_at(facts: DataFrame, positions: set[int], n: int, lo: float, hi: float) -> dict[int, float]:
    """The values at some positions of all rows ``v`` without groups: the same rounds, with the few intervals kept in the driver.

    A pass returns at most ``CELLS`` rows per interval, and there is at most one interval a position."""
    found: dict[int, float] = {}
    at = {k: (lo, hi, n, k) for k in positions}  # position -> interval, its rows, position in it

    def counts(intervals: set[tuple[float, float]], entry) -> dict[tuple[float, float], list]:
        # Intervals are cells of earlier rounds, so they have no value in common and a row is in one at most: no join.
        known = sorted(intervals)
        at_, e = F.lit(None).cast("int"), F.lit(None)
        for i, (a, b) in enumerate(known):
            inside = F.col("v").between(F.lit(a), F.lit(b))
            at_, e = F.when(inside, i).otherwise(at_), F.when(inside, entry(F.lit(a), F.lit(b))).otherwise(e)
        rows = facts.select("v", at_.alias("i"), e.alias("e")).where("i IS NOT NULL").groupBy("i", "e")
        out: dict[tuple[float, float], list] = {}
        for r in rows.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("first"), F.max("v").alias("last")).collect():
            out.setdefault(known[r["i"]], []).append(r)
        return {i: sorted(rs, key=lambda r: r["e"]) for i, rs in out.items()}
    for turn in range(MAX_ROUNDS):
        for k in [k for k, (a, b, _, _) in at.items() if a == b]:
            found[k] = at.pop(k)[0]
        if not at:
            return found
        # Intervals of few rows are read value by value; if all are, this is the last pass.
        last = all(m <= LEAF_ROWS // 4 for _, _, m, _ in at.values())
        cell = lambda a, b: F.col("v") if last else _cell(F.col("v"), a, b, logarithmic=turn % 2 == 1)  # noqa: B023, E731
        cells = counts({(a, b) for a, b, _, _ in at.values()}, cell)
        for k, (a, b, _, inner) in list(at.items()):
            below = 0
            for r in cells[a, b]:
                if inner < below + r["c"]:
                    at[k] = (r["first"], r["last"], r["c"], inner - below)
                    break
                below += r["c"]
    raise RuntimeError(f"quantile search did not end in {MAX_ROUNDS} rounds")


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., pi, p, q): linear-interpolated exact quantiles (numpy default), per group.

    Position h = (n - 1) p between its two neighbours. Null and NaN values and null groups are left out; a group without values has no rows.
    """
    by = list(by or [])
    present = F.col(col).isNotNull()
    for c in by:
        present = present & F.col(c).isNotNull()
    facts = df.where(present).select(*by, F.col(col).cast("double").alias("v")).where(~F.isnan("v"))
    if not by:
        one = facts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        n = one["n"]
        wanted = [(p, (n - 1) * p) for p in map(float, probs)] if n else []
        near = [(int(h), min(int(h) + 1, n - 1)) for _, h in wanted]
        value = values_at(facts, {k for ab in near for k in ab}, n, one["lo"], one["hi"]) if n else {}
        rows = [(i, p, value[a] + (h - int(h)) * (value[b] - value[a])) for i, ((p, h), (a, b)) in enumerate(zip(wanted, near))]
        return df.sparkSession.createDataFrame(rows, "pi int, p double, q double")
    stats = facts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    h = (F.col("n") - 1) * F.col("p")
    at = stats.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("pi", "p")).withColumn("frac", h - F.floor(h))
    low = F.floor(h).cast("long")
    both = at.select("*", F.posexplode(F.array(low, F.least(low + 1, F.col("n") - 1))).alias("side", "k"))
    found = select_positions(facts, both, by)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    pairs = found.groupBy(*by, "pi", "p", "frac").agg(side(0).alias("a"), side(1).alias("b"))
    return pairs.select(*by, "pi", "p", (F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))).alias("q"))
