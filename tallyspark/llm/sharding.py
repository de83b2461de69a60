"""Sharding by histogram sort.

Every row has a 64-bit key: the upper 40 bits hash the text, the lower 24 bits
hash the doc_id, so equal texts are neighbours and a large group of copies can
still be cut. Rounds of exact counting find the keys that cut the table into
shards of equal bytes (and each shard into smaller buckets): each partition
counts bytes and rows below all candidate keys (probes), the counts are added
up, and every open interval shrinks to the pair of probes around its target.
A boundary is done when the bytes below it are within ``tolerance`` of the
target, or when nothing lies between its two probes. Then the rows are
exchanged once, by bucket, and sorted inside it.

The driver holds one number per boundary and probe (shards x buckets x probes),
whatever the input size. Probes stay on group borders (lower bits zero) while
the interval allows it, so a group of copies is only cut when it is larger than
the tolerance.

Defined cases. Null text: 8 bytes, one group; null doc_id hashes like any value.
Rows with equal text and doc_id share a key and stay in one shard. Rows of equal
key are ordered by doc_id, then by a hash of the whole row. Empty table: no rows.
Input columns named like an added one give way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import free_name, saved, without

LOW_BITS = 24
OVERHEAD_BYTES = 8


def row_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD_BYTES).cast("long")


def sort_key(text: Column, doc_id: Column) -> Column:
    """Signed 64-bit key: text hash above, doc_id hash below."""
    high = F.shiftleft(F.shiftright(F.xxhash64(text), LOW_BITS), LOW_BITS)
    low = F.xxhash64(F.lit("id"), doc_id).bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    return high.bitwiseOR(low)


def count_below(keyed: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with key < probe, for each of the sorted probes."""
    edges = np.asarray(probes, dtype=np.int64)

    def partial(batches):
        size = np.zeros(len(edges) + 1, dtype=np.int64)
        rows = np.zeros(len(edges) + 1, dtype=np.int64)
        for pdf in batches:
            cell = np.searchsorted(edges, pdf["key"].to_numpy(np.int64), side="right")
            np.add.at(size, cell, pdf["size"].to_numpy(np.int64))
            rows += np.bincount(cell, minlength=len(edges) + 1)
        hit = np.flatnonzero(rows)
        yield pd.DataFrame({"cell": hit, "size": size[hit], "rows": rows[hit]})

    # At most len(edges) + 1 rows come back, whatever the input size.
    cells = (keyed.select("key", "size").mapInPandas(partial, "cell long, size long, rows long")
             .groupBy("cell").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect())
    size = np.zeros(len(edges) + 1, dtype=np.int64)
    rows = np.zeros(len(edges) + 1, dtype=np.int64)
    for r in cells:
        size[r["cell"]], rows[r["cell"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def probes_between(lo: list[int], hi: list[int], target: int, reach: int) -> set[int]:
    """Candidate keys strictly inside two [key, bytes below, ...]: where bytes would put the target if they were spread
    evenly, and on both sides of it at halving distances. They stay on group borders while the interval holds any."""
    step = 1 << LOW_BITS if (hi[0] - lo[0]) >> LOW_BITS > 1 else 1
    first, last = lo[0] // step + 1, -(-hi[0] // step) - 1
    if last < first:
        return set()
    middle = first + (last - first) * (target - lo[1]) // max(1, hi[1] - lo[1])
    around = {middle, (first + last) // 2}
    for j in range(1, reach + 1):
        d = (last - first) >> j
        around |= {middle - d, middle + d, middle - 1, middle + 1}
        if d == 0:
            break
    return {min(max(p, first), last) * step for p in around}


def find_boundaries(keyed: DataFrame, targets: list[tuple[int, int]], total_bytes: int, total_rows: int,
                    reach: int = 16, rounds: int = 64) -> list[tuple[int, int, int]]:
    """For each (bytes, tolerance): the key with about so many bytes below it, the bytes and the rows below it."""
    # [key, bytes below, rows below] on both sides of each target
    lo = [[-(1 << 63), 0, 0] for _ in targets]
    hi = [[(1 << 63) - 1, total_bytes, total_rows] for _ in targets]
    nearest = lambda i: min(lo[i], hi[i], key=lambda x: (abs(x[1] - targets[i][0]), x[0]))
    for _ in range(rounds):
        tried: set[int] = set()
        for i, (t, tolerance) in enumerate(targets):
            if abs(nearest(i)[1] - t) > tolerance and hi[i][2] - lo[i][2] > 1:
                tried |= probes_between(lo[i], hi[i], t, reach)
        if not tried:
            break
        edges = np.array(sorted(tried), dtype=np.int64)
        size, rows = count_below(keyed, edges)
        for i, (t, tolerance) in enumerate(targets):
            if abs(nearest(i)[1] - t) <= tolerance:
                continue
            j = int(np.searchsorted(size, t, side="right"))  # the first probe with more than t bytes below it
            for k in (j - 1, j):
                if 0 <= k < len(edges) and lo[i][0] < edges[k] < hi[i][0]:
                    at = [int(edges[k]), int(size[k]), int(rows[k])]
                    (lo if at[1] <= t else hi)[i] = at
    return sorted(tuple(nearest(i)) for i in range(len(targets)))


def shard_by_bytes(docs: DataFrame, n_shards: int, text: str = "text", doc_id: str = "doc_id",
                   buckets_per_shard: int = 16, tolerance: float = 0.002) -> DataFrame:
    """``docs`` with ``size``, ``shard`` (0 to n_shards - 1, near equal bytes) and ``slot`` (gapless from 0 in a shard).

    ``tolerance`` is the permitted error of a shard boundary as a share of a
    shard's bytes. ``buckets_per_shard`` sets how finely a shard is dealt out
    to tasks; it does not change the result.
    """
    docs = without(docs, ["size", "shard", "slot"])
    keyed = saved(docs.select(sort_key(F.col(text), F.col(doc_id)).alias("key"), row_bytes(F.col(text)).alias("size")))
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = n_shards * buckets_per_shard
    shard_bytes = total[0] / n_shards
    # Inner boundaries only deal out work, so a quarter of a bucket is near enough.
    exact = int(shard_bytes * tolerance)
    targets = [(round(total[0] * b / n_buckets), int(total[0] / n_buckets / 4) if b % buckets_per_shard else exact) for b in range(1, n_buckets)]
    found = find_boundaries(keyed, targets, total[0], total[1])
    main = [found[b - 1] for b in range(1, n_buckets) if b % buckets_per_shard == 0]
    keys, rows = [k for k, _, _ in main], [r for _, _, r in main]
    edges = sorted({(k, r) for k, _, r in found})
    edge_keys = np.array([k for k, _ in edges], dtype=np.int64)
    starts = np.array([0, *[r for _, r in edges]], dtype=np.int64)
    cuts = np.array(keys, dtype=np.int64)
    below = np.array([0, *rows], dtype=np.int64)

    @F.pandas_udf("struct<bucket:int,shard:int,before:long>")
    def place(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy(np.int64)
        bucket = np.searchsorted(edge_keys, k, side="right")
        shard = np.searchsorted(cuts, k, side="right")
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "shard": shard.astype(np.int32),
                             "before": starts[bucket] - below[shard]})

    key, at = free_name(docs, "__key"), free_name(docs, "__at")
    out = (docs.withColumn(key, sort_key(F.col(text), F.col(doc_id)))
           .withColumn(at, place(F.col(key))))
    within = Window.partitionBy(F.col(f"{at}.bucket")).orderBy(
        F.col(key), F.col(doc_id), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")]))
    return (out.withColumn("slot", (F.col(f"{at}.before") + F.row_number().over(within) - 1).cast("long"))
            .withColumn("shard", F.col(f"{at}.shard"))
            .withColumn("size", row_bytes(F.col(text)))
            .drop(key, at))
