"""The bootstrap's draws: exact multinomial counts from counter-based bits, against a plain Python version."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import resample as RS


def bits(digest, at):
    return int(digest[at - 1:at + 14], 16)


def ones(n, *counters):
    total = 0
    for k in range(-(-n // 120)):
        d = hashlib.md5(":".join(str(c) for c in (*counters, k)).encode()).hexdigest()
        left = n - 120 * k
        total += bin(bits(d, 1) & ((1 << max(0, min(left, 60))) - 1)).count("1") + bin(bits(d, 16) & ((1 << max(0, min(left - 60, 60))) - 1)).count("1")
    return total


def binomial(n, part, size, *counters):
    u, s, r = n, 0, part
    for i in range(RS.DIGITS):
        if not u:
            break
        kept = ones(u, *counters, i)
        one = 2 * r >= size
        s += (u - kept) if one else 0
        r = 2 * r - (size if one else 0)
        u = kept
    return s


def splits(rep, clusters, seed, bucket):
    out, todo = {}, [(0, -(-clusters // bucket), clusters)]
    while todo:
        lo, hi, n = todo.pop()
        if hi - lo == 1:
            out[lo] = n
            continue
        mid = (lo + hi) // 2
        border = lambda x: min(x * bucket, clusters)
        left = binomial(n, border(mid) - border(lo), border(hi) - border(lo), seed, rep, lo, hi)
        todo += [(lo, mid, left), (mid, hi, n - left)]
    return {b: n for b, n in out.items() if n}


@pytest.mark.parametrize("clusters,bucket", [(1, 4), (4, 4), (37, 4), (1000, 64)])
def test_splits_equal_plain_version(spark, clusters, bucket):
    got = {}
    for r in RS.split_draws(spark, 6, clusters, 7, bucket).collect():
        got.setdefault(r["rep"], {})[r["bucket"]] = r["n"]
    assert got == {rep: splits(rep, clusters, 7, bucket) for rep in range(6)}
    assert all(sum(v.values()) == clusters for v in got.values())


def test_counts_are_multinomial(spark):
    """Each bucket's share over many replicates: its mean and variance are those of a binomial."""
    clusters, bucket, reps = 90, 20, 3000
    counts = {}
    for r in RS.split_draws(spark, reps, clusters, 1, bucket).collect():
        counts.setdefault(r["bucket"], []).append(r["n"])
    for b, size in enumerate([20, 20, 20, 20, 10]):
        p, seen = size / clusters, counts[b] + [0] * (reps - len(counts[b]))
        mean = sum(seen) / reps
        var = sum((x - mean) ** 2 for x in seen) / reps
        assert abs(mean - clusters * p) < 5 * (clusters * p * (1 - p) / reps) ** 0.5
        assert abs(var / (clusters * p * (1 - p)) - 1) < 0.15


@pytest.mark.parametrize("limit", [10**9, 0])
def test_bootstrap_equals_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(RS, "BUCKET", 8)
    monkeypatch.setattr(RS, "BROADCAST_CLUSTERS", limit)  # both join forms
    rows = [(f"c{i % 21:02d}", ["Online", "In-store"][(i // 3) % 2], float(i % 13) + 0.25) for i in range(300)]
    rows += [("only", "Online", 5.0), (None, "Online", 9.0), ("none", "In-store", None)]
    got = RS.cluster_bootstrap_diff(spark.createDataFrame(rows, "customer_id string, location string, total_spent double"), reps=40, seed=3).first()
    sums = {}
    for c, loc, v in rows:
        if c is not None and v is not None:
            s = sums.setdefault(c, [0, 0, 0, 0])
            k = 0 if loc == "Online" else 2
            s[k] += round(v * 1_000_000)
            s[k + 1] += 1
    names = sorted(sums)
    diffs = []
    for rep in range(40):
        t = [0, 0, 0, 0]
        for b, n in splits(rep, len(names), 3, 8).items():
            size = min(8, len(names) - 8 * b)
            for j in range(n):
                x = bits(hashlib.md5(f"3:{rep}:d:{b}:{j // 4}".encode()).hexdigest(), 1 if j % 4 < 2 else 16)
                s = sums[names[8 * b + (x >> 30 if j % 2 == 0 else x & ((1 << 30) - 1)) % size]]
                t = [a + c for a, c in zip(t, s)]
        if t[1] and t[3]:
            diffs.append(t[0] / 1e6 / t[1] - t[2] / 1e6 / t[3])
    diffs.sort()

    def quantile(p):
        h = (len(diffs) - 1) * p
        k = int(h)
        return diffs[k] + (h - k) * (diffs[min(k + 1, len(diffs) - 1)] - diffs[k])
    assert (got["clusters"], got["replicates_used"], got["repetitions"]) == (len(names), len(diffs), 40)
    assert abs(got["ci_low"] - quantile(0.025)) < 1e-12 and abs(got["ci_high"] - quantile(0.975)) < 1e-12


def test_a_million_clusters(spark):
    """Draws for 10^6 clusters without an array or a shuffle of draws."""
    d = RS.split_draws(spark, 2, 1_000_000, 5)
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    per = d.groupBy("rep").agg(F.sum("n").alias("n"), F.count("*").alias("b")).collect()
    assert [r["n"] for r in per] == [1_000_000, 1_000_000] and all(r["b"] == -(-1_000_000 // RS.BUCKET) for r in per)
    assert Counter(r["rep"] for r in per) == {0: 1, 1: 1}
