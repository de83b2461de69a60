"""Cluster bootstrap of a difference of channel means (H9, D3).

Facts are reduced once to partial sums per cluster. A replicate draws K clusters
with replacement; how often each cluster is drawn is a multinomial count, and it
is made by binary splitting: the K draws fall on buckets of ``BUCKET`` clusters
by halving the bucket range, where the left half gets a binomial share of the
draws, until each bucket of each replicate knows its number of draws. That is a
chain of row-local steps over R x K / ``BUCKET`` rows: no array of K draws, no
shuffle of draws. Then the shares of a bucket meet its partial sums (at most
``BUCKET`` rows) in one group, which makes its own draws and counts them per
cluster, and only one row of sums per replicate and bucket is shuffled.

All randomness is counter based: the bits are MD5 of (seed, replicate, bucket
range, step), so the result does not depend on partitioning, task retries or the
engine; the same steps exist in SQL. A binomial(n, p) is exact for p = left /
size: the draws compare random bits with the binary digits of p, each digit
decides half of the rest. The generator is not NumPy's, so intervals agree with
the reference only statistically.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.ranks import exact_quantiles, row_index
from tallyspark.session import checkpoint_dir

BUCKET = 512
BROADCAST_CLUSTERS = 250_000  # up to so many clusters there are few buckets, so each bucket's clusters are copied to SLICES groups
SLICES = 16
DIGITS = 48  # binary digits of p that are compared; a draw is undecided after them with probability 2^-48 and goes right
MICRO = 1_000_000  # money is summed in millionths, exactly


# The expressions are Spark SQL text: some hundred Column calls per level would take longer to build than to run.
# A lambda has no common subexpressions, so a value that is used twice is bound once, as the only element of an array.

def random_bits(digest: str, at: int) -> str:
    """60 of an MD5 digest's bits, from hexadecimal digit ``at`` on."""
    return f"cast(conv(substring({digest}, {at}, 15), 16, 10) AS bigint)"


def ones_among(n: str, counters: str) -> str:
    """How many of ``n`` random bits are one; each digest gives 120 bits."""
    def ones(at: int, bits: str) -> str:
        return f"bit_count({random_bits('digest', at)} & (shiftleft(1L, cast(greatest(least({bits}, 60L), 0L) AS int)) - 1L))"
    return (f"aggregate(sequence(0L, ({n} - 1) div 120), 0L, (total, k) -> total + transform(array(md5(concat_ws(':', {counters}, k))), "
            f"digest -> {ones(1, f'{n} - k * 120')} + {ones(16, f'{n} - k * 120 - 60')})[0])")


def binomial(n: str, part: str, size: str, counters: str) -> str:
    """Binomial(n, part / size), exact, from the counters' bits."""
    # A draw whose bit is one stays undecided; the others are below p if p's digit is one, above it if not.
    return (f"aggregate(sequence(0, {DIGITS - 1}), named_struct('u', {n}, 's', 0L, 'r', {part}), "
            f"(state, i) -> CASE WHEN state.u = 0 THEN state ELSE transform(array({ones_among('state.u', f'{counters}, i')}), kept -> named_struct("
            f"'u', kept, 's', state.s + IF(2 * state.r >= {size}, state.u - kept, 0L), 'r', 2 * state.r - IF(2 * state.r >= {size}, {size}, 0L)))[0] END, "
            "state -> state.s)")


def split_draws(spark: SparkSession, reps: int, clusters: int, seed: int, bucket: int = BUCKET) -> DataFrame:
    """(rep, bucket, n): how many of a replicate's ``clusters`` draws fall on each bucket; buckets without draws are absent."""
    buckets = -(-clusters // bucket)
    border = lambda x: f"least(({x}) * {bucket}L, {clusters}L)"
    middle = "(lo + hi) div 2"
    left = binomial("n", f"{border(middle)} - {border('lo')}", f"({border('hi')} - {border('lo')})", f"'{seed}', rep, lo, hi")
    halves = (f"IF(hi - lo > 1, array(struct(lo, {middle} AS hi, m AS n), struct({middle} AS lo, hi, n - m AS n)), array(struct(lo, hi, n)))")
    rows = spark.range(reps).selectExpr("id AS rep", "0L AS lo", f"{buckets}L AS hi", f"{clusters}L AS n")
    for _ in range((buckets - 1).bit_length()):
        # inline_outer, as the optimizer adds no filter on the array to it, which would compute the binomial again.
        rows = rows.selectExpr("*", f"IF(hi - lo > 1, {left}, 0L) AS m").selectExpr("rep", f"inline_outer({halves})")
    return rows.where("n > 0").selectExpr("rep", "lo AS bucket", "n")


def draw_clusters(seed: int):
    """Function for a bucket's group: (rep, n) rows and the bucket's clusters -> the sums over the n draws of each replicate.

    One MD5 digest of (seed, replicate, bucket, block) gives four draws of 30 bits each, from its first 120 bits."""
    def draw(shares: pa.Table, clusters: pa.Table) -> pa.Table:
        order = np.argsort(clusters["idx"].to_numpy())
        sums = np.column_stack([clusters[k].to_numpy() for k in ("sa", "na", "sb", "nb")])[order]
        reps, ns, bucket = shares["rep"].to_numpy(), shares["n"].to_numpy(), shares["bucket"][0].as_py() if len(shares) else 0
        counts = np.zeros((len(reps), len(sums)), dtype=np.int64)
        blocks = [b"%d" % k for k in range(-(-int(ns.max(initial=0)) // 4))]
        for row, (rep, n) in enumerate(zip(reps.tolist(), ns.tolist())):
            head = f"{seed}:{rep}:d:{bucket}:".encode()
            bits = np.frombuffer(b"".join([hashlib.md5(head + k).digest() for k in blocks[:-(-n // 4)]]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
            first, second = bits[:, 0] >> np.uint64(4), ((bits[:, 0] & np.uint64(15)) << np.uint64(56)) | (bits[:, 1] >> np.uint64(8))
            low = np.uint64((1 << 30) - 1)
            words = np.column_stack([first >> np.uint64(30), first & low, second >> np.uint64(30), second & low]).ravel()[:n]
            counts[row] = np.bincount((words % np.uint64(len(sums))).astype(np.int64), minlength=len(sums))
        if np.abs(counts.astype(float) @ sums.astype(float)).max(initial=0.0) >= 2.0 ** 63:
            raise OverflowError("a bucket's sum of money does not fit in 64 bits")
        drawn = counts @ sums
        return pa.table({"rep": reps, **{k: drawn[:, j] for j, k in enumerate(("sa", "na", "sb", "nb"))}})
    return draw


def cluster_bootstrap_diff(df: DataFrame, cluster: str = "customer_id", group: str = "location",
                           value: str = "total_spent", a: str = "Online", b: str = "In-store",
                           reps: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Observed mean difference a - b with a cluster-bootstrap percentile interval.

    Replicates without both groups are dropped (``replicates_used`` says how
    many remain). One row.
    """
    spark = df.sparkSession
    facts = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull())
    money = lambda g: (F.sum(F.when(F.col(group) == g, F.col(value).cast("decimal(28,6)"))) * MICRO).cast("long")
    partial = facts.groupBy(cluster).agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in
                                           (("sa", money(a)), ("na", F.count_if(F.col(group) == a)), ("sb", money(b)), ("nb", F.count_if(F.col(group) == b)))])
    indexed = row_index(partial, [cluster])
    clusters = indexed.count()
    indexed = indexed.select(F.floor(F.col("idx") / BUCKET).alias("bucket"), "idx", "sa", "na", "sb", "nb")
    shares = split_draws(spark, reps, clusters, seed, BUCKET)
    # A fixed number of partitions: the rows are small, the work behind each is not, so they must not be merged by size.
    slices = SLICES if clusters <= BROADCAST_CLUSTERS else 1
    shares = shares.withColumn("slice", F.col("rep") % slices)
    copies = indexed.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reps * clusters // 50_000_000)
    grouped = lambda df: df.repartition(parts, "bucket", "slice").groupBy("bucket", "slice")
    totals = (grouped(shares).cogroup(grouped(copies))
                    .applyInArrow(draw_clusters(seed), "rep long, sa long, na long, sb long, nb long"))
    per_rep = totals.groupBy("rep").agg(*[F.sum(F.col(k).cast("decimal(38,0)")).alias(k) for k in ("sa", "na", "sb", "nb")])
    mean = lambda s, n: F.col(s).cast("double") / MICRO / F.col(n).cast("double")
    diffs = per_rep.where((F.col("na") > 0) & (F.col("nb") > 0)).select((mean("sa", "na") - mean("sb", "nb")).alias("diff"))
    checkpoint_dir(spark)
    diffs = diffs.checkpoint()  # one row a replicate, read for the interval and the count
    lo = round((1 - level) / 2, 12)
    hi = round(1 - lo, 12)
    qs = exact_quantiles(diffs, "diff", [lo, hi])
    ci = qs.groupBy().agg(F.max(F.when(F.col("pi") == 0, F.col("q"))).alias("ci_low"),
                          F.max(F.when(F.col("pi") == 1, F.col("q"))).alias("ci_high"))
    used = diffs.agg(F.count(F.lit(1)).alias("replicates_used"))
    from tallyspark.operators.reports import channel_mean_difference
    obs = channel_mean_difference(df.withColumnRenamed(group, "location") if group != "location" else df, a, b,
                                  cluster).select("observed_difference")
    return (obs.crossJoin(ci).crossJoin(used)
               .select("observed_difference", "ci_low", "ci_high", F.lit(clusters).cast("long").alias("clusters"), F.lit(reps).alias("repetitions"),
                       F.lit(seed).alias("seed"), "replicates_used"))
