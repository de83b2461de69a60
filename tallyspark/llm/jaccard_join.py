"""N-gram Jaccard join with adaptive multi-match prefixes.

Tokens are 64-bit hashes of the distinct 5-word shingles of a text. They are ordered
rare first: by frequency class (the most frequent tokens known, at most
``max_frequent`` of them), then by hash. With t_x = ceil(0.8 |x|), the l-prefix of x
has its first |x| - t_x + l tokens; two linked documents with prefixes for l_x and
l_y share at least min(l_x, l_y) prefix tokens. Each document chooses its own l: the
more candidates its prefix is estimated to meet (sum of the token frequencies), the
longer the prefix and the more matches are asked for before a pair is verified.

1. One pass makes the sets and writes the smallest hashes of each. How often tokens
   occur among them gives the frequent ones, a list of bounded size, and so the order.
   Sets with too many frequent tokens there (near copies, mostly) are made again whole,
   one row of each, and all their tokens are counted too: their own rare tokens then come
   first, and the position bound rejects what only shares the frequent rest. Any list
   gives right results, a better one fewer candidates.
2. The prefix index (token, set, size, l, position) comes from the written hashes and the
   whole sets. Documents with equal sets are one entry; tokens of a single entry are dropped.
3. Star round: in each token's group every member is paired with one leader of the
   group only, the one with the fewest rarer tokens, which is the nearest to the middle
   of a group of near copies. Verified links merge classes, so a group of n near copies
   costs n pairs, not n * n.
4. What is left is enumerated in full: pairs in different classes that share at least
   min(l_x, l_y) prefix tokens and pass the length and position bounds. No link
   between classes is lost; pairs within a class are already connected.
5. Components by large-star / small-star iterations over the links.

Verification rejects by an exact bound from the written hashes, then intersects whole
token sets, made again from the texts of the documents that are left (a bitmap of fixed
size tells which; a wrong hit costs only time).

Defined cases. Fewer than five words: the whole sequence is the only shingle. Null,
empty or blank text: no shingle, linked with nothing, component is its own doc_id.
Repeated rows of one doc_id are copies. A null doc_id joins its group but is never
its smallest id; a group of null ids only has a null component. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import WORD_CLASS, arrow_batches, delete_folder, saved, shared_folder

WIDTH = 5
MIN_PER_CENT = 80
BASE_MATCHES, MAX_MATCHES = 2, 5
COST_STEPS = (64, 512, 4096)  # estimated candidates beyond which one more match is asked for
MAP_BITS = 26
STAR_ROUNDS = 1
BATCH_ROWS = 512  # texts, or pairs with both whole token sets, that a Python worker gets at a time

_MIX1, _MIX2, _MUL = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Tokens:
    """Texts to sorted arrays of distinct shingle hashes (signed 64 bits)."""

    def __init__(self, width: int = WIDTH):
        self.width, self.known = width, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        ws = (text or b"").lower().split()  # on bytes: A-Z only, and the six white-space characters
        if not ws:
            return np.empty(0, dtype=np.int64)
        known = self.known
        if len(known) > 100_000:
            known.clear()
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, ws), dtype=np.uint64, count=len(ws))
        n = min(self.width, len(ws))
        acc = np.full(len(ws) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            acc = _mixed(acc * _MUL + h[k:len(h) - n + 1 + k])
        return np.unique(acc.view(np.int64))


def needed(nx: int, ny: int) -> int:
    """The least intersection with 100 * intersection >= 80 * union."""
    return -(-MIN_PER_CENT * (nx + ny) // (100 + MIN_PER_CENT))


def least_overlap(n: int) -> int:
    return -(-MIN_PER_CENT * n // 100)


def set_id(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens))).view(np.int64))


def slices(batches, rows: int = 512):
    """The batches in smaller parts, which bounds what a Python worker holds at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _long(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


def document_sets(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, row, n, set, low): size and id of each row's token set, and its tokens with the smallest hashes; row is its identity.

    ``low`` holds enough of them for the prefix in the order of the hashes, and some more in place of frequent tokens."""
    def run(batches):
        tokens = Tokens()
        for b in slices(batches):
            sets = [tokens(t) for t in _texts(b, 1)]
            low = [s[:prefix_length(len(s), MAX_MATCHES) + len(s) // 10 + 8].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([set_id(s) for s in sets], pa.int64()), pa.array(low, pa.binary())], ["doc_id", "row", "n", "set", "low"])
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_identity(doc_id, text).alias("row"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, row long, n long, set long, low binary")


def prefix_length(n: int, l: int) -> int:
    return n - least_overlap(n) + l


Known = tuple[np.ndarray, np.ndarray]


def token_counts(sets: DataFrame, column: str) -> DataFrame:
    """(token, k): the tokens in the lists of ``column`` that occur at least 4 times, and the log2 of how often."""
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_long([np.frombuffer(x, dtype=np.int64) for x in b.column(0).to_pylist()]))], ["token"])

    return (sets.select(column).mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
            .where("c >= 4").select("token", F.floor(F.log2("c")).cast("int").alias("k")))


def frequent_tokens(counts: DataFrame, max_frequent: int) -> Known:
    """Sorted tokens and their frequency class: the most frequent classes that hold at most ``max_frequent`` tokens, which
    bounds what reaches the driver and is broadcast."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = 64, 0
    for k in sorted(sizes, reverse=True):
        if held + sizes[k] > max_frequent:
            break
        least, held = k, held + sizes[k]
    t = counts.where(F.col("k") >= least).select("token", "k").toArrow()
    tokens, classes = t.column("token").to_numpy(), t.column("k").to_numpy()
    order = np.argsort(tokens)
    return tokens[order].astype(np.int64), classes[order].astype(np.int64)


def adaptive_prefix(s: np.ndarray, n: int, known: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int] | None:
    """The prefix of a set of ``n`` tokens and its l, from its tokens with the smallest hashes; None if those do not settle it."""
    k = np.zeros(len(s), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        k = np.where(known[at] == s, classes[at], 0)
    order = np.argsort(k, kind="stable")  # equal classes stay in the order of the hashes
    least = least_overlap(n)
    if len(s) < n and int((k == 0).sum()) < n - least + BASE_MATCHES:
        return None
    cost = int(((1 << k[order[:n - least + BASE_MATCHES]]) - 1).sum())
    l = min(least, MAX_MATCHES, BASE_MATCHES + sum(cost > c for c in COST_STEPS))
    m = n - least + l
    if len(s) < n and int((k == 0).sum()) < m:
        return None
    return s[order[:m]], l


INDEX = "token long, set long, n int, l int, pos int"


def _entries(found: list[tuple[int, int, np.ndarray, int]]) -> pa.RecordBatch:
    columns = (_long([p for _, _, p, _ in found]), _long([np.full(len(p), i, dtype=np.int64) for i, _, p, _ in found]),
               *(_long([np.full(len(x[2]), x[c], dtype=np.int64) for x in found]).astype(np.int32) for c in (1, 3)),
               _long([np.arange(len(p), dtype=np.int64) for _, _, p, _ in found]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "set", "n", "l", "pos"])


def unsettled(sets: DataFrame, frequent: Known) -> DataFrame:
    """(set, key) of the sets whose smallest hashes do not settle the prefix, and the key of one row of each."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        for b in batches:
            keep = [n > 0 and adaptive_prefix(np.frombuffer(low, dtype=np.int64), n, *shared.value) is None
                    for n, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3)], ["set", "key"]).filter(pa.array(keep, pa.bool_()))

    rows = sets.select("n", "low", "set", row_key("doc_id").alias("key")).mapInArrow(run, "set long, key long")
    return rows.groupBy("set").agg(F.min("key").alias("key"))


def whole_sets(docs: DataFrame, rows: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(set, tokens) of the sets in ``rows`` (set, key), made again from one row of each."""
    return token_sets(docs, text, doc_id, bitmap_of(rows)).join(rows.select("set"), "set", "left_semi")


def prefix_index(docs: DataFrame, sets: DataFrame, text: str, doc_id: str, max_frequent: int) -> DataFrame:
    """(token, set, n, l, pos, earlier) of each set's adaptive prefix, for tokens that several sets have."""
    counts = saved(token_counts(sets, "low"))
    hot = saved(unsettled(sets, frequent_tokens(counts, max_frequent)))
    whole = saved(whole_sets(docs, hot, text, doc_id))
    both = counts.union(token_counts(whole, "tokens")).groupBy("token").agg(F.max("k").alias("k"))
    frequent = frequent_tokens(saved(both), max_frequent)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def from_low(batches):
        for b in slices(batches):
            found = []
            for n, i, low in zip(*(b.column(c).to_pylist() for c in range(3))):
                prefix = adaptive_prefix(np.frombuffer(low, dtype=np.int64), n, *shared.value) if n else None
                if prefix:
                    found.append((i, n, *prefix))
            yield _entries(found)

    def from_whole(batches):
        for b in slices(batches):
            found = []
            for i, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = np.frombuffer(tokens, dtype=np.int64)
                found.append((i, len(s), *adaptive_prefix(s, len(s), *shared.value)))
            yield _entries(found)

    # A set that the longer list leaves unsettled is made again as well; a set in two branches has equal entries in both.
    late = saved(unsettled(sets, frequent).join(hot.select("set"), "set", "left_anti"))
    rest = whole_sets(docs, late, text, doc_id)
    rows = sets.select("n", "set", "low").mapInArrow(from_low, INDEX).union(whole.union(rest).mapInArrow(from_whole, INDEX))
    # One exchange by token serves the removal of copies, the count and the groups.
    one = rows.repartition(F.col("token")).dropDuplicates(["token", "set"])
    met = one.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1").drop("df")
    # Of the prefix tokens before one, only those that other prefixes have too can be shared with a set that has it.
    earlier = F.row_number().over(Window.partitionBy("set").orderBy("pos")) - 1
    return met.withColumn("earlier", earlier)


def row_key(doc_id):
    return F.xxhash64(F.col(doc_id))


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2**MAP_BITS bits with a bit for each ``key``; its size does not depend on the input."""
    slot = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    words = (keys.select(F.shiftright(slot, 3).cast("int").alias("w"), F.expr("shiftleft(1, cast(key & 7 as int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint8)
    return out


def token_sets(docs: DataFrame, text: str, doc_id: str, wanted: np.ndarray) -> DataFrame:
    """(set, tokens): the sorted tokens as bytes, for the non-blank rows whose doc_id has a bit in ``wanted`` (and for a
    few others, as the bitmap is hashed)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        tokens = Tokens()
        for b in slices(batches):
            slot = b.column(1).to_numpy() & ((1 << MAP_BITS) - 1)
            hit = (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
            found = [tokens(t) for t in _texts(b.filter(pa.array(hit.astype(bool))), 0)]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()),
                                              pa.array([s.tobytes() for s in found], pa.binary())], ["set", "tokens"])
    rows = docs.where(F.col(text).rlike(WORD_CLASS)).select(F.col(text).alias("text"), row_key(doc_id).alias("key"))
    return rows.mapInArrow(run, "set long, tokens binary").dropDuplicates(["set"])


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    if len(p) > len(q):
        p, q = q, p
    return int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(p) else 0


def may_link(low_x: bytes, nx: int, low_y: bytes, ny: int) -> bool:
    """An exact upper bound from the smallest hashes: up to the smaller of the two largest ones both lists are complete."""
    p, q = np.frombuffer(low_x, dtype=np.int64), np.frombuffer(low_y, dtype=np.int64)
    top = min(p[-1] if len(p) < nx else np.iinfo(np.int64).max, q[-1] if len(q) < ny else np.iinfo(np.int64).max)
    p, q = p[:np.searchsorted(p, top, side="right")], q[:np.searchsorted(q, top, side="right")]
    return overlap(p, q) + min(nx - len(p), ny - len(q)) >= needed(nx, ny)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The pairs (a, b) of sets that are linked: first by the bound, then by whole sets made again from the texts."""
    def bound(batches):
        for b in slices(batches):
            keep = [may_link(*r) for r in zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exact(batches):
        for b in slices(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)
                keep.append(overlap(p, q) >= needed(len(p), len(q)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("low").alias("low"))
    side = lambda c: one.select(F.col("set").alias(c), F.col("low").alias(f"low_{c}"), F.col("n").alias(f"n_{c}"))
    left = saved(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "low_a", "n_a", "low_b", "n_b").mapInArrow(bound, "a long, b long"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    rows = sets.join(wanted, "set").groupBy("set").agg(F.min(row_key("doc_id")).alias("key"))
    whole = saved(token_sets(docs, text, doc_id, bitmap_of(rows)).join(wanted, "set"))
    first = left.join(whole.select(F.col("set").alias("b"), F.col("tokens").alias("tb")), "b")
    both = first.join(whole.select(F.col("set").alias("a"), F.col("tokens").alias("ta")), "a")
    return saved(both.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"))


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """(set, class): the smallest id of each id's connected component, for the ids in ``links`` (a, b)."""
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e, smaller):
        # For each node: the least of itself and its (smaller) neighbours; its larger (smaller) neighbours move there.
        both = e.union(e.select("b", "a")).toDF("a", "b") if not smaller else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.join(least, "a")
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if not smaller else \
            moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    e = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(e)
    for _ in range(limit):
        if before[0] == 0:
            break
        e = saved(star(star(e, False), True))
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {limit} rounds")
    return e.select(F.col("a").alias("set"), F.col("b").alias("class")).union(
        e.select(F.col("b").alias("set"), F.col("b").alias("class")).distinct())


def with_class(index: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return index.withColumn("class", F.col("set"))
    return index.join(classes, "set", "left").withColumn("class", F.coalesce("class", "set"))


def could_link(a: str, b: str):
    """Length and position bounds for a pair that meets in a token: the intersection has at most what both have from
    there on, and the earlier matches. Each of the first min(l) shared tokens of a linked pair meets them."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(F.lit(MIN_PER_CENT) * (na + nb) / F.lit(float(100 + MIN_PER_CENT)) - F.lit(1e-9))
    before = F.least(F.col(f"{a}.earlier"), F.col(f"{b}.earlier"), F.col(f"{a}.l") - 1, F.col(f"{b}.l") - 1)
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) + before
    return (100 * na >= MIN_PER_CENT * nb) & (100 * nb >= MIN_PER_CENT * na) & (rest >= need)


def similar_classes(docs: DataFrame, sets: DataFrame, text: str, doc_id: str, max_frequent: int = 1_000_000) -> DataFrame:
    """(set, class) of every set that is linked with another one."""
    index = saved(prefix_index(docs, sets, text, doc_id, max_frequent))
    links, classes = None, None
    for r in range(STAR_ROUNDS):
        at = with_class(index, classes)
        lead = at.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("class", F.lit(r)).alias("h"), "set", "class", "n", "l", "earlier")).alias("lead"))
        pairs = (at.join(lead, "token").where("class <> lead.class")
                 .alias("x").where(could_link("x", "lead"))
                 .groupBy(F.col("lead.set").alias("a"), F.col("set").alias("b"))
                 .agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("l", "lead.l")).alias("l"))
                 .where("shared >= l").select("a", "b"))
        found = verified(pairs, docs, sets, text, doc_id)
        links = found if links is None else links.union(found)
        classes = components(links)
    at = saved(with_class(index, classes))
    open_groups = at.groupBy("token").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("token")
    at = saved(at.join(open_groups, "token"))
    x, y = at.alias("x"), at.alias("y")
    pairs = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.class") != F.col("y.class")) & could_link("x", "y"))
             .groupBy(F.col("x.set").alias("a"), F.col("y.set").alias("b"))
             .agg(F.count(F.lit(1)).alias("shared"), F.first(F.least("x.l", "y.l")).alias("l"))
             .where("shared >= l").select("a", "b"))
    return components(links.union(verified(pairs, docs, sets, text, doc_id)))


def row_identity(doc_id: str, text: str):
    """Rows that agree in doc_id and text are one document."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, n, class), one row per row of ``docs``: its identity, how many shingles it has, and its component."""
    spark = docs.sparkSession
    path = shared_folder(spark, "sets")
    # Everything runs here, so the setting holds for all of it.
    with arrow_batches(spark, BATCH_ROWS):
        document_sets(docs, text, doc_id).write.parquet(path)
        sets = spark.read.parquet(path)
        classes = similar_classes(docs, sets, text, doc_id)
        at = saved(sets.select("doc_id", "row", "n", "set").join(classes, "set", "left").select("doc_id", "row", "n", F.coalesce("class", "set").alias("class")))
    delete_folder(spark, path)
    return at


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    at = grouped(docs, text, doc_id)
    # The empty set is nobody's partner.
    least = at.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    return (at.join(least, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def surplus(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row) of the documents that go, and of those that stay and have several rows: of each component of
    ``grouped`` the one with the smallest doc_id stays (a null one last), of several texts of that doc_id the one with the smallest identity."""
    at = groups.where("n > 0").groupBy("class", "doc_id", "row").agg(F.count(F.lit(1)).alias("c"))
    first = at.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    at = saved(at.join(first, "class").select("doc_id", "row", "c", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))).alias("stays")))
    return at.where(~F.col("stays")).select("doc_id", "row"), at.where("stays AND c > 1").select("doc_id", "row")
