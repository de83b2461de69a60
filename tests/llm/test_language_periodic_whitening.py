"""Language CRF, periodic runs and whitening against brute force, on small fixtures with the awkward cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language_crf, periodic, queries, whitening

DOCS = "doc_id long, text string, lang string, score string, Runs int"
ONSETS = {"aa": "bdg", "bb": "ptk", "cc": "bpl"}
ENDINGS = {"aa": ["ono", "uru"], "bb": ["iti", "eke"], "cc": ["ono", "eke"]}


def invented(rng, lang, n):
    return [rng.choice(ONSETS[lang]) + rng.choice("aeiou") + rng.choice(ENDINGS[lang]) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(invented(rng, lang, rng.randint(1, 60))), lang, "x", 1) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    rows += [(300, None, "aa", None, None), (301, "", "aa", "x", 1), (302, " 12 + 3 = ²\n", "bb", "x", 1), (303, "Bono", None, "x", 1), (None, "tatiti tokeke", "bb", "x", 1),
             (None, "tatiti tokeke", "bb", "x", 1), (304, " ".join(invented(rng, "bb", 30_000)), "bb", "x", 1), (305, "dauru " * 400, "aa", "x", 1), (305, "dauru " * 400, "aa", "x", 1)]
    return spark.createDataFrame(rows, DOCS)


# --- language CRF ---

@pytest.fixture(scope="module")
def chain(docs):
    return language_crf.fit(docs, per_label=60)


def enumerated(scores, start, change):
    """Marginals, expected transitions and log partition by summing over all label sequences."""
    n, k = scores.shape
    total, gamma, moves = 0.0, np.zeros((n, k)), np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(change[a, b] for a, b in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            gamma[i, y] += w
        for a, b in zip(path, path[1:]):
            moves[a, b] += w
    return gamma / total, moves / total, np.log(total)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 4, 4, 1])
    start, change = rng.normal(size=3), rng.normal(size=(3, 3)) * 2
    scores = [rng.normal(size=(n, 3)) * 3 for n in lengths]
    packed = language_crf.Packed(lengths)
    flat = np.empty((lengths.sum(), 3))
    flat[packed.where] = np.vstack(scores)
    gamma, moves, log_z = language_crf.Chain(list("abc"), {}, np.zeros((1, 3)), start, change).marginals(flat, packed)
    want = [enumerated(s, start, change) for s in scores]
    assert np.allclose(gamma[packed.where], np.vstack([w[0] for w in want]))
    assert np.allclose(moves, sum(w[1] for w in want))
    assert np.isclose(log_z, sum(w[2] for w in want))


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    words = ["ab", "ba", "cab", "ç"]
    lexicon = {"ba": 0}
    features = language_crf.word_features(words, lexicon)
    packed = language_crf.Packed(np.array([4, 2, 1]))
    ids, gold = rng.integers(0, 4, 7), rng.integers(0, 2, 7)
    weights = np.zeros((language_crf.FEATURES + 1, 2))
    used = np.unique(features[1])
    weights[used] = rng.normal(size=(len(used), 2)) * 0.3
    values = [weights, rng.normal(size=2), rng.normal(size=(2, 2))]

    def likelihood(v):
        return language_crf.gradient(language_crf.Chain(["x", "y"], lexicon, *v), features, ids, gold, packed, 4)
    _, *slopes = likelihood(values)
    for which, at in [(0, (int(used[3]), 1)), (0, (language_crf.FEATURES, 0)), (1, (1,)), (2, (0, 1)), (2, (1, 1))]:
        step = 1e-5
        up, down = [v.copy() for v in values], [v.copy() for v in values]
        up[which][at] += step
        down[which][at] -= step
        assert np.isclose(slopes[which][at], (likelihood(up)[0] - likelihood(down)[0]) / (2 * step), rtol=1e-4, atol=1e-6)


def test_languages_and_defined_cases(docs, chain):
    assert chain.labels == ["aa", "bb", "cc"]
    got = language_crf.predict(docs, chain).collect()
    assert len(got) == docs.count()
    for r in got:
        blank = r["doc_id"] in (300, 301, 302)
        assert (r["lang_pred"] == "und") == blank and 0.0 <= r["score"] <= 1.0
        if blank:
            assert r["score"] == 0.0 and r["segments"] == []
        else:
            n = len(language_crf.find_words(r["text"]))
            assert [s["start"] for s in r["segments"]] == list(itertools.accumulate([s["n_words"] for s in r["segments"]], initial=0))[:-1]
            assert sum(s["n_words"] for s in r["segments"]) == n
    long = [r for r in got if r["lang"] and r["lang_pred"] != "und" and len(r["text"].split()) > 4]
    assert sum(r["lang"] == r["lang_pred"] for r in long) >= 0.99 * len(long)


def test_batches_do_not_change_the_result(docs, chain):
    texts = [r["text"] for r in docs.collect()]
    whole = language_crf.label_texts(language_crf.Scorer(chain), texts)
    for k, t in enumerate(texts):
        alone = language_crf.label_texts(language_crf.Scorer(chain), [t])
        assert alone[0][0] == whole[0][k] and np.isclose(alone[1][0], whole[1][k])
        assert [(s["lang"], s["start"]) for s in alone[2][0]] == [(s["lang"], s["start"]) for s in whole[2][k]]


def test_code_switched_text(chain):
    rng = random.Random(9)
    right = total = 0
    for _ in range(40):
        parts = [(lang, rng.randint(6, 20)) for lang in rng.sample(["aa", "bb", "cc"], 3)]
        words = [w for lang, n in parts for w in invented(rng, lang, n)]
        _, _, (segments,) = language_crf.label_texts(language_crf.Scorer(chain), [" ".join(words)])
        said = [s["lang"] for s in segments for _ in range(s["n_words"])]
        gold = [lang for lang, n in parts for _ in range(n)]
        right += sum(a == b for a, b in zip(said, gold))
        total += len(gold)
    assert right >= 0.95 * total
    assert all(chain.change[k, k] > chain.change[k, j] for k in range(3) for j in range(3) if j != k)


def test_no_labels_and_empty_table(spark, docs, chain):
    nobody = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_crf.fit(nobody) is None
    assert {r["lang_pred"] for r in language_crf.predict(docs, None).collect()} == {"und"}
    empty = spark.createDataFrame([], DOCS)
    assert language_crf.fit(empty) is None and language_crf.predict(empty, chain).count() == 0
    with pytest.raises(ValueError):
        language_crf.fit(docs, max_labels=2)


def test_language_query_holds_out(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_language_crf(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    # A label that only held-out documents have is never learned.
    other = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, "zz").otherwise(F.col("lang")))
    other.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert "zz" not in {r["lang_pred"] for r in queries.op11_language_crf(spark, f"{tmp_path}/b").collect()}


# --- periodic runs ---

def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k - p] for k in range(s + p, s + length)) for p in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    k, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 110)
    if rng.random() < 0.4:
        return [str(rng.randrange(k)) for _ in range(n)]
    blocks, w = [[str(rng.randrange(k)) for _ in range(rng.randint(1, 12))] for _ in range(3)], []
    while len(w) < n:
        b = rng.choice(blocks)
        w += (b * rng.randint(1, 9))[rng.randint(0, len(b)):]
        if rng.random() < 0.4:
            w.append(str(rng.randrange(k)))
    return w


@pytest.mark.parametrize("few", [64, 1])
def test_runs_equal_brute_force(monkeypatch, few):
    monkeypatch.setattr(periodic.Diagonals, "FEW", few)
    rng, found = random.Random(few), 0
    for _ in range(1500):
        w = periodic_words(rng)
        runs = periodic.find_runs(w)
        assert runs == brute_runs(w), w
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert periodic.collapse(w, runs) == [x for i, x in enumerate(w) if i not in gone]
        found += len(runs)
    assert found > 500


def test_long_periodic_texts_take_linear_time():
    assert periodic.find_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    assert periodic.find_runs(["x"] + list("abcab") * 10_000) == [(1, 50_000, 5)]


def test_runs_query(spark, docs, tmp_path):
    more = spark.createDataFrame([(k, " ".join(periodic_words(random.Random(k))), "aa", "x", 1) for k in range(1000, 1200)], DOCS)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((repr(tuple(r)) for r in rows))
    want, rewritten = [], 0
    for doc_id, text in texts:
        w = [x for x in (text or "").replace("\n", " ").split(" ") if x]
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            rewritten += 1
        runs = periodic.find_runs(w) if n > 300 else brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)] if n <= 300 else periodic.collapse(w, runs)
        text_of = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append(repr((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                          hashlib.sha256(text_of.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())))
    assert got == sorted(want) and rewritten > 20


def test_runs_defined_cases(spark, docs):
    out = periodic.detect(docs)
    assert out.columns == ["doc_id", "text", "lang", "score", "n_words", "runs", "collapsed"]  # an input column Runs gives way
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == docs.count()
    assert rows[300]["n_words"] == 0 and rows[300]["collapsed"] == "" and rows[300]["runs"] == []
    assert [tuple(r) for r in rows[305]["runs"]] == [(0, 400, 1)] and rows[305]["collapsed"] == "dauru"
    assert periodic.detect(spark.createDataFrame([], DOCS)).count() == 0


# --- whitening ---

def test_eigen_equals_numpy():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    x = rng.normal(size=(9, 20))
    for a in [np.eye(5), np.zeros((3, 3)), np.ones((7, 7)), np.diag([1.0, 1, 2, 2, 5]), (q * np.logspace(0, -13, 30)) @ q.T,
              (q * np.repeat([3.0, 2, 1], 10)) @ q.T, x.T @ x, np.array([[2.0]]), np.cov(rng.normal(size=(70, 33)).T)]:
        values, vectors = whitening.eigen(a)
        scale = max(1e-300, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh((a + a.T) / 2)[::-1], atol=1e-13 * scale * len(a))
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-13 * scale * len(a))


def test_polar_factor():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(12, 12))
    a = a + a.T
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(whitening.polar_unitary(a), (vectors * np.sign(values)) @ vectors.T, atol=1e-13)


VECTORS = "vec_id long, embedding array<float>, Whitened string"


def whitened_rows(spark, vectors, tmp_path):
    spark.createDataFrame(vectors, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return queries.op13_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("dim,rows", [(24, 300), (3, 40), (20, 6)])
def test_whitening_query(spark, tmp_path, dim, rows):
    rng = np.random.default_rng(dim)
    data = (rng.normal(size=(rows, dim)) @ rng.normal(size=(dim, dim)) + 5).astype(np.float32)
    vectors = [(k, [float(c) for c in v], "mine") for k, v in enumerate(data)]
    vectors += [(1000 + k, vectors[0][1], None) for k in range(150)] + [(1000, vectors[0][1], None)]  # a third of the rows is one vector
    bad = [None, [], [None] * dim, [float("nan")] + [1.0] * (dim - 1), [1.0] * (dim - 1) + [float("-inf")], [1.0] * (dim + 1)]
    got = whitened_rows(spark, vectors + [(5000 + k, v, None) for k, v in enumerate(bad)] + [(None, vectors[1][1], "x")], tmp_path)
    kept = vectors + [(None, vectors[1][1], "x")]
    x = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in np.asarray(v, np.float32).astype(float)) for i, v, _ in kept}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = np.array([[c * n - s for c, s in zip(v, sums)] for v in fit], dtype=object)
    cov = (exact.T @ exact).astype(float) / n**3
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(16, int((values > 1e-9 * values.sum()).sum()))
    assert k == min(16, dim, n - 1) and len(got) == k * len(kept)
    assert {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, k + 1))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    turned: dict[int, set] = {}
    for r in got:
        j = r["component"] - 1
        gap = [n * c - s for c, s in zip(x[r["vec_id"]], sums)]
        assert r["deviation"] == sum(g * g for g in gap)
        want = float(np.array(gap, float) / n @ directions[:, j]) / np.sqrt(values[j])
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-6
        if abs(want) > 1e-3:
            turned.setdefault(j, set()).add(r["whitened"] * want > 0)
        assert np.isclose(r["explained"], values[j] / values.sum(), rtol=1e-9)
    assert all(len(v) == 1 for v in turned.values())  # one sign for all rows


def test_whitening_defined_cases(spark, tmp_path):
    assert whitened_rows(spark, [], tmp_path / "a") == []
    assert whitened_rows(spark, [(1, None, None), (2, [float("inf")], None)], tmp_path / "b") == []
    assert whitened_rows(spark, [(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], tmp_path / "c") == []  # one distinct vector: no component
    line = whitened_rows(spark, [(k, [float(k), 7.0, -2.0 * k], None) for k in range(9)], tmp_path / "d")
    assert {r["component"] for r in line} == {1} and np.isclose(line[0]["explained"], 1.0)
    rows, model = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "mine"), (2, [3.0, 5.0], "mine"), (3, [0.0, 1.0], "mine")], VECTORS), n_components=1)
    assert rows.columns == ["vec_id", "embedding", "deviation", "whitened"] and model.n == 3 and len(rows.first()["whitened"]) == 1


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(3, np.array([0, 0]), np.empty(0), np.empty((2, 0)), np.empty(0), 0.0)
    assert model.deviations(np.array([[2**31, 1], [2**33, 1]])) == [9 * (2**62 + 1) if 9 * (2**62 + 1) < 2**63 else None, None]
    assert model.deviations(np.array([[2**29, 1]])) == [9 * (2**58 + 1)]
