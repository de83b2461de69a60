"""The ten training-data operators against brute force, on small fixtures with the awkward cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import (decontamination, html_crf, jaccard_join, line_dedup, mixing, pii, quality, revisits, sharding,
                            token_counts)

DOCS = "doc_id long, text string, lang string, source string, Size int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    vocabulary = ["ka" + str(i) + c for i in range(60) for c in "xyz"]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 90))) for _ in range(40)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, "en", f"s{i % 4}", 1))
    for i in range(20):  # near copies: one word changed
        w = base[i % 7].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w), "en", None, 1))
    rows += [(200 + i, base[3].upper(), "en", "s0", 1) for i in range(5)]
    line = "this line is found in many documents"
    rows += [(300 + i, f"{base[i]}\n {line.upper()}\t\nshort\n{line}", "en", "s1", 1) for i in range(6)]
    rows += [(400, None, None, None, None), (401, "", "en", "s2", 1), (402, " \n\t ", "en", "s2", 1), (403, "two words", "en", "s2", 1), (404, "TWO words", "en", "s2", 1),
             (405, "é" * 30 + " " + "ß" * 5, "de", "é", 1), (405, "é" * 30 + " " + "ß" * 5, "de", "é", 1), (None, "no id here", "en", "s3", 1),
             (None, "no id here", "en", "s3", 1), (406, " ".join(rng.choice(vocabulary) for _ in range(20_000)), "en", "s3", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(docs, empty):
    got = sharding.shard_by_bytes(docs, 6, buckets_per_shard=2).collect()
    assert len(got) == docs.count()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    small = [r["size"] for r in got if r["size"] < 50_000]
    assert set(slots) <= set(range(6)) and sum(small) > 0
    assert sharding.shard_by_bytes(empty, 6).count() == 0


def test_sharding_is_even(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = sharding.shard_by_bytes(d, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    mean = sum(r["b"] for r in got) / 8
    assert len(got) == 8 and all(abs(r["b"] - mean) < 0.01 * mean for r in got)


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = left / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            return full | {s: weight[s] * level for s in open_}
        for s in over:
            full[s] = 3 * sizes[s]
            left -= full[s]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += r["size"]
    want = targets({s: sizes[s] for s in {r["source"] for r in got}})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    mixed = mixing.repeated(mixing.mix(docs), docs.columns)
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(empty).count() == 0


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_join(docs, empty):
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = sorted(str((d, len(s), least.get(find(i)) if s else d)) for i, (d, s) in enumerate(rows))
    assert sorted(str(tuple(r)) for r in jaccard_join.near_duplicates(docs).collect()) == want
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_join_in_a_large_group(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"z{i}{rng.random()}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in rows]
    parent = list(range(300))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(300):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(300)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else None, "card": 13 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


def test_pii_base(spark):
    texts = ["mail a.b@c-d.com%x@y.zz..w@q", "é x@y.z. 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (988) 555-2485 +12 3 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
             None, "", "a@b.c" * 3, "9" * 50_000, "1 " * 9000, "x@" + "a." * 5000 + "b", "_" * 20_000, "4111111111111111 5500-0000-0000-0004\n10.0.0.1"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in pii.find_spans(d).select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t or "") if passes(k, m[0]))
        assert got[i] == want, i


def test_pii_learns_contexts(spark):
    seeds = [(i, f"word{i} please call me at +1 ({200 + i}) 555-{1000 + i} or later") for i in range(8)]
    more = [(50, "now please call me at 202-555-0147 or later"), (51, "order number 202-555-0199 was sent")]
    got = {r["doc_id"]: r for r in pii.find_spans(spark.createDataFrame(seeds + more, "doc_id long, text string")).collect()}
    assert [x["value"] for x in got[50]["added"]] == ["202-555-0147"]
    assert not got[51]["added"] and len(got[3]["base"]) == 1
    red = pii.redact(spark.createDataFrame(seeds + more, "doc_id long, text string")).where("doc_id = 50").first()
    assert red["redacted"] == "now please call me at <phone> or later"


def test_pii_learns_over_hops(spark):
    first, second, third = "please call me at {} or later", "his number is {} for now", "reach us under {} any time"
    number = lambda i: f"202-555-{1000 + i}"
    rows = [first.format(f"+1 ({200 + i}) 555-{1000 + i}") for i in range(40)]
    rows += [t.format(number(i)) for i in range(12) for t in (first, second)]
    rows += [t.format(number(i)) for i in range(20, 23) for t in (second, third)]
    rows += [third.format(number(30)), "order number 202-555-0199 was sent"]  # two hops from the seeds, and none
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["value"] for r in pii.find_spans(d).select("added").collect() for x in r["added"]}
    assert got == {number(i) for i in (*range(12), 20, 21, 22, 30)}


def test_revisits(spark):
    rows = [(1, "http://WWW.a.com:80/x/", 10, 200, '"t1"', None, "d1", {"Content-Length": "5", "Date": "old"}),
            (2, "https://a.com/x#f", 20, 304, 'W/"t1"', None, None, {"content-length": "0", "DATE": "new"}),
            (3, "http://a.com/x", 20, 200, '"t2"', None, "d2", {}),
            (4, "http://a.com/x", 25, 304, '"t1"', None, None, None),
            (5, "http://a.com/x", 5, 304, '"t1"', None, None, {}), (6, None, 30, 304, '"t1"', None, None, {}),
            (7, "http://a.com/x", None, 304, '"t1"', None, None, {}), (8, "http://a.com/x", 9000, 304, None, None, "d2", {}),
            (9, "http://a.com/x", 9001, 304, None, "m", None, {})]
    d = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, etag string, last_modified string, digest string, headers map<string,string>")
    got = {r["record_id"]: r for r in revisits.resolve_revisits(d).collect()}
    assert {k: (r["response_id"], r["outcome"]) for k, r in got.items()} == {
        2: (1, "resolved"), 4: (3, "changed"), 5: (None, "no_capture"), 6: (None, "no_capture"), 7: (None, "no_capture"), 8: (3, "resolved"), 9: (3, "unverified")}
    assert got[2]["headers"] == {"content-length": "5", "date": "new"}
    assert revisits.resolve_revisits(d.where("false")).count() == 0


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    low = lambda d: -1 if d is None else d
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != low(d))]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(str, out))


def test_line_dedup(docs, empty, spark):
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(r["n_dropped"] for r in got) > 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    keys = lambda ids, hs: spark.createDataFrame([(i, bytearray(h)) for i in ids for h in hs], "id long, hash binary")
    for b in range(5):
        runs.add(keys([b], [b"a", bytes([b])]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r["hash"]): r["n_docs"] for r in runs.merge(runs.rows()).collect()}[b"a"] == 5
    assert {bytes(r["hash"]) for r in runs.unseen(keys([9], [b"a", b"new"])).collect()} == {b"new"}
    runs.delete()


def test_html(spark):
    chain = html_crf.fit(200)
    held_out = html_crf.labelled_pages(150, seed=123)
    assert sum(html_crf.main_text(p, chain) == "\n\n".join(m) for p, m in held_out) >= 0.95 * len(held_out)
    page = ('<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Title &amp; more</h1><p><b>First <i>part</i>,\n of it.<br>Second&nbsp;half of the text.'
            '<script>var x="</p>"</script><p>Last one here, with more words.</article><div class="comments"><p>I disagree, said the reader.</p></div><footer>&copy; me</footer>')
    d = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<article></article>", None)], "page_id long, url string, html string, Main_Text string")
    got = {r["page_id"]: r["main_text"] for r in html_crf.extract(d, chain).collect()}
    assert got == {1: "Title & more\n\nFirst part, of it. Second half of the text.\n\nLast one here, with more words.", 2: "", 3: "", 4: ""}


def test_html_reads_whole_blocks():
    chain = html_crf.fit(200)
    plain = "Kalo miren tasvor beldun estari onulpre sentor galhin lomi renka vorbel dunest arion ulpre sengal hintas. "
    story = plain * 3 + "They went on to search the valley before noon. " + plain * 8
    notice = plain * 6 + "All rights reserved. Privacy and terms apply. We use cookies. Accept the cookies. Subscribe to the newsletter."
    page = f"<html><body><article><h1>{plain}</h1><p>{plain * 9}</p><p>{story}</p></article><div><p>{notice}</p></div></body></html>"
    assert html_crf.main_text(page, chain).split("\n\n") == [x.strip() for x in (plain, plain * 9, story)]
    block = html_crf.leaf_blocks(f"<p>{'word ' * 500}one. two. three, four.</p>")[0]
    assert "marks:3" in html_crf.features(block, True, True)


def brute_quality(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i:i + 3])] > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality_statistics(docs, empty, spark):
    extra = spark.createDataFrame([(900, "a b c a b c a\nx\nx\n \n x", "en", "s", 1), (901, "a a a a", "en", "s", 1), (902, "# b|c <d>", "en", "s", 1)], DOCS)
    for r in quality.add_statistics(docs.union(extra)).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(r["text"]), r["doc_id"]
    assert quality.judge(empty, []).count() == 0


def test_quality_list(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        rows.append((i, " ".join(word() + ("###" if bad else "") for _ in range(80))))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 0), (5, None), (7777, 0)], "doc_id long, quality int")
    rules = quality.fit_list(d, lab)
    assert rules and all(r["kept"] == (r["doc_id"] % 3 != 0) for r in quality.judge(d, rules).collect())
    assert quality.fit_list(d, lab.where("false")) == [] and quality.fit_list(d, lab.where("quality = 1")) == []


def test_token_counts(docs, spark):
    enc = token_counts.Encoder()
    state = {r["doc_id"]: r for r in token_counts.count_with_edits(docs, token_counts.sample_edits(docs)).collect()}
    assert len(state) >= 70 and all(r["n_tokens"] == enc.count(r["text"]) and sum(r["sizes"]) == len(r["text"]) for r in state.values())
    rng = random.Random(3)
    pieces = ["'l", "l", "'", "  ", " ", "\n", "é 42", "the", "\t\t", "日本", "'s", "!"]
    for t in ["", "  ", "a  b\n\n  c 'll don't 's", "x" * 300, "   \n" * 40, "word " * 200]:
        tree = token_counts._state(t, enc)
        for _ in range(15):
            t, _ = token_counts.apply_edit(t, tree, rng.randint(-1, len(t) + 1), rng.choice([0, 0, 1, 2, 40]), "".join(rng.choices(pieces, k=rng.randint(0, 3))), enc)
            assert tree.total() == enc.count(t)


def test_decontamination(spark, empty):
    items = [(1, "Alice bought 12 apples and 7 pears for 30 dollars, so how many apples and pears did she buy in all at the shop?"),
             (2, "The quick brown fox jumps over the lazy dog near the river bank while seven other animals watch from behind the trees."),
             (3, "one two"), (4, None), (5, "what is the capital city of france")]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "Intro text here. " + items[0][1] + " outro"), (2, "Before. Carol bought 15 apples and 9 pears for 44 dollars, so how many apples and pears did she buy in all at the shop? After"),
            (3, "Clean words about nothing in particular that go on for a while and have no question in them, but one two."), (4, None), (5, ""),
            (6, "x " + items[1][1].upper()), (7, "so what is the capital city of france then"), (7, "so what is the capital city of france then"),
            (None, items[1][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in decontamination.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 2), (7, 5), (None, 2)} and got[1, 1] == 0 and got[2, 1] >= 3
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(d, b).collect()) == [3, 4, 5]
    assert decontamination.contaminated(empty, b).count() == 0 and decontamination.contaminated(d, b.where("false")).count() == 0


def test_decontamination_exact(spark):
    items = [(1, "Harry Potter And The Philosopher Stone Was Written By Joanne Rowling And Sold In Britain"), (2, "Is Paris In France Or Spain"),
             (3, "Name three primes"), (4, "What is 17 squared"), (5, "who wrote the Iliad and the Odyssey in Greek")]
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"Some words before it. {t} - and some words after it.") for i, t in items] + [
        (11, "he asked: is paris in france, or spain?"), (12, "What is 18 squared"), (13, "Some Title With Every Word Written In Capital Letters And Then Some More Of Them"),
        (14, "Is Berlin In Poland Or Denmark"), (15, "name three of the primes")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(1, 6)} | {(11, 2)}


def test_decontamination_units_and_wraps(spark):
    items = [(1, "A train goes from the old town to Paris and back in 5 hours at 60 miles per hour, so how many miles did Alice ride if she went twice?"),
             (2, "How many feet are in the wall"), (3, "the farmer pours 12 gallons of milk from the tank")]
    b = spark.createDataFrame(items, "item_id long, text string")
    one = items[0][1]
    swapped = one.replace("miles", "kilometers").replace("60", "95").replace("Alice", "Carol")
    rows = [(1, "Intro: " + swapped), (2, one.replace(" ", "\n")), (3, swapped.replace("to Paris", "to \r\n Paris").replace("95 ", "95\n\t")),
            (4, one.lower()), (5, one.lower().replace("60", "75").replace("5 hours", "7 days")), (6, "Next. How many metres are in the wall"),
            (7, "the farmer pours 15\nliters of milk from the tank"), (8, "How many birds are in the wall")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, 1) for i in range(1, 6)} | {(6, 2), (7, 3)}


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline
    rng = random.Random(4)
    clean = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(70)), "en", f"s{i % 3}", 1) for i in range(60)]
    item = " ".join("q" + "".join(rng.choice("abcdef") for _ in range(5)) for _ in range(20))
    rows = clean + [(500, clean[4][1], "en", "s0", 1), (501, clean[9][1] + " " + item, "en", "s1", 1), (502, "too short", "en", "s1", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, d, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*range(60), 500, 501])
    kept = stages["jaccard_join"](spark, kept, str(tmp_path))
    left = stages["decontamination"](spark, kept, str(tmp_path))
    assert set(left.columns) == set(d.columns)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(60))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(range(60)) and {r["shard"] for r in out} <= set(range(24))


def test_pipeline_drops_rows_not_ids(spark):
    import corpus_pipeline
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    copied, alone, both, other, nameless = text(), text(), text(), text(), text()
    rows = [(1, copied), (None, copied), (None, alone), (None, None), (None, ""), (7, ""),  # a null id is a copy of 1; other null ids are not
            (2, both), (3, both), (3, other), (3, other),  # id 3 has a copy and a text of its own, twice
            (None, nameless), (None, nameless + " more"), (None, nameless + " words"), (None, nameless)]  # near copies without ids
    d = spark.createDataFrame(rows, "doc_id long, text string")
    stay = [tuple(r) for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, d, "").collect()]
    left = [r for r in stay if not (r[1] or "").startswith(nameless)]
    assert sorted(left, key=str) == sorted([(1, copied), (None, alone), (None, None), (None, ""), (7, ""), (2, both), (3, other)], key=str)
    assert len(stay) == len(left) + 1


def test_decontamination_anchors_change_nothing(spark, monkeypatch):
    """Texts without an anchor are passed over: the result is that of hashing every text, and copies with wide spaces are found."""
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "Paris", "Rome", "12", "7.5", "miles", "kg", "-", "don't", "apples", "river", "Ναός", "house", "green", "walks"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.choice([3, 4, 6, 9, 14, 25]))) for i in range(40)]
    rows = [(i, f"{sentence(5)} {t} {sentence(4)}") for i, t in items] + [(100 + i, sentence(30)) for i in range(60)]
    wide = ["\u00a0", "\u2003", "\u3000 "]
    rows += [(200 + i, sentence(5) + " " + items[i][1].replace(" ", wide[i % 3]) + " " + sentence(3)) for i in range(40)]
    rows += [(300 + i, items[i][1].replace("12", "99").replace("Paris", "Berlin").upper()) for i in range(40)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontamination.contaminated(d, b).drop("key").collect()))
    monkeypatch.setattr(decontamination, "MAX_ANCHORS", 0)
    assert got == sorted(map(tuple, decontamination.contaminated(d, b).drop("key").collect()))
    assert {i for i, _ in items} <= {r[0] for r in got} and {200 + i for i, t in items if len(t.split()) >= 5} <= {r[0] for r in got}


def test_quality_fit_is_bounded(spark, monkeypatch):
    """One label that meets many rows of its doc_id brings at most ``max_rows`` rows to the driver."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(200)]
    d = spark.createDataFrame([(1, t) for t in texts] + [(1, texts[0])] * 50, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "learn_list", lambda x, reject: seen.append(len(reject)) or [])
    quality.fit_list(d, spark.createDataFrame([(1, 0)], "doc_id long, quality int"), max_rows=10)
    quality.fit_list(d, spark.createDataFrame([(1, 0)], "doc_id long, quality int"), max_rows=1000)
    assert seen[0] == 10 and 10 < seen[1] <= 200


def test_pipeline_stages_keep_columns(spark, tmp_path):
    """Columns named like those that the operators add pass through all stages but the last; null ids and an empty table are fine."""
    import corpus_pipeline
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    rows = [(i if i % 5 else None, text(), f"s{i % 2}", "mine", "7.5", i, "kept?", "e", "k", "r", "i") for i in range(30)]
    names = ["doc_id long", "text string", "source string", "rule string", "n_words string", "size int", "kept string", "epochs string", "__key string", "__row string", "__id string"]
    d = spark.createDataFrame(rows, ", ".join(names))
    spark.createDataFrame([(1, text())], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and (name == "mixing" or got == set(rows)), name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
