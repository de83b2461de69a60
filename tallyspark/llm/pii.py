"""Personal data: base patterns and bootstrapped contextual extraction.

Base matches (e-mail, IP, card, phone) are regular expressions with checks. They are
the seeds. The words around a match are lexical patterns: the two words before it,
and the word before with the word after. A second, looser set of shapes gives
candidates that are not base matches (phone numbers without a plus, "name [at] host",
cards with other separators, IP addresses with other separators). Patterns and
instances form a graph; its scores are iterated:

  confidence of a pattern = sum of the scores of its distinct instances / their number,
                            0 with fewer than ``min_seeds`` distinct instances that are seeds or have passed
  score of an instance    = 1 for a seed, else 1 - product of (1 - confidence) over its patterns

An instance has passed when its score of the last round reached ``min_score``, so what was
found qualifies new patterns, over any number of hops. ``rounds`` rounds make a turn; in the next turn
instances that have passed keep their score and others begin at 0 again (confidences
that only raise each other do not add up over turns). Scores never fall from turn to turn; the
turns end when one passes no new instance.

A candidate that has passed becomes a span, if it overlaps no base
span. All of it is column expressions, joins and aggregates; the graph has one edge per
candidate and pattern, and texts are read once.

Expressions are written so that a run of any length is matched without recursion
(fixed-length loops and lookbehinds); they accept the same strings as the base patterns.

Defined cases. Null text is empty text. Positions are code points, the end exclusive.
Matches that fail a check are dropped, without a retry inside them. Repeated rows give
equal results. A null doc_id is kept. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.quality import let
from tallyspark.llm.text import saved

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])(?:[A-Za-z0-9.-](?<!\.\.))+(?<!\.)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9\x20-](?<![\x20-][\x20-]))+(?<=[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++){0,6}",
    "ip": r"(?<![0-9.,:])[0-9]{1,3}(?:[,:_][0-9]{1,3}){3}(?![0-9.,:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[ ./-]?[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CONTEXT = 48  # code points on either side in which the context words are looked for


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def loose_ok(kind: str, m: Column) -> Column:
    if kind == "phone":
        return F.length(_digits(m)).between(7, 15)
    return F.lit(True)


def find_all(text: Column, kind: str, pattern: str, ok, base: bool) -> Column:
    """The matches of a pattern that pass, as structs (kind, start, end, value, base), positions from 0."""
    def placed(m: Column) -> Column:
        def at(gaps: Column) -> Column:
            none = F.array().cast("array<struct<k:int,start:int,end:int,value:string,base:boolean>>")
            state = F.struct(F.lit(0).alias("pos"), none.alias("out"))

            def step(acc: Column, i: Column) -> Column:
                value = F.get(m, i)
                start = acc["pos"] + F.length(F.get(gaps, i))
                end = start + F.length(value)
                span = F.struct(F.lit(KINDS.index(kind)).alias("k"), start.alias("start"), end.alias("end"), value.alias("value"), F.lit(base).alias("base"))
                return F.struct(end.alias("pos"), F.when(ok(kind, value), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))
            return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), state, step, lambda acc: acc["out"])
        none = F.array().cast("array<struct<k:int,start:int,end:int,value:string,base:boolean>>")
        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), at))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans_text(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1)
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, min_score: float = 0.9, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, base, added): spans as arrays of (k, start, end, value, base) for each row of ``docs``."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    every = F.concat(*[find_all(t, k, BASE[k], base_ok, True) for k in KINDS], *[find_all(t, k, LOOSE[k], loose_ok, False) for k in KINDS])
    low = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\x20]+", ""))

    def with_context(x: Column) -> Column:
        left = F.substring(t, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))
        right = F.substring(t, x["end"] + 1, F.lit(CONTEXT))
        two = F.regexp_extract(left, r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D:]*$", 1)
        one = F.regexp_extract(left, r"([^\x20\x09-\x0D:]+)[\x20\x09-\x0D:]*$", 1)
        after = F.regexp_extract(right, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
        return F.struct(*[x[c].alias(c) for c in ("k", "start", "end", "value", "base")],
                        low(F.regexp_replace(two, r"[\x20\x09-\x0D]+", " ")).alias("before"), F.concat_ws("_", low(one), low(after)).alias("around"))
    found = saved(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.transform(every, with_context).alias("all")))
    each = found.select("key", F.explode("all").alias("x")).select("key", "x.*")
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    loose = F.filter("all", lambda x: ~x["base"] & ~F.exists("all", lambda y: y["base"] & overlaps(x, y)))
    open_spans = found.select("key", F.explode(loose).alias("x")).select("key", "x.*")
    edges = each.where("base").unionByName(open_spans).select(
        "k", "value", "base", F.explode(F.array(F.concat(F.lit("b:"), "before"), F.concat(F.lit("a:"), "around"))).alias("pattern"))
    edges = saved(edges.where(~F.col("pattern").isin("b:", "a:_")).groupBy("k", "value", "pattern").agg(F.max("base").alias("seed")))
    good, passed = None, 0
    while True:
        score = good
        for _ in range(rounds):
            known = edges.withColumn("score", F.lit(0.0)) if score is None else edges.join(score, ["k", "value"], "left")
            scored = known.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
            patterns = scored.groupBy("k", "pattern").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"),
                                                          F.count_if(F.col("seed") | (F.col("score") >= min_score)).alias("support"))
            patterns = patterns.where(F.col("support") >= min_seeds).select("k", "pattern", F.least(F.col("s") / F.col("n"), F.lit(0.999)).alias("conf"))
            score = saved(edges.where(~F.col("seed")).join(patterns, ["k", "pattern"]).groupBy("k", "value")
                          .agg((1 - F.exp(F.sum(F.ln(1 - F.col("conf"))))).alias("score")))
        good = score.where(F.col("score") >= min_score)
        before, passed = passed, good.count()
        if passed <= before:
            break
    good = good.select("k", "value")
    added = (open_spans.join(good, ["k", "value"]).select("key", F.struct("k", "start", "end", "value", "base").alias("x")).distinct()
             .groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("added")))
    slim = found.select("doc_id", "key", F.transform(F.filter("all", lambda x: x["base"]), lambda x: F.struct(*[x[c].alias(c) for c in ("k", "start", "end", "value", "base")])).alias("base"))
    return (slim.join(added, "key", "left")
            .select("doc_id", "key", "base", F.coalesce("added", F.array().cast(slim.schema["base"].dataType)).alias("added")))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with ``redacted``: the text with each span replaced by its kind in angle brackets."""
    spans = find_spans(docs, text=text, doc_id=doc_id, **options).select("key", F.sort_array(F.transform(
        F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k")))).alias("__spans")).dropDuplicates(["key"])
    t = F.coalesce(F.col(text), F.lit(""))
    name = lambda x: F.element_at(F.array(*[F.lit(f"<{k}>") for k in KINDS]), x["k"] + 1)
    step = lambda acc, x: F.when(x["start"] < acc["pos"], acc).otherwise(F.struct(
        x["end"].alias("pos"), F.concat(acc["out"], F.substring(t, acc["pos"] + 1, x["start"] - acc["pos"]), name(x)).alias("out")))
    out = F.aggregate("__spans", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step,
                      lambda acc: F.concat(acc["out"], F.substring(t, acc["pos"] + 1, F.length(t))))
    return (docs.join(spans, F.xxhash64(F.col(doc_id), F.col(text)) == F.col("key"), "left")
            .select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "redacted"], out.alias("redacted")))
