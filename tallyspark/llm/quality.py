"""Quality rules: statistics of a text as column expressions and a learned decision list.

The list is learned by sequential covering from labelled statistics. The labelled
rows are split into a growing and a pruning part. A rule is a conjunction of
thresholds (statistic <= t or >= t); it grows by the condition with the largest
information gain (FOIL) until it covers no accepted row of the growing part or
nothing improves, and is then cut back to the prefix that does best on the pruning
part. A rule is kept if its precision on all labelled rows reaches
``min_precision`` and it covers at least ``min_cover`` rejects; the rejects it covers
are removed and the next rule grows on the rest. The list becomes one ordered
``CASE WHEN``; the first rule that fires rejects the document, the default keeps it.

Candidate thresholds are cut points of the labelled rows' own values. The fit reads
at most ``max_rows`` labels, those with the smallest hash of doc_id, and of the rows they
meet as many at most (a bounded sample, the only one here); statistics and verdicts cover all rows
and whole texts.

Statistics run in the JVM (no Python on rows). Repeated word windows are found per
text: window hashes are sorted together with their positions, equal neighbours mark
their positions, and marked positions give the covered words.

Defined cases. Null, empty or blank text: no words, all statistics 0, base_failed.
Null or conflicting labels: a null label is left out; a document with two different labels
counts twice, rows equal in doc_id, label and statistics once. Labels without a document are left out. No label at all, or labels of one kind:
an empty list that keeps whatever the base rules keep. Very long texts are one array per
row. Input columns named like an added one give way.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.text import SPACES, count_chars, free_name, once, without, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50  # per cent of the words


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """How many words of the array lie in a 3-word window that occurs at least twice in it."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        marked = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # Most texts repeat no window; the others sort the hashes with their positions.
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(count)


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares learned from."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    d = without(docs, [*names, *FEATURES])
    st = free_name(d, "__st")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    found = F.struct(
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        count_chars(t, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).alias("upper"), F.regexp_count(t, F.lit("[0-9]")).alias("digits"))
    d = d.select(*[F.col(f"`{c}`") for c in d.columns], once(found).alias(st))
    n, chars = F.col(f"{st}.w.n"), F.col(f"{st}.word_chars")
    per_word = lambda c: c.cast("double") / F.greatest(n, F.lit(1)).cast("double")
    per_char = lambda c: F.col(c).cast("double") / F.greatest(chars, F.lit(1)).cast("double")
    repeat, symbols, dup = F.col(f"{st}.w.r"), F.col(f"{st}.n_symbols"), F.col(f"{st}.n_dup_lines")
    return d.select(*[F.col(f"`{c}`") for c in d.columns if c != st], n.alias("n_words"), chars.alias("word_chars"),
                    symbols.alias("n_symbols"), dup.alias("n_dup_lines"), repeat.alias("n_repeat_words"),
                    per_word(symbols).alias("symbol_share"), per_word(repeat).alias("repeat_share"),
                    per_word(chars).alias("word_length"), per_char(f"{st}.upper").alias("upper_share"),
                    per_char(f"{st}.digits").alias("digit_share"), per_word(dup).alias("dup_line_share"))


FEATURES = ["symbol_share", "repeat_share", "word_length", "upper_share", "digit_share", "dup_line_share"]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


# --- learning -----------------------------------------------------------------------------------------------

Condition = tuple[str, str, float]
Rule = list[Condition]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, dtype=bool)
    for name, op, t in rule:
        hit &= (x[name] <= t) if op == "<=" else (x[name] >= t)
    return hit


def _gain(pos: int, neg: int, before: tuple[int, int]) -> float:
    if pos == 0:
        return 0.0
    return pos * (math.log2(pos / (pos + neg)) - math.log2(before[0] / sum(before)))


def _thresholds(v: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring distinct values, at most ``bins`` of them by rank."""
    u = np.unique(v)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= bins else mid[np.linspace(0, len(mid) - 1, bins).astype(int)]


def _grow(x: dict[str, np.ndarray], y: np.ndarray, bins: int, max_conditions: int) -> Rule:
    rule: Rule = []
    live = np.ones(len(y), dtype=bool)
    while len(rule) < max_conditions and (live & ~y).any():
        before = (int((live & y).sum()), int((live & ~y).sum()))
        if before[0] == 0:
            break
        best: tuple[float, Condition] | None = None
        for name in sorted(x):
            v, yy = x[name][live], y[live]
            order = np.argsort(v, kind="stable")
            sv, cum = v[order], np.cumsum(yy[order])
            for t in _thresholds(v, bins):
                k = int(np.searchsorted(sv, t, side="right"))
                p = int(cum[k - 1]) if k else 0
                for op, a, b in (("<=", p, k - p), (">=", before[0] - p, before[1] - (k - p))):
                    g = _gain(a, b, before)
                    if best is None or g > best[0] + 1e-12:
                        best = (g, (name, op, float(t)))
        if best is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        live &= _covers([best[1]], x, len(y))
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The prefix of the rule with the best (p - n) / (p + n) on the pruning part; the longer of equals."""
    if not len(y):
        return rule
    def worth(r: Rule) -> float:
        hit = _covers(r, x, len(y))
        p, n = int((hit & y).sum()), int((hit & ~y).sum())
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), len(r)))


def learn_list(x: dict[str, np.ndarray], reject: np.ndarray, bins: int = 64, max_rules: int = 12, max_conditions: int = 4,
               min_precision: float = 0.97, min_cover: int = 5) -> list[Rule]:
    """An ordered list of reject rules from feature columns and the reject flag of each labelled row."""
    y = np.asarray(reject, dtype=bool)
    n = len(y)
    rules: list[Rule] = []
    if not y.any() or y.all():
        return rules
    prune = np.arange(n) % 3 == 2
    open_rows = np.ones(n, dtype=bool)
    while len(rules) < max_rules and (open_rows & y).any():
        g, p = open_rows & ~prune, open_rows & prune
        rule = _grow({k: v[g] for k, v in x.items()}, y[g], bins, max_conditions)
        if not rule:
            break
        rule = _prune(rule, {k: v[p] for k, v in x.items()}, y[p])
        hit = _covers(rule, x, n) & open_rows
        tp, fp = int((hit & y).sum()), int((hit & ~y).sum())
        if tp < min_cover or tp / max(1, tp + fp) < min_precision:
            break
        rules.append(rule)
        open_rows &= ~hit
    return rules


def list_column(rules: list[Rule]) -> Column:
    """The number of the first rule that fires (0: none) as one conditional expression."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = None
        for name, op, t in rule:
            c = F.col(name) <= F.lit(t) if op == "<=" else F.col(name) >= F.lit(t)
            test = c if test is None else test & c
        out = F.when(test, k) if out is None else out.when(test, k)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def fit_list(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, text: str = "text", doc_id: str = "doc_id",
             label: str = "quality") -> list[Rule]:
    """Learn the list from the documents that ``labels`` (doc_id, quality: 0 rejects) covers."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .select(F.col(doc_id).alias("__label_id"), F.col(label).alias("__label"))
              .orderBy(F.xxhash64(F.col("__label_id").cast("string")), "__label_id", "__label").limit(max_rows))
    # The chosen labels have at most max_rows rows, which bounds the broadcast.
    covered = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(chosen), F.col("__id") == F.col("__label_id"))
    # Rows that the base rules reject teach the list nothing. A label may meet many rows of one doc_id: equal ones count once, and the limit holds for what is left.
    taught = add_statistics(covered, "__text").where(~base_failed()).select("__id", "__label", *FEATURES).distinct()
    rows = taught.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id", "__label", *FEATURES).limit(max_rows).collect()
    rows = sorted(rows, key=lambda r: (str(r["__id"]), r["__label"], [r[f] for f in FEATURES]))
    x = {f: np.array([r[f] for r in rows], dtype=float) for f in FEATURES}
    return learn_list(x, np.array([r["__label"] == 0 for r in rows], dtype=bool))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed``, ``rule`` (which one rejects; 0: none) and ``kept``."""
    d = add_statistics(without(docs, ["base_failed", "rule", "kept"]), text)
    return (d.withColumn("base_failed", base_failed())
            .withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(list_column(rules)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))
