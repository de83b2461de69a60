"""Periodic runs of words, by an online sparse dynamic programme over diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), of at least max(6, 4q) words, that no neighbouring word extends keeping
period q. Diagonal q of a text is the comparison of word i with word i - q; a run of
period q is a stretch of max(6, 4q) - q or more matches on diagonal q, and that is at
least five for every q. So the words are read as windows of five: at each word, the
earlier occurrences of its window (none further back than n / 4) increment the match
length of their diagonals, all other active diagonals end, and one that ends with
sufficient length emits its run at once. A word whose window never occurred before
costs nothing.

A diagonal that is a multiple of q reports the run of q again: such a report has the
same end, no earlier start and a period that q divides, and is dropped. While a run of
period q is open, its multiples are not even followed: between two windows inside the
run they cannot hold anything else (a stretch of period kq that shares kq words with a
run of period q has period q itself). So a text that repeats one word or one passage
throughout costs one step a word. The worst case left is many different long runs of
the same words in one text: the work grows with the pairs of their words.

A document is one row and is handled in one piece; the memory is a few arrays of its
number of words. Rows are independent: no shuffle, no state between them.

Defined cases. Null, empty or blank text: no words, no runs, collapsed text "".
Repeated rows and null ids: each row has its own result. A rewrite rule (see
``repeat_tail``) leaves rows with a null id as they are. Empty table: no rows. Input
columns named like an added one give way.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.text import without

WINDOW = 5
MIN_LENGTH, MIN_PERIODS = 6, 4
BATCH_ROWS = 512
ADDED = ["n_words", "runs", "collapsed"]

Run = tuple[int, int, int]
Rewrite = Callable[[object, list[str]], list[str]]

find_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def repeat_tail(doc_id: object, words: list[str]) -> list[str]:
    """The words, where every tenth document (by a checksum of its id) repeats a stretch to its end; a rule of the id and the length alone."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[:n - a]


def windows(words: list[str]) -> np.ndarray:
    """A number for the window of five words that starts at each word but the last four; equal numbers mean equal windows."""
    # Numbers of words pair up to numbers of pairs, of fours and of fives: exact, without hash collisions.
    known: dict[str, int] = {}
    one = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]
    two = joined(one[:-1], one[1:])
    four = joined(two[:-2], two[2:])
    return joined(four[:-1], one[4:])


def sufficient(lag, matched):
    """Whether so many matched windows on a diagonal make a run (numbers or arrays)."""
    return matched + (WINDOW - 1) >= np.maximum(MIN_LENGTH - lag, (MIN_PERIODS - 1) * lag)


class Diagonals:
    """The active diagonals of one text: lag -> matched windows so far. Few lags are kept in a dict, many in arrays over all lags."""

    FEW = 64

    def __init__(self, farthest: int):
        self.few: dict[int, int] | None = {}
        self.lags = np.empty(0, np.int64)
        # With many lags: valid for a lag that was touched one word ago.
        self.length = np.zeros(farthest + 1, np.int64)
        self.touched = np.full(farthest + 1, -2, np.int64)
        self.open_run: tuple[int, int] | None = None  # the smallest period now sufficient, and its start
        self.last = -2
        self.runs: list[Run] = []

    def end(self, ended: list[tuple[int, int]]) -> None:
        """Emit the runs of (lag, matched) diagonals whose last match is the window ``last``; multiples of a run found go."""
        found: list[Run] = []
        for q, m in sorted(ended):
            start = self.last + 1 - m - q
            if not any(q % p == 0 and s <= start for s, _, p in found):
                found.append((start, m + WINDOW - 1 + q, q))
        self.runs.extend(found)

    def end_all(self) -> None:
        self.step(self.last + 1, [])

    def step(self, i: int, lags: list[int] | np.ndarray) -> None:
        """Window ``i`` equals the windows so many words back; all other diagonals end."""
        if self.last != i - 1:
            self.end_all()
        if len(lags) > self.FEW:
            self.step_many(i, np.asarray(lags))
        else:
            self.step_few(i, lags)
        self.last = i

    def step_few(self, i: int, lags) -> None:
        if self.few is None:
            self.few = dict(zip(self.lags.tolist(), self.length[self.lags].tolist()))
        old, new, smallest = self.few, {}, None
        for lag in lags:
            lag = int(lag)
            new[lag] = m = old.get(lag, 0) + 1
            if m + (WINDOW - 1) >= max(MIN_LENGTH - lag, (MIN_PERIODS - 1) * lag) and (smallest is None or lag < smallest):
                smallest = lag
        if any(lag not in new for lag in old):
            self.end([(lag, m) for lag, m in old.items() if lag not in new and sufficient(lag, m)])
        self.few = new
        self.open_run = None if smallest is None else (smallest, i + 1 - new[smallest] - smallest)

    def step_many(self, i: int, lags: np.ndarray) -> None:
        if self.few is not None:
            self.lags = np.fromiter(self.few, np.int64, len(self.few))
            self.length[self.lags] = list(self.few.values())
            self.touched[self.lags] = i - 1
            self.few = None
        count = np.where(self.touched[lags] == i - 1, self.length[lags] + 1, 1)
        self.touched[lags] = i
        ended = self.lags[self.touched[self.lags] != i]
        ended = ended[sufficient(ended, self.length[ended])]
        if len(ended):
            self.end(list(zip(ended.tolist(), self.length[ended].tolist())))
        self.length[lags] = count
        self.lags = lags
        enough = lags[sufficient(lags, count)]
        q = int(enough.min()) if len(enough) else None
        self.open_run = None if q is None else (q, i + 1 - int(self.length[q]) - q)


def find_runs(words: list[str]) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < MIN_LENGTH or len(set(zip(*(words[k:] for k in range(WINDOW))))) == n - WINDOW + 1:
        return []
    farthest = n // MIN_PERIODS
    ids = windows(words)
    # Windows grouped by content, in order; ``place`` is where each stands, ``first`` where its group begins.
    order = np.argsort(ids, kind="stable")
    begins = np.flatnonzero(np.diff(ids[order], prepend=-1))
    place, first = np.empty((2, len(order)), np.int64)
    place[order] = np.arange(len(order))
    first[order] = np.repeat(begins, np.diff(begins, append=len(order)))
    # Only windows that occurred before, at most ``farthest`` words back.
    earlier = np.where(place > first, order[place - 1], -farthest - 1)
    todo = np.flatnonzero(np.arange(len(order)) - earlier <= farthest)
    where, number = order.tolist(), ids.tolist()
    diagonals = Diagonals(farthest)
    for i, lo, hi in zip(todo.tolist(), first[todo].tolist(), place[todo].tolist()):
        if where[lo] < i - farthest:
            lo = bisect_left(where, i - farthest, lo, hi)
        run = diagonals.open_run if diagonals.last == i - 1 else None
        own: list[int] = []
        if run and hi - lo > 1 and number[i] == number[i - run[0]]:
            q, start = run
            inside = bisect_left(where, start, lo, hi)
            if hi - inside == (i - max(start, i - farthest)) // q:  # inside the run, only its own multiples
                hi, own = inside, [q]
        if hi - lo > Diagonals.FEW:
            lags = np.append(i - order[lo:hi], own).astype(np.int64)
            if run and not own:
                lags = lags[(i - lags < run[1]) | (lags % run[0] != 0) | (lags == run[0])]
        else:
            lags = [i - j for j in where[lo:hi]] + own
            if run and not own:
                lags = [d for d in lags if i - d < run[1] or d % run[0] or d == run[0]]
        diagonals.step(i, lags)
    diagonals.end_all()
    return sorted(set(diagonals.runs), key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rewrite: Rewrite | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (array of start, length, period, by start and period) and ``collapsed`` (the kept words,
    joined by one space). ``rewrite(doc_id, words)`` may replace a document's words first."""
    docs = without(docs, ADDED)
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", run_type),
                           T.StructField("collapsed", T.StringType())])
    names = [c.lower() for c in docs.columns]
    text_at, id_at = names.index(text.lower()), names.index(doc_id.lower())
    arrow_runs = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(k, BATCH_ROWS)
                n_words, found, collapsed = [], [], []
                for key, t in zip(b.column(id_at).to_pylist(), b.column(text_at).to_pylist()):
                    words = find_words(t or "")
                    if rewrite:
                        words = rewrite(key, words)
                    runs = find_runs(words)
                    n_words.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(" ".join(collapse(words, runs)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), pa.array(found, arrow_runs),
                                                  pa.array(collapsed, pa.string())], [f.name for f in schema.fields])
    return docs.mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def runs_text(runs: Column) -> Column:
    """``start,length,period`` of every run, each with a line end."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
