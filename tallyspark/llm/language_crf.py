"""Language identification word by word, with a linear-chain conditional random field.

Every word (a run of letters, lower-cased) gets a score for each language from its
characters, character n-grams, affixes and, if the training words hold it often enough,
its lexicon entry; a learned matrix scores the change from one word's language to the
next. Forward-backward gives each word's distribution over languages, so code-switched
text falls into segments of one language each. The document's language is the one with
the largest mean probability over its words, and that mean is its score.

The model is fitted on a bounded sample of labelled rows: about ``per_label`` texts of
each language, ``pieces`` passages of ``piece_words`` words from each. Passages of
different documents are strung together, so that the transitions are learned on
sequences that do switch. Only text is a feature; ids and sources are not seen.

Prediction reads whole texts. Word scores depend on the word alone and are computed
once per distinct word of a batch; forward and backward steps run over many documents
at once, ordered by length. Rows are independent: no shuffle.

Defined cases. Null text, or one without a letter: language ``und``, score 0, no
segments. Null languages and null ids are not learned from; labels need at least one
text with a letter. No label at all, or an empty table: every row is ``und``. Ties go to
the language that is first by code points. Repeated rows: each has its own result;
repeated texts count once in the fit. More than ``max_labels`` languages raise. Input
columns named like an added one give way.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.text import once, without
from tallyspark.llm.text import words as split_words

UNDETERMINED = "und"
FEATURES = 1 << 16  # cells for hashed features
GROUP_WORDS = 250_000
BATCH_ROWS = 1024
CACHE_WORDS = 300_000
ADDED = ["lang_pred", "score", "segments"]

_letters = re.compile(r"[^\W\d_]+").findall


def find_words(text: str | None) -> list[str]:
    """The runs of letters, lower-cased."""
    return [w for w in _letters((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


# --- features of words ---

def _hash(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind + 1, np.uint64)
    for p in parts:
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ p
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64) % FEATURES


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, number of the feature), one entry a feature: characters, n-grams of two and three with the word's
    borders, first and last three and four characters, and the lexicon entry."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owners, cells = [], []

    def add(kind: int, at: np.ndarray, n: int) -> None:
        owners.append(owner[at])
        cells.append(_hash(kind, *(codes[at + k] for k in range(n))))
    for n in (1, 2, 3):
        at = np.arange(len(codes) - n + 1)
        add(n, at[owner[at] == owner[at + n - 1]], n)
    for n in (4, 5):
        long = sizes >= n
        add(2 * n, starts[long], n)
        add(2 * n + 1, ends[long] - n, n)
    known = [(i, FEATURES + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        who, entry = np.array(known, np.int64).T
        owners.append(who)
        cells.append(entry)
    return np.concatenate(owners), np.concatenate(cells)


# --- the chain ---

class Packed:
    """Sequences side by side, longest first: step t of all that are long enough lies together."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.counts = np.bincount(lengths - 1, minlength=int(lengths.max()))[::-1].cumsum()[::-1]  # sequences that have a step t
        self.begin = np.r_[0, np.cumsum(self.counts)]
        # Where the words of one sequence after the other stand in the packed order.
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.where = self.begin[step] + np.repeat(np.arange(len(lengths)), lengths)


@dataclass(frozen=True)
class Chain:
    """A trained model: labels in code-point order, feature weights (one row a feature), start and transition scores."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    change: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        scores = np.empty((len(words), len(self.labels)))
        for k in range(0, len(words), 20_000):
            part = words[k:k + 20_000]
            owner, cell = word_features(part, self.lexicon)
            for y in range(len(self.labels)):
                scores[k:k + len(part), y] = np.bincount(owner, self.weights[cell, y], len(part))
        return scores

    def marginals(self, scores: np.ndarray, packed: Packed) -> tuple[np.ndarray, np.ndarray, float]:
        """Distribution of each word's label, expected transitions, and the log of the partition function (scores in packed order)."""
        top = scores.max(axis=1, keepdims=True)
        p = np.exp(scores - top)
        shift = float(self.change.max())
        change = np.exp(self.change - shift)
        forward, scale = np.empty_like(p), np.empty(len(p))
        begin, counts = packed.begin, packed.counts
        first = self.start - self.start.max()
        a = np.exp(first) * p[:counts[0]]
        for t, n in enumerate(counts):
            lo = begin[t]
            if t:
                a = (a[:n] @ change) * p[lo:lo + n]
            s = a.sum(axis=1)
            a = a / s[:, None]
            forward[lo:lo + n], scale[lo:lo + n] = a, s
        gamma = np.empty_like(p)
        moves = np.zeros_like(change)
        after = np.ones((counts[-1], len(self.labels)))
        for t in range(len(counts) - 1, -1, -1):
            lo, n = begin[t], counts[t]
            if t + 1 < len(counts):
                m, hi = counts[t + 1], begin[t + 1]
                right = p[hi:hi + m] * after / scale[hi:hi + m, None]
                moves += (forward[lo:lo + m].T @ right) * change
                after = np.vstack([right @ change.T, np.ones((n - m, len(self.labels)))])
            gamma[lo:lo + n] = forward[lo:lo + n] * after
        gamma /= gamma.sum(axis=1, keepdims=True)
        steps = len(p) - counts[0]
        log_z = float(np.log(scale).sum() + top.sum() + steps * shift + counts[0] * self.start.max())
        return gamma, moves, log_z


def gradient(chain: Chain, features: tuple[np.ndarray, np.ndarray], ids: np.ndarray, gold: np.ndarray, packed: Packed,
             n_words: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of the gold labels (packed order), and its gradient by weights, start and transition scores."""
    owner, cell = features
    n_labels = len(chain.labels)
    scores = np.stack([np.bincount(owner, chain.weights[cell, y], n_words) for y in range(n_labels)], axis=1)[ids]
    gamma, moves, log_z = chain.marginals(scores, packed)
    first = packed.counts[0]
    seen = np.zeros_like(moves)
    for t in range(len(packed.counts) - 1):
        lo, hi, m = packed.begin[t], packed.begin[t + 1], packed.counts[t + 1]
        np.add.at(seen, (gold[lo:lo + m], gold[hi:hi + m]), 1.0)
    start = np.bincount(gold[:first], minlength=n_labels).astype(float)
    likelihood = float(scores[np.arange(len(gold)), gold].sum() + (seen * chain.change).sum() + start @ chain.start) - log_z
    rest = -gamma
    rest[np.arange(len(gold)), gold] += 1.0
    by_word = np.stack([np.bincount(ids, rest[:, y], n_words) for y in range(n_labels)], axis=1)
    by_weight = np.stack([np.bincount(cell, by_word[owner, y], len(chain.weights)) for y in range(n_labels)], axis=1)
    return likelihood, by_weight, start - gamma[:first].sum(axis=0), seen - moves


def train(passages: list[tuple[str, list[str]]], rounds: int = 60, rate: float = 0.1, penalty: float = 0.002, least: int = 3,
          chained: int = 8, seed: int = 7) -> Chain | None:
    """Fit on (label, words) passages: ``chained`` passages in random order make one sequence; Adam on the penalised likelihood."""
    passages = sorted((y, w) for y, w in passages if w)
    labels = sorted({y for y, _ in passages})
    if not labels:
        return None
    random.Random(seed).shuffle(passages)
    number = {y: k for k, y in enumerate(labels)}
    sequences = [passages[k:k + chained] for k in range(0, len(passages), chained)]
    sequences.sort(key=lambda s: -sum(len(w) for _, w in s))
    packed = Packed(np.array([sum(len(w) for _, w in s) for s in sequences]))
    seen = Counter(w for _, ws in passages for w in ws)
    lexicon = {w: k for k, w in enumerate(sorted(w for w, n in seen.items() if n >= least))}
    vocabulary = {w: k for k, w in enumerate(seen)}
    ids, gold = np.empty((2, int(packed.lengths.sum())), np.int64)
    ids[packed.where] = [vocabulary[w] for s in sequences for _, ws in s for w in ws]
    gold[packed.where] = [number[y] for s in sequences for y, ws in s for _ in ws]
    features = word_features(list(vocabulary), lexicon)
    values = [np.zeros((FEATURES + len(lexicon), len(labels))), np.zeros(len(labels)), np.zeros((len(labels), len(labels)))]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, rounds + 1):
        _, *slopes = gradient(Chain(labels, lexicon, *values), features, ids, gold, packed, len(vocabulary))
        for v, g, m, q in zip(values, slopes, mean, square):
            g = g / len(ids) - penalty / len(passages) * v
            m += 0.1 * (g - m)
            q += 0.02 * (g * g - q)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.98**step)) + 1e-8)
    return Chain(labels, lexicon, *values)


def sampled_passages(docs: DataFrame, text: str, label: str, doc_id: str, per_label: int, pieces: int, piece_words: int,
                     max_labels: int) -> list[tuple[str, list[str]]]:
    """Passages of about ``per_label`` texts of each label, chosen by a hash of id and text; repeated texts count once."""
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").cast("string").alias("y"), F.col(f"`{doc_id}`").cast("string").alias("i"))
    rows = rows.where("t is not null and y is not null and i is not null")
    counts = rows.groupBy("y").count().limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} languages")
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["y"], min(1.0, per_label / r["count"]))])
    u = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    words = once(split_words(F.col("t")))

    def piece(k: int) -> Column:
        begin = F.pmod(F.xxhash64(F.lit(k), "t"), F.greatest(F.size("w") - piece_words + 1, F.lit(1))) + 1
        return F.array_join(F.slice("w", begin.cast("int"), F.lit(piece_words)), " ")
    chosen = rows.where(u < share[F.col("y")]).dropDuplicates(["y", "t"]).select("y", "t", words.alias("w"))
    chosen = chosen.where(F.size("w") > 0).select("y", F.array_distinct(F.array(*[piece(k) for k in range(pieces)])).alias("pieces"))
    # The draw is near per_label rows a label; the limit only bounds the driver's memory.
    return [(r["y"], find_words(p)) for r in chosen.limit(2 * per_label * len(counts)).collect() for p in r["pieces"]]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", per_label: int = 400, pieces: int = 4,
        piece_words: int = 24, max_labels: int = 200) -> Chain | None:
    """Train on a bounded sample of the labelled rows of ``docs``; None without labels."""
    return train(sampled_passages(docs, text, label, doc_id, per_label, pieces, piece_words, max_labels))


# --- prediction ---

class Scorer:
    """Word scores of one task, computed once per distinct word."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.empty((0, len(self.chain.labels)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The word numbers of each text."""
        if len(self.numbers) > CACHE_WORDS:
            self.forget()
        numbers, found = self.numbers, []
        for t in texts:
            words = find_words(t)
            found.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        new = list(numbers)[len(self.scores):]
        if new:
            self.scores = np.vstack([self.scores, self.chain.word_scores(new)])
        return found


def label_texts(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and segments of each text."""
    chain = scorer.chain
    langs, scores, segments = [UNDETERMINED] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    ids = scorer(texts)
    order = sorted((k for k in range(len(texts)) if len(ids[k])), key=lambda k: -len(ids[k]))
    at = 0
    while at < len(order):
        group, size = [], 0
        while at < len(order) and (not group or size + len(ids[order[at]]) <= GROUP_WORDS):
            group.append(order[at])
            size += len(ids[order[at]])
            at += 1
        lengths = np.array([len(ids[k]) for k in group])
        packed = Packed(lengths)
        numbers = np.empty(size, np.int64)
        numbers[packed.where] = np.concatenate([ids[k] for k in group])
        gamma = chain.marginals(scorer.scores[numbers], packed)[0][packed.where]  # text by text again
        starts = np.cumsum(lengths) - lengths
        means = np.add.reduceat(gamma, starts) / lengths[:, None]
        best = gamma.argmax(axis=1)
        begins = np.flatnonzero(np.r_[True, best[1:] != best[:-1]] | np.isin(np.arange(size), starts))
        ends = np.r_[begins[1:], size]
        sure = np.add.reduceat(gamma[np.arange(size), best], begins) / (ends - begins)
        owner = np.searchsorted(starts, begins, side="right") - 1
        for k, mean in zip(group, means):
            y = int(mean.argmax())
            langs[k], scores[k] = chain.labels[y], float(min(1.0, mean[y]))
        for k, b, e, s in zip(owner.tolist(), begins.tolist(), ends.tolist(), sure.tolist()):
            segments[group[k]].append({"lang": chain.labels[best[b]], "start": b - int(starts[k]), "n_words": e - b, "score": min(1.0, s)})
    return langs, scores, segments


def predict(docs: DataFrame, chain: Chain | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``segments`` (array of lang, start, n_words, score; start counts words)."""
    docs = without(docs, ADDED)
    segment = T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("n_words", T.LongType()),
                            T.StructField("score", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("segments", T.ArrayType(segment))])
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = [c.lower() for c in docs.columns].index(text.lower())
    arrow = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for whole in batches:
            for k in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(k, BATCH_ROWS)
                if scorer:
                    langs, scores, segments = label_texts(scorer, b.column(at).to_pylist())
                else:
                    langs, scores, segments = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows, [[]] * b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(segments, arrow)],
                                                 [f.name for f in schema.fields])
    return docs.mapInArrow(run, schema)
