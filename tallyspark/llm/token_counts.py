"""Edit-aware token counts: a tree of pre-token segments per document.

A tokenizer cuts a text into pre-tokens (a regular expression) and encodes each on its
own. A document's state is a list of leaf segments, each of up to ``LEAF`` pre-tokens
with its characters and tokens, under a binary tree of sums. An edit replaces a range of
characters. Only the leaves that the edit touches, and ``CONTEXT`` characters before it,
are cut into pre-tokens again, until a new pre-token boundary falls on an old leaf
border behind the edit: from there on the rest is the same, because the cutter's choice
depends only on the text from its position on. New leaves replace the old ones and the
sums above them change; the total is the root.

State is a row (text, leaf sizes, leaf tokens, tree), so it can be written, joined with
edits by doc_id and written again. Work for a document is done in one task; documents
are independent and no state is shared.

Defined cases. Null text: an empty text of 0 tokens. A document without edits keeps its
state; edits without a document are ignored. Edits of a document apply in the order of
``edit_no``, then position, then inserted text; positions are code points of the text as the
edits before have left it, and are clipped to it. Null parts of an edit count as 0 or
empty. Repeated doc_ids each get the edits. Extra columns of documents are not carried.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32
CONTEXT = 8
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
COUNTED = "doc_id long, text string, sizes array<int>, tokens array<int>, tree array<long>, n_before long, n_tokens long, n_reencoded long"


class Encoder:
    """Counts tokens of pre-tokens; made once per task from the vocabulary file, which every node has at the same path."""

    def __init__(self, vocabulary: str = VOCABULARY, room: int = 200_000):
        self.seen: dict[str, int] = {}
        self.room = room
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(PATTERN)

    def count(self, text: str) -> int:
        return len(self.coder.encode_ordinary(text))

    def count_pieces(self, pieces: list[str]) -> int:
        """Tokens of pre-tokens, each on its own; counts are remembered while there is room."""
        seen, n = self.seen, 0
        for piece in pieces:
            k = seen.get(piece)
            if k is None:
                if len(seen) >= self.room:
                    seen.clear()
                k = seen[piece] = self.count(piece)
            n += k
        return n


def leaves_of(text: str, start: int, enc: Encoder, stop=None) -> tuple[list[int], list[int], int]:
    """Leaf sizes and tokens from ``start`` on. ``stop(pos)`` tells whether old leaves may go on from a boundary."""
    sizes, tokens, first, pos = [], [], start, start
    pieces: list[str] = []
    for m in enc.cut.finditer(text, start):
        if stop is not None and stop(m.start()):
            break
        pos = m.end()
        pieces.append(m[0])
        if len(pieces) == LEAF:
            sizes.append(pos - first)
            tokens.append(enc.count_pieces(pieces))
            first, pieces = pos, []
    if pieces:
        sizes.append(pos - first)
        tokens.append(enc.count_pieces(pieces))
    return sizes, tokens, pos


class SegmentTree:
    """Sums of characters and tokens over the leaves."""

    def __init__(self, sizes: list[int], tokens: list[int]):
        self.sizes, self.tokens = sizes, tokens
        self.build()

    def build(self) -> None:
        n = 1
        while n < max(1, len(self.tokens)):
            n *= 2
        self.n = n
        self.tree = [0] * n + self.tokens + [0] * (n - len(self.tokens))
        self.chars = [0] * n + self.sizes + [0] * (n - len(self.sizes))
        for i in range(n - 1, 0, -1):
            self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def total(self) -> int:
        return self.tree[1]

    def find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character ``pos`` and where it begins (the last leaf for the end of the text)."""
        i, at = 1, 0
        while i < self.n:
            i *= 2
            if pos >= at + self.chars[i] and self.chars[i + 1]:
                at += self.chars[i]
                i += 1
        return i - self.n, at

    def splice(self, a: int, b: int, sizes: list[int], tokens: list[int]) -> None:
        """Leaves a..b-1 become the new ones; sums above changed leaves are updated, or all if leaves move."""
        same = b - a == len(sizes)
        self.sizes[a:b], self.tokens[a:b] = sizes, tokens
        if not same:
            self.build()
            return
        for k in range(a, b):
            i = k + self.n
            self.tree[i], self.chars[i] = self.tokens[k], self.sizes[k]
            while i > 1:
                i //= 2
                self.tree[i] = self.tree[2 * i] + self.tree[2 * i + 1]
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]


def apply_edit(text: str, tree: SegmentTree, pos: int, drop: int, insert: str, enc: Encoder) -> tuple[str, int]:
    """The edited text and how many characters were encoded again; ``tree`` is updated."""
    pos = min(max(pos, 0), len(text))
    drop = min(max(drop, 0), len(text) - pos)
    new = text[:pos] + insert + text[pos + drop:]
    if not tree.sizes:
        sizes, tokens, _ = leaves_of(new, 0, enc)
        tree.splice(0, 0, sizes, tokens)
        return new, len(new)
    a, begin = tree.find(max(0, pos - CONTEXT))
    shift = len(insert) - drop
    # Old leaf borders at or behind the edit's end, as positions of the new text.
    b, at = tree.find(pos + drop)
    borders: dict[int, int] = {}
    edge = at
    ahead = b

    def resumes(p: int) -> bool:
        nonlocal edge, ahead
        if p < pos + len(insert):
            return False
        while ahead < len(tree.sizes) and edge + shift < p:
            edge += tree.sizes[ahead]
            ahead += 1
        if ahead < len(tree.sizes) and edge + shift == p and edge >= pos + drop:
            borders[p] = ahead
            return True
        return False
    sizes, tokens, end = leaves_of(new, begin, enc, resumes)
    tree.splice(a, borders.get(end, len(tree.sizes)), sizes, tokens)
    return new, end - begin


def _state(text: str, enc: Encoder) -> SegmentTree:
    sizes, tokens, _ = leaves_of(text, 0, enc)
    return SegmentTree(sizes, tokens)


def count_with_edits(docs: DataFrame, edits: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """State and counts of each document after its edits (doc_id, edit_no, pos, drop, insert).

    ``n_before`` and ``n_tokens`` are the totals before and after, ``n_reencoded`` the characters encoded again.
    """
    listed = (edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id"))
              .agg(F.sort_array(F.collect_list(F.struct(
                  F.coalesce("edit_no", F.lit(0)).cast("long").alias("edit_no"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"),
                  F.coalesce("insert", F.lit("")).alias("insert"), F.coalesce("drop", F.lit(0)).cast("long").alias("drop")))).alias("edits")))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = d.join(listed, d["doc_id"] == F.col("__id"), "left").select("doc_id", "text", "edits")
    return counted(rows, vocabulary)


def counted(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, edits) to the columns of COUNTED, document by document."""
    def run(batches):
        enc = Encoder(vocabulary)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("text", "sizes", "tokens", "tree", "n_before", "n_tokens", "n_reencoded")}
            for t, changes in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree, again = _state(t, enc), 0
                out["n_before"].append(tree.total())
                for e in changes or ():
                    t, n = apply_edit(t, tree, e["pos"], e["drop"], e["insert"], enc)
                    again += n
                for c, v in (("text", t), ("sizes", list(tree.sizes)), ("tokens", list(tree.tokens)), ("tree", tree.tree), ("n_tokens", tree.total()), ("n_reencoded", again)):
                    out[c].append(v)
            types = {"text": pa.string(), "sizes": pa.list_(pa.int32()), "tokens": pa.list_(pa.int32()), "tree": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, types.get(c, pa.int64())) for c, v in out.items()]], ["doc_id", *out])
    return rows.mapInArrow(run, COUNTED)


def sample_edits(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Three edits for every document, fixed by its doc_id and length: an insertion, a replacement and a deletion."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    at = lambda k: F.pmod(F.xxhash64(F.col(doc_id), F.lit(k)), F.greatest(n, F.lit(1)).cast("long"))
    edit = lambda k, drop, insert: F.struct(F.lit(k).alias("edit_no"), at(k).alias("pos"), F.lit(drop).alias("drop"), F.lit(insert).alias("insert"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(edit(1, 0, "'l newé text, 42  "), edit(2, 7, "edited"), edit(3, 23, ""))).alias("e")).select("doc_id", "e.*")
