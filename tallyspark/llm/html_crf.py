"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text under one block element, with the chain of
open elements above. Each block has features of its ancestors (tags and class or id
words) and of its text (length, link share, punctuation, form words). A chain with the
labels boilerplate / main text is trained by maximum likelihood (forward-backward
gradients, AdaGrad) on labelled pages and decoded by Viterbi on every page.

Labelled pages come from ``labelled_pages``: layouts that place text in known parts
(article, menus, banners, sidebars, notices, adverts, forms, comments) under varied
markup, so that the label of every block is known; some notices and footers are long, with their telling
words anywhere, and some articles use such words in passing. Their number is a parameter; the
weights are a few hundred numbers, trained once per run in the driver and broadcast.
Decoding runs in tasks, page by page, and carries nothing between pages.

Defined cases. Null or empty html, or a page without text: an empty string. Unclosed and
misnested tags: an element ends at its own end tag or that of an element around it;
``p`` and ``li`` also end where the next one begins. Repeated rows give equal results.
Other columns are kept; those named like an added one give way. Whole pages of any
length are read; nothing is cut.
"""

from __future__ import annotations

import html as entities
import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspark.llm.text import without

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe svg math object select option head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT_NAME = re.compile(r"[^a-z]+")


class Block:
    __slots__ = ("path", "names", "parts", "linked", "text")

    def __init__(self, path, names):
        self.path, self.names, self.parts, self.linked, self.text = path, names, [], 0, ""


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        value = next(v for v in m.groups()[1:] if v is not None)
        out += [w for w in SPLIT_NAME.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1]
    return tuple(out)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks with text, in page order; text has references decoded and white space made single."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    now: Block | None = None
    links = 0

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        if now is None:
            if raw.isspace():
                return
            now = Block(tuple(t for t, _ in stack), tuple(n for _, ns in stack for n in ns))
            out.append(now)
        now.parts.append(raw)
        if links:
            now.linked += len(raw)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if k >= 0 and (name in BLOCKS or not any(t in BLOCKS for t, _ in stack[k + 1:])):
                if any(t in BLOCKS for t, _ in stack[k:]):
                    now = None
                del stack[k:]
                links = sum(t == "a" for t, _ in stack)
            elif name in BLOCKS:
                now = None
            continue
        if name in RAW:
            if name == "head":
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else (end if name in ("script", "style", "title", "textarea", "template") else at)
            continue
        if name == "br":
            text(" ")
            continue
        if name in VOID:
            if name == "hr":
                now = None
            continue
        if name in BLOCKS:
            now = None
            ends = CLOSES.get(name, {"p"} if name not in ("html", "body") else set())
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t in ends:
                    del stack[k:]
                    break
                if t in BLOCKS:
                    break
        elif name == "a" and links:
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "a")
            del stack[k]
        if not m.group(3).rstrip().endswith("/") or name in BLOCKS:
            stack.append((name, _names(m.group(3))))
            links = sum(t == "a" for t, _ in stack)
    kept = []
    for b in out:
        b.text = " ".join(entities.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
    return kept


SENTENCE = re.compile(r"[.!?;:,](?:\s|$)")
# Words of buttons, notices and credits; one feature tells how dense they are in a block.
CONTROL = re.compile(r"\b(?:cookies?|subscribe|sign (?:in|up)|log ?in|newsletter|advert\w*|sponsored|copyright|all rights reserved|share|reply|privacy|accept|submit|search|terms)\b|©", re.I)


@lru_cache(maxsize=20_000)
def _ancestor_features(path: tuple[str, ...], names: tuple[str, ...]) -> tuple[str, ...]:
    blocks = [t for t in path if t in BLOCKS and t not in ("html", "body")]
    out = {f"in:{t}" for t in blocks} | {f"name:{n}" for n in names}
    out.add(f"leaf:{blocks[-1] if blocks else 'body'}")
    return tuple(sorted(out))


def features(b: Block, first: bool, last: bool) -> list[str]:
    n = len(b.text)
    linked = min(4, 4 * b.linked // max(1, n))
    out = ["bias", f"len:{min(8, n.bit_length())}", f"links:{linked}", f"marks:{min(3, sum(1 for _ in islice(SENTENCE.finditer(b.text), 3)))}", *_ancestor_features(b.path, b.names)]
    controls = len(CONTROL.findall(b.text))
    if controls:  # by the code points to one of them, in powers of two: an article that has one in passing is no notice
        out.append(f"control:{min(12, (n // controls).bit_length())}")
    if first:
        out.append("first")
    if last:
        out.append("last")
    return out


# --- the chain ------------------------------------------------------------------------------------------------

def page_features(blocks: list[Block]) -> list[list[str]]:
    return [features(b, i == 0, i == len(blocks) - 1) for i, b in enumerate(blocks)]


class Chain:
    """Two labels (0 boilerplate, 1 main text), a weight per (feature, label) and per pair of neighbouring labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps

    def scores(self, rows: list[list[str]]) -> list[tuple[float, float]]:
        out = []
        for fs in rows:
            a = b = 0.0
            for f in fs:
                w = self.weights.get(f)
                if w:
                    a += w[0]
                    b += w[1]
            out.append((a, b))
        return out

    def decode(self, rows: list[list[str]]) -> list[int]:
        s = self.scores(rows)
        if not s:
            return []
        best, back = s[0], []
        for cur in s[1:]:
            new, frm = [], []
            for y in (0, 1):
                c = (best[0] + self.steps[0][y], best[1] + self.steps[1][y])
                k = 1 if c[1] > c[0] else 0
                frm.append(k)
                new.append(c[k] + cur[y])
            best = tuple(new)
            back.append(frm)
        y = 1 if best[1] > best[0] else 0
        out = [y]
        for frm in reversed(back):
            y = frm[y]
            out.append(y)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.4, l2: float = 1e-4, seed: int = 7) -> Chain:
    """Maximum-likelihood weights by AdaGrad, one page at a time."""
    names = sorted({f for rows, _ in pages for fs in rows for f in fs})
    ids = {f: i for i, f in enumerate(names)}
    w, gw = np.zeros((len(names), 2)), np.full((len(names), 2), 1e-6)
    step, gs = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    data = [([np.array([ids[f] for f in fs]) for fs in rows], np.array(y)) for rows, y in pages if rows]
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for rows, y in data:
            s = np.array([w[r].sum(0) for r in rows])
            n = len(rows)
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for t in range(1, n):
                fwd[t] = s[t] + np.logaddexp(fwd[t - 1][0] + step[0], fwd[t - 1][1] + step[1])
            for t in range(n - 2, -1, -1):
                x = s[t + 1] + bwd[t + 1]
                bwd[t] = np.logaddexp(step[:, 0] + x[0], step[:, 1] + x[1])
            z = np.logaddexp(*fwd[-1])
            g = -np.exp(fwd + bwd - z)
            g[np.arange(n), y] += 1
            pair = np.zeros((2, 2))
            for t in range(1, n):
                pair -= np.exp(fwd[t - 1][:, None] + step + (s[t] + bwd[t])[None, :] - z)
                pair[y[t - 1], y[t]] += 1
            for r, d in zip(rows, g):
                d = d - l2 * w[r]
                gw[r] += d * d
                w[r] += rate * d / np.sqrt(gw[r])
            gs += pair * pair
            step += rate * pair / np.sqrt(gs)
    return Chain({f: (float(w[i][0]), float(w[i][1])) for f, i in ids.items()}, step.tolist())


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[str]]]:
    """Pages of many layouts with their main blocks (the label of every block is known from where it was placed)."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren tas vor bel dun est ari on ul pre sen tor gal hin".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    serial = iter(range(10**9))

    def sentence(a: int, b: int) -> str:
        mark = rng.choice(["", "", "", "%%%", "!!", " |"])
        return " ".join(word() + mark for _ in range(rng.randint(a, b))).capitalize() + f" {next(serial)}" + rng.choice(".,.!")

    def prose() -> str:
        if rng.random() < 0.12:  # a paragraph of one word that no other block has
            return (word() + "".join(syllables[int(d)] for d in str(next(serial)))).capitalize() + rng.choice(["", "."])
        text = [w for _ in range(rng.choice([1, 1, 2, 3, 6, 12])) for w in sentence(2, 16).split()]
        if len(text) > 50 and rng.random() < 0.3:  # a word of notices in passing
            text.insert(rng.randrange(1, len(text)), rng.choice(["search", "share", "terms", "reply", "submit", "accept", "privacy", "cookies"]))
        return " ".join(text)

    def terms() -> str:
        telling = ["All rights reserved.", "Copyright by the owners.", "Privacy and terms apply.", "We use cookies.", "Subscribe to the newsletter.", "Sign in to share and reply.", "Accept the cookies."]
        return " ".join([sentence(6, 16) for _ in range(rng.randint(1, 12))] + rng.sample(telling, rng.randint(3, 6)))

    pages = []
    for _ in range(n):
        main: list[str] = []

        def own(tag: str, text: str) -> str:
            main.append(text)
            inner = text if rng.random() < 0.7 else f"<b>{text}" + rng.choice(["</b>", "<br>", ""])
            return f"<{tag}>{inner}</{tag}>"

        def around(tags: list[str], words: list[str], body: str) -> str:
            tag = rng.choice(tags)
            name = f' {rng.choice(["class", "id"])}="{rng.choice(words)}{rng.choice(["", "-box", " wide", "-1"])}"' if tag in ("div", "section", "ul", "p") or rng.random() < 0.5 else ""
            return f"<{tag}{name}>{body}</{tag}>"
        p = lambda: f"<p>{sentence(3, 14)}</p>" if rng.random() < 0.6 else sentence(3, 14)
        items = lambda: "<ul>" + "".join(f'<li><a href="/x">{word()}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul>"
        boiler = {
            "menu": lambda: around(["nav", "div"], ["nav", "menu", "navbar", "breadcrumb", "navigation"], items()),
            "header": lambda: around(["header", "div"], ["header", "masthead", "banner", "topbar", "site"], rng.choice([p(), f"<h1>{sentence(1, 4)}</h1>", f"<h2>{sentence(1, 4)}</h2>" + p()])),
            "ad": lambda: around(["div", "aside", "section"], ["ad", "ads", "advert", "sponsor", "promo", "promoted"], p()),
            "side": lambda: around(["aside", "div"], ["sidebar", "related", "widget", "recommended", "trending"], rng.choice([p(), f"<h3>{sentence(1, 4)}</h3>" + items()])),
            "notice": lambda: around(["div", "section", "dialog"], ["cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter"], p() + rng.choice(["", "<button>Accept</button>"])),
            "form": lambda: around(["form", "form", "div"], ["form", "search", "signup", "login", "subscribe"], f"<label>{word()}</label><input name=q><button>{word()}</button>" + rng.choice(["", p()])),
            "comments": lambda: around(["section", "div", "ol"], ["comments", "comment", "discussion", "replies", "responses"], f"<h3>{sentence(1, 3)}</h3>" + "".join(
                rng.choice([f'<div class="comment"><p>{prose()}</p></div>', f"<li>{prose()}</li>", f"<article><p>{prose()}</p></article>"]) for _ in range(rng.randint(1, 3)))),
            "footer": lambda: around(["footer", "footer", "div"], ["footer", "copyright", "legal", "bottom"], rng.choice([f"&copy; {word()} &middot; {sentence(2, 6)}", p(), items()])),
            "legal": lambda: rng.choice([f"<div><p>{terms()}</p></div>", f"<p>{terms()}</p>", around(["footer", "div"], ["footer", "copyright", "legal", "notice"], f"<p>{terms()}</p>")]),
            "share": lambda: around(["div", "ul"], ["share", "social", "tags", "toolbar"], f'<a href="#">{word()}</a> <a href="#">{word()}</a>'),
        }
        body = [own("h1", sentence(2, 10))] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 2, 4, 6, 12])):
            body.append(own(rng.choice(["p", "p", "p", "p", "p", "h2", "blockquote", "pre", "figcaption", "li"]), prose()))
            if rng.random() < 0.05:
                body.append(boiler[rng.choice(["ad", "side", "share", "notice", "form"])]())
        wrap = rng.choice(["article", "article", "article", "main", "div", "section", "body"])
        inner = "".join(body)
        if wrap == "div":
            inner = f'<div class="{rng.choice(["content", "article", "post", "entry", "main", "story", "body"])}">{inner}</div>'
        elif wrap == "section":
            inner = f'<section id="{rng.choice(["content", "article", "post", "main"])}">{inner}</section>'
        elif wrap != "body":
            inner = f"<{wrap}>{inner}</{wrap}>"
        before = "".join(boiler[k]() for k in ("header", "menu", "notice", "ad", "side", "form") if rng.random() < 0.4)
        after = "".join(boiler[k]() for k in ("share", "form", "comments", "ad", "side", "notice", "legal", "footer") if rng.random() < 0.4)
        pages.append((f"<html><body>{before}{inner}{after}</body></html>", [" ".join(entities.unescape(x).split()) for x in main]))
    return pages


def fit(n_pages: int = 400) -> Chain:
    """Train on ``n_pages`` labelled pages (a fixed number, whatever the size of the table)."""
    data = []
    for page, main in labelled_pages(n_pages):
        blocks, known = leaf_blocks(page), set(main)
        data.append((page_features(blocks), [int(b.text in known) for b in blocks]))
    return train(data)


def main_text(page: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(blocks, chain.decode(page_features(blocks))) if y)


def extract(pages: DataFrame, chain: Chain | None = None, html: str = "html") -> DataFrame:
    """``pages`` with ``main_text``: the blocks decoded as main text, joined by empty lines."""
    pages = without(pages, ["main_text"])
    model = pages.sparkSession.sparkContext.broadcast(chain or fit())
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())])
    at = next(i for i, c in enumerate(pages.columns) if c.lower() == html.lower())

    def run(batches):
        for b in batches:
            texts = [main_text(x, model.value) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])
    return pages.mapInArrow(run, schema)
