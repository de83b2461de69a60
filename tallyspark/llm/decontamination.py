"""Benchmark decontamination by template canonicalisation.

Numbers, names and units in a text become typed placeholders, other words lose case
and punctuation; white space of any kind and length is one space. Windows of ``width`` canonical words (one word less than a shorter item)
of the benchmark are hash-joined with those of the documents; matches on one
alignment (document, item, offset) are gathered, and the values behind the
placeholders are compared: each value of the item must stand for one value of the
document throughout. So a question whose numbers and names were swapped consistently
is caught, and chance hits on templates are not. What the template leaves out, windows with
few literal words and items of fewer than five words, has an exact path: all windows are also
hashed over the plain words (lower case, no punctuation), and, for copies in another case, over the words with
placeholders for numbers and units only. A document has an item if one
consistent alignment covers ``min_words`` words of it (or all but the first word of a shorter item, or the whole of an item of fewer than five words).

A window can only match where its literal words stand. Each benchmark window has an anchor, its longest run of up to three
neighbouring literal words; texts that hold no anchor of any window, most of them, are not marked, formed or hashed, and of
the others only the windows that hold the place of an anchor are hashed. Both leave out only what no benchmark window can equal.

Everything is a column expression or a join. Documents send only (key, position,
hash) to the join; the benchmark's windows are broadcast when they are counted to be
few, and joined by shuffle otherwise.

Defined cases. Null, empty or blank text: no window, never contaminated. Windows with
fewer than half literal words, and items of fewer than five words, are found by their plain words only. An item of one or
two words is no evidence inside a text and is not searched for. Items that share a passage each count.
Repeated rows (equal doc_id and text) give one result. A null doc_id is kept as null.
Empty documents or benchmark: no rows. The longest texts are one array per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.quality import let
from tallyspark.llm.text import free_name, saved, words

WIDTH = 8
MIN_WORDS = 13
MIN_ITEM_WORDS = 5  # from which an item has templates
MIN_EXACT_WORDS = 3
MAX_BROADCAST_WINDOWS = 1_000_000  # of about 40 bytes each
ANCHOR_WORDS = 3
MAX_ANCHORS = 50_000  # beyond, texts are not tested for anchors first; the result is the same
# The spaces of Unicode beyond ASCII.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~\u00a0-\u00bf\u2010-\u2060\u3000-\u3020]"
# The same as characters, less the spaces among them.
PUNCTUATION_CHARS = "".join(c for low, high in ("!/", ":@", "[`", "{~", "\u00a0\u00bf", "\u2010\u2060", "\u3000\u3020")
                            for c in map(chr, range(ord(low), ord(high) + 1)) if c not in WIDE_SPACES)
NUMBER, NAME, UNIT, PUNCTUATION, LONE, END = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
# Unit words that become a placeholder.
UNITS = ("mm", "cm", "m", "km", "millimeter", "millimeters", "millimetre", "millimetres", "centimeter", "centimeters", "centimetre", "centimetres", "meter", "meters",
         "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg",
         "milligram", "milligrams", "gram", "grams", "kilogram", "kilograms", "kilo", "kilos", "pound", "pounds", "lb", "lbs", "ounce", "ounces", "oz", "ton", "tons", "tonne", "tonnes",
         "ml", "cl", "l", "milliliter", "milliliters", "millilitre", "millilitres", "liter", "liters", "litre", "litres", "gallon", "gallons", "quart", "quarts", "pint", "pints",
         "cup", "cups", "teaspoon", "teaspoons", "tablespoon", "tablespoons", "acre", "acres", "hectare", "hectares", "millisecond", "milliseconds", "second", "seconds", "minute",
         "minutes", "hour", "hours", "hr", "hrs", "day", "days", "week", "weeks", "month", "months", "year", "years", "decade", "decades", "century", "centuries", "percent",
         "dollar", "dollars", "usd", "cent", "cents", "euro", "euros", "eur", "penny", "pence", "rupee", "rupees", "yen", "peso", "pesos", "degree", "degrees", "celsius", "fahrenheit",
         "kelvin", "mph", "kph", "knot", "knots", "watt", "watts", "kw", "kwh", "kilowatt", "kilowatts", "volt", "volts", "amp", "amps", "ohm", "ohms", "joule", "joules", "calorie",
         "calories", "newton", "newtons", "hertz", "hz", "khz", "mhz", "byte", "bytes", "kb", "mb", "gb")
# The same by first letter, so that other words fail at it.
UNIT_WORD = "|".join(f"{c}(?:{'|'.join(sorted(u[1:] for u in UNITS if u[0] == c))})" for c in sorted({u[0] for u in UNITS}))


def spaced(text: Column) -> Column:
    """The text (null: empty) with every Unicode space as an ASCII one."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), t).otherwise(F.translate(t, WIDE_SPACES, " " * len(WIDE_SPACES)))


def marked(text: Column) -> Column:
    """The text in lower case without punctuation, with marks before (and after, for numbers) what a placeholder can replace; as many words as before.

    Each expression begins with a character that is rare or cheap to test; lookbehinds come after it.
    """
    word = r"[^\x20\x09-\x0D]"
    t = F.regexp_replace(F.concat(F.lit(" "), spaced(text)), r"[\x20\x09-\x0D]{2,}+|[\x09-\x0D]", " ")
    t = F.regexp_replace(t, r"[0-9]++(?:[.,:/][0-9]++){0,20}", NUMBER + "$0" + END)
    # A capitalised word inside a sentence: the word before it does not end one.
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<=[^\x20\x09-\x0D.!?:;\x22)]\x20\p{{Lu}})\p{{Ll}}{word}*+", NAME + "$0")
    t = F.regexp_replace(t, PUNCTUATION_CLASS + "++", PUNCTUATION)
    t = F.regexp_replace(t, rf"\u0004(?<!{word}\u0004)(?!{word})", LONE)
    t = F.lower(F.replace(t, F.lit(PUNCTUATION), F.lit("")))
    return F.regexp_replace(t, rf"([\x20\u0006])((?:{UNIT_WORD})(?!{word}))", "$1" + UNIT + "$2")


def canonical_words(m: Column) -> Column:
    """The words of a marked text with placeholders for numbers, names and units."""
    return words(F.regexp_replace(m, r"(\u0001)[^\u0006\x20\x09-\x0D]*+\u0006|([\u0002\u0003])[^\x20\x09-\x0D]*+", "$1$2"))


def half_words(m: Column) -> Column:
    """The words of a marked text with placeholders for numbers and units."""
    return words(F.translate(F.regexp_replace(m, r"(\u0001)[^\u0006\x20\x09-\x0D]*+\u0006|(\u0003)[^\x20\x09-\x0D]*+", "$1$2"), NAME + END, ""))


def plain_words(m: Column) -> Column:
    return words(F.translate(m, NUMBER + NAME + UNIT + END, ""))


FORMS = ("canon", "half", "plain")


def all_forms(text: Column) -> Column:
    """The forms as arrays of words; one without marks to tell it from the form before is not made again."""
    def forms(m: Column) -> Column:
        typed = m.contains(NUMBER) | m.contains(UNIT)
        return let(F.when(typed | m.contains(NAME), canonical_words(m)).otherwise(words(m)), lambda c: let(
            F.when(m.contains(NAME), half_words(m)).otherwise(c), lambda h: F.struct(
                c.alias("canon"), h.alias("half"), F.when(typed, plain_words(m)).otherwise(h).alias("plain"))))
    return let(marked(text), forms)


def window_hashes(w: Column, width: Column | int) -> Column:
    """Hashes of all windows of ``width`` words, in order."""
    n = F.size(w) - width
    return F.when(n < 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, width))))


def placed_hashes(w: Column, starts: Column, width: int) -> Column:
    return F.transform(starts, lambda i: F.struct(
        F.lit(width).alias("w"), i.alias("pos"), F.xxhash64(F.array(*[F.get(w, i + k) for k in range(width)])).alias("h")))


def window_starts(n_words: Column, width: int, places: Column | None) -> Column:
    """Where the windows begin that hold one of ``places``; all windows if there are none given."""
    last = n_words - width
    if places is None:
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    else:
        near = F.filter(places, lambda i: i - width < last + 1)  # the others are in no whole window
        starts = F.array_distinct(F.flatten(F.transform(near, lambda i: F.sequence(F.greatest(i - width + 1, F.lit(0)), F.least(i, last)))))
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(starts)


def form_hashes(forms: Column, width: int, places: Column | None) -> Column:
    """The window hashes of the first form, and of each other one where it differs from the one before."""
    def changed(k: str, j: str, starts: Column) -> Column:
        some = F.filter(starts, lambda i: F.slice(forms[k], i + 1, width) != F.slice(forms[j], i + 1, width))
        return placed_hashes(forms[k], F.when(forms[k] == forms[j], F.array().cast("array<int>")).otherwise(some), width)
    return let(window_starts(F.size(forms[FORMS[0]]), width, places), lambda starts: F.concat(
        placed_hashes(forms[FORMS[0]], starts, width), *[changed(k, j, starts) for j, k in zip(FORMS, FORMS[1:])]))


def is_slot(w: Column) -> Column:
    return w.rlike("[\u0001-\u0003]")


def anchor_of(window: Column) -> Column:
    """The longest run of up to three neighbouring literal words, as text; null if there is no literal word."""
    literal = lambda x: ~x.rlike("[\u0001-\u0006]")

    def best(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(window) - n + 1, F.lit(1))), lambda i: F.slice(window, i, n))
        texts = F.transform(F.filter(runs, lambda r: (F.size(r) == n) & F.forall(r, literal)), lambda r: F.array_join(r, " "))
        return F.array_max(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.coalesce(*[best(n) for n in range(ANCHOR_WORDS, 0, -1)])


def bare_words(text: Column) -> Column:
    """The words in lower case without punctuation, lone punctuation left out: one pass over the characters and one split at a single character."""
    spaces = "\t\n\u000b\f\r" + WIDE_SPACES
    t = F.translate(F.coalesce(text, F.lit("")), spaces + PUNCTUATION_CHARS, " " * len(spaces))
    return F.array_remove(F.split(F.lower(t), " "), "")


class Anchors:
    """Tests for anchors in an array of words.

    Words are first looked up among the anchors' longest words, which are rare; only at these places the neighbours are compared."""

    def __init__(self, anchors: list[str]):
        self.by_place: dict[tuple[int, int], list[str]] = {}  # number of words and place of the longest one -> anchors
        for a in anchors:
            parts = a.split(" ")
            self.by_place.setdefault((len(parts), max(range(len(parts)), key=lambda k: len(parts[k]))), []).append(a)
        self.longest = sorted({a.split(" ")[k] for (_, k), some in self.by_place.items() for a in some})

    def _here(self, w: Column, i: Column) -> Column:
        found = F.lit(False)
        for (n, k), some in sorted(self.by_place.items()):
            found = found | F.concat_ws(" ", *[F.get(w, i + j - k) for j in range(n)]).isin(sorted(some))
        return found

    def _candidates(self, w: Column) -> Column:
        return F.array_compact(F.transform(w, lambda x, i: F.when(x.isin(self.longest), i)))

    def places(self, w: Column) -> Column:
        """Where the longest word of an anchor stands among the others."""
        return F.filter(self._candidates(w), lambda i: self._here(w, i))

    def stand_in(self, text: Column) -> Column:
        """Whether any anchor stands in the text's plain words; lone punctuation is passed over, which only lets more texts through."""
        return let(bare_words(text), lambda w: F.exists(self._candidates(w), lambda i: self._here(w, i)))


def benchmark_windows(benchmark: DataFrame, width: int, text: str, item_id: str) -> tuple[DataFrame, DataFrame]:
    items = (benchmark.select(F.col(item_id).alias("item_id"), words(spaced(F.col(text))).alias("item_raw"), all_forms(F.col(text)).alias("item"))
             .withColumn("n", F.size("item_raw")).where((F.col("n") >= MIN_EXACT_WORDS) & (F.size("item.canon") == F.col("n")) & (F.size("item.plain") == F.col("n")))
             # Whether the first word is a name depends on what stands before it, so a window need not hold it.
             .withColumn("w", F.when(F.col("n") < MIN_ITEM_WORDS, F.col("n")).otherwise(F.least(F.col("n") - 1, F.lit(width)))))
    wins = None
    for k in FORMS:
        some = items.select("item_id", "n", "w", F.col(f"item.{k}").alias("words"), F.posexplode(window_hashes(F.col(f"item.{k}"), F.col("w"))).alias("ipos", "h"))
        literal = F.size(F.filter(F.slice(F.col("words"), F.col("ipos") + 1, F.col("w")), lambda x: ~is_slot(x)))
        if k != "plain":
            some = some.where((F.col("n") >= MIN_ITEM_WORDS) & (2 * literal >= F.col("w")))
        some = some.select("item_id", "w", "ipos", "h", anchor_of(F.slice(F.col("words"), F.col("ipos") + 1, F.col("w"))).alias("anchor"))
        wins = some if wins is None else wins.union(some)
    return items.drop("n"), wins.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_words: int = MIN_WORDS, text: str = "text",
                 doc_id: str = "doc_id", item_id: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(key, doc_id, item_id, n_words, item_words, n_slots, n_changed): key identifies the row by doc_id and text."""
    items, windows = benchmark_windows(benchmark, width, bench_text, item_id)
    items, windows = saved(items), saved(windows)
    widths = [r["w"] for r in windows.select("w").distinct().orderBy("w").collect()]  # at most ``width`` numbers
    anchors = [r["anchor"] for r in windows.select("anchor").distinct().limit(MAX_ANCHORS + 1).collect()]
    windows = windows.drop("anchor")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    known = None if len(anchors) > MAX_ANCHORS or None in anchors or not anchors else Anchors(anchors)

    def hashes_of(forms: Column) -> Column:
        if not widths:
            return F.array().cast("array<struct<w:int,pos:int,h:bigint>>")
        if known is None:
            return F.flatten(F.array(*[form_hashes(forms, k, None) for k in widths]))
        # The literal words of every form are those of the plain one.
        return let(known.places(forms["plain"]), lambda p: F.flatten(F.array(*[form_hashes(forms, k, p) for k in widths])))
    hashes = let(all_forms(F.col("text")), hashes_of)
    near = base if known is None else base.where(known.stand_in(F.col("text")))
    # For an inner explode the optimizer adds tests of the array below it, each a copy of the whole expression; the join drops the rows of empty arrays.
    sent = near.select("key", F.explode_outer(hashes).alias("x")).select("key", "x.*")
    small = windows.count() <= MAX_BROADCAST_WINDOWS
    hits = sent.join(F.broadcast(windows) if small else windows, ["w", "h"])
    aligned = saved(hits.groupBy("key", "item_id", "w", (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.collect_set("ipos").alias("at")))
    texts = base.join(aligned.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    texts = texts.select("key", "doc_id", words(spaced(F.col("text"))).alias("raw"), all_forms(F.col("text")).alias("doc"))
    a = aligned.join(texts, "key").join(items.drop("w"), "item_id")
    covered = F.array_distinct(F.flatten(F.transform(F.col("at"), lambda p: F.sequence(p, p + F.col("w") - 1))))
    a = a.withColumn("covered", F.filter(covered, lambda i: F.greatest(*[
        F.get(F.col(f"doc.{k}"), i + F.col("offset")) == F.get(F.col(f"item.{k}"), i) for k in FORMS])))
    bare = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    slots = F.array_distinct(F.transform(F.filter(F.col("covered"), lambda i: is_slot(F.get(F.col("item.canon"), i))), lambda i: F.struct(
        F.get(F.col("item.canon"), i).alias("kind"), bare(F.get(F.col("item_raw"), i)).alias("old"), bare(F.get(F.col("raw"), i + F.col("offset"))).alias("new"))))
    a = a.withColumn("slots", slots).withColumn("item_words", F.size("item_raw")).withColumn("n_words", F.size("covered"))
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["old"])))) == F.size("slots")
    return (a.where(consistent & (F.col("n_words") >= F.when(F.col("item_words") < MIN_ITEM_WORDS, F.col("item_words")).otherwise(F.least(F.col("item_words") - 1, F.lit(min_words)))))
            .groupBy("key", "doc_id", "item_id", "item_words")
            .agg(F.max(F.struct("n_words", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda s: s["old"] != s["new"])).alias("n_changed"))).alias("best"))
            .select("key", "doc_id", "item_id", F.col("best.n_words").cast("long").alias("n_words"), F.col("item_words").cast("long").alias("item_words"),
                    F.col("best.n_slots").cast("long").alias("n_slots"), F.col("best.n_changed").cast("long").alias("n_changed")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    key = free_name(docs, "__key")
    bad = contaminated(docs, benchmark, text=text, doc_id=doc_id, **options).select(F.col("key").alias(key)).distinct()
    return docs.join(bad, F.xxhash64(F.col(doc_id), F.col(text)) == F.col(key), "left_anti")
