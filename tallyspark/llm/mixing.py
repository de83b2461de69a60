"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. Each source has a target number of words; the mix takes all
documents of the source for every complete epoch in the target, and fills the
rest by weighted sampling without replacement: a document's key is an
exponential draw divided by its quality weight (-ln(u) / w, small keys win),
documents are ordered by key within their source, and the prefix of that order
whose words come nearest to the budget is taken.

A source may hold most of all rows, so no source is ever sorted as a whole:
keys fall into fixed-width classes of their (roughly uniform) rank, word counts
per (source, class) show in which class the budget ends, and only the rows of
that class are ordered. The result is one cut per source, applied row by row;
texts are never shuffled.

Draws are md5 bits of (seed, doc_id), so reruns and retries agree.

Defined cases. Null or blank text: size 0, taken 0. Null source: a source of its
own, last. Null doc_id: all such rows share one draw. Rows of one (source, draw,
doc_id) are taken or left together. Empty table: no rows. Input columns named like
an added one give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.text import count_chars, count_words, free_name, saved, without

MAX_EPOCHS = 3
CLASSES = 1024
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column, size: Column) -> Column:
    """1 for text without symbol characters, less the more of them there are per word."""
    symbols = count_chars(F.coalesce(text, F.lit("")), SYMBOLS)
    return F.lit(1.0) / (F.lit(1.0) + symbols.cast("double") / F.greatest(size, F.lit(1)).cast("double"))


def draw_key(doc_id: Column, weight: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / weight


def source_targets(totals: DataFrame, total_words: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets by source: (source, source_size) gains weight and target.

    Sources by code point weigh 1, 2, 3, 1, ... and share the sum of all sizes;
    a target stops at ``max_epochs`` times its source's size and the excess goes
    to the others by weight. Sources fill up in the order of size / weight, so
    the first one that is not full fixes the words per weight of all the rest.
    ``totals`` has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    t = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("long"))
    cap = (F.col("source_size") * max_epochs).alias("cap")
    t = t.withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = (t.withColumn("left_words", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("level", F.col("left_words").cast("double") / F.col("left_weight").cast("double"))
         .withColumn("is_open", F.col("cap").cast("double") >= F.col("weight").cast("double") * F.col("level")))
    level = F.min(F.when(F.col("is_open"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(whole)["level"]
    return (t.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight").cast("double") * level))
            .select("source", "source_size", "weight", "target"))


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = MAX_EPOCHS, text: str = "text",
        doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (times the mix takes the row) and ``taken`` (its words, copies counted)."""
    docs = without(docs, ["size", "source_size", "target", "copies", "taken"])
    spark = docs.sparkSession
    key = free_name(docs, "__key")
    sized = docs.withColumn("size", count_words(F.col(text)))
    keyed = sized.withColumn(key, draw_key(F.col(doc_id), quality_weight(F.col(text), F.col("size")), seed))
    # The slim table (no texts) is written once; all counting reads it.
    slim = saved(keyed.select(F.col(source).alias("source"), F.col(doc_id).cast("string").alias("id"),
                              F.col(key).alias("key"), F.col("size")))
    rank = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * CLASSES).cast("long").alias("class")
    hist = saved(slim.groupBy("source", rank).agg(F.sum("size").alias("words")))
    totals = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # One row per source.
    plan = saved(source_targets(totals, max_epochs=max_epochs).withColumn("epochs", epochs)
                 .withColumn("budget", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")))
    same = lambda a, b: a.eqNullSafe(b)
    h, p = hist.alias("h"), plan.alias("p")
    running = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    ends = (h.join(p, same(F.col("h.source"), F.col("p.source")))
            .select(F.col("h.source").alias("source"), "class", "words", "budget")
            .withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
            .where((F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("words")))
            .select("source", F.col("class").alias("end_class"), "before", "budget"))
    s, e = slim.withColumn("class", rank).alias("s"), ends.alias("e")
    last = (s.join(e, same(F.col("s.source"), F.col("e.source")) & (F.col("s.class") == F.col("e.end_class")))
            .groupBy(F.col("s.source").alias("source"), "key", F.coalesce(F.col("id"), F.lit("")).alias("id"))
            .agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("budget").alias("budget")))
    order = Window.partitionBy("source").orderBy("key", "id")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # The unit in which the budget ends is taken if that comes nearer to the budget.
    picked = (last.withColumn("upto", upto)
              .where(F.col("upto") - F.col("size") + F.col("size") / F.lit(2.0) <= F.col("budget"))
              .groupBy("source").agg(F.max(F.struct("key", "id")).alias("cut")))
    cuts = (plan.alias("p").join(ends.alias("e"), same(F.col("p.source"), F.col("e.source")), "left")
            .join(picked.alias("c"), same(F.col("p.source"), F.col("c.source")), "left")
            .select(F.col("p.source").alias("__source"), "source_size", "target", "epochs", "end_class", "cut"))
    cuts = saved(cuts)
    d = keyed.join(cuts, same(F.col(source), F.col("__source")), "left")
    mine = F.floor((F.lit(1.0) - F.exp(-F.col(key))) * CLASSES).cast("long")
    tie = F.struct(F.col(key).alias("key"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"))
    drawn = F.when(F.col("end_class").isNull(), F.lit(0)) \
        .when(mine < F.col("end_class"), 1) \
        .when((mine == F.col("end_class")) & F.col("cut").isNotNull() & (tie <= F.col("cut")), 1).otherwise(0)
    return (d.withColumn("copies", (F.col("epochs") + drawn).cast("long"))
            .withColumn("taken", F.col("size") * F.col("copies"))
            .select(*[F.col(f"`{c}`") for c in docs.columns], "size", "source_size", "target", "copies", "taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every row as many times as ``copies`` says."""
    return mixed.where("copies > 0").withColumn("__n", F.explode(F.expr("sequence(1L, copies)"))).select(*columns)
