"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, each a token of its own, so
a question keeps its template when its parameters change. Hashes of windows of
``WINDOW`` template tokens are joined with those of the benchmark; hits of one
document and item on one diagonal are counted, and the slots they cover must be
consistent: equal values in the item stand for equal values in the document;
different ones may happen to get the same. What stands word for word needs no
consistency: ``VERBATIM_SHARE`` of the item's windows with their values are
enough. Items that placeholders leave too few windows of, short ones and those
dense with numbers and names, are searched for word for word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_side, table, text_or_empty

WINDOW = 8
#: A document holds an item if so many windows of a diagonal hit (13 tokens in a row), or all that the item has.
LEAST_HITS = 6
#: Windows with more placeholders than this say too little for a template.
MOST_SLOTS = WINDOW // 2
#: An item that loses windows to ``MOST_SLOTS`` and keeps fewer than this is searched for word for word.
LEAST_WINDOWS = 3
#: Share of an item's windows that, with the same values, make a leak whatever the other slots say.
VERBATIM_SHARE = 0.75

#: Units of measure, as they follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ton tons ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw mw v kv a ma "
    "b kb mb gb tb usd eur gbp dollar dollars euro euros cent cents pound pounds percent degrees"
).split()
#: Closed-class words and openings of questions, no names though a sentence may start with them.
OPENERS = (
    "The An If When While What Which Who Whose Whom How Why Where Is Are Was Were Be Been Do Does Did Has Have Had Can Could Will Would Shall Should May Might Must Let "
    "He She It They We You His Her Its Their Our Your My Me Him Them Us This That These Those There Here Each Every Some Any All Both Either Neither No None Not Many Most Much More Few Several Other Another "
    "In On At By For From To Of Off With Without Within Into Onto Over Under Above Below Between Among Through During Before After Since Until Till About Against Along Across Around Behind Beside Near Per Than As "
    "And But Or Nor So Yet Then Thus Hence Also Only Just Once Again Now Today Finally First Second Third Next Last However Therefore Because Although Though Whether "
    "Find Solve Compute Calculate Determine Evaluate Simplify Prove Show Explain Describe Given Suppose Assume Consider Write Choose Select Add Question Answer"
).split()
SLOT = "\u0001"
_NAME = r"(?!(?:" + "|".join(OPENERS) + r")(?!\p{L}))\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: Capitalised words, a run of them as one name, wherever they stand. Groups repeat possessively: Java runs that as a loop, but a greedy group calls itself once a repetition, which overflows the stack on long runs.
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_NAME}(?:[ \t]{{1,2}}{_NAME})*+"
NUMBER = r"(?<![\p{L}\p{N}])\d+(?:[.,:/]\d+)*+"
#: A unit right behind a number's mark, with or without a blank in the text.
UNIT = rf"{SLOT}d {{1,2}}(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{N}])"
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#&$%@^~`_=+/\\-–—‘’“”…"
BLANKS = r"[\x20\x09-\x0D]+"
#: What a literal word loses at its ends; signs of arithmetic stay.
ENDS = r"^[.,;:!?\"'()\[\]{}‘’“”…]+|[.,;:!?\"'()\[\]{}‘’“”…]+$"


def _marked(text: Column) -> tuple[Column, Column, Column]:
    """``text`` with names, then numbers, then units as marks that stand apart."""
    named = F.regexp_replace(text, NAME, f" {SLOT}n ")
    numbered = F.regexp_replace(named, NUMBER, f" {SLOT}d ")
    return named, numbered, F.regexp_replace(numbered, UNIT, f"{SLOT}d {SLOT}u ")


def _words(marked: Column) -> Column:
    return F.filter(F.split(F.translate(F.lower(marked), PUNCTUATION, ""), BLANKS), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Template tokens of ``text``: placeholders (a mark and ``n``, ``d`` or ``u``), or lower-case words without punctuation."""
    return _words(_marked(text)[2])


def slots(text: Column) -> Column:
    """``array<struct<at, kind, value>>``: the placeholders of ``tokens(text)`` with what they stand for, whole."""
    named, numbered, done = _marked(text)
    values = {"n": F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), "d": F.regexp_extract_all(named, F.lit(NUMBER), F.lit(0)), "u": F.regexp_extract_all(numbered, F.lit(UNIT), F.lit(1))}

    def of(kind: str, toks: Column) -> Column:
        at = F.filter(F.transform(toks, lambda w, i: F.when(w == SLOT + kind, i)), lambda x: x.isNotNull())
        clean = lambda v: F.lower(F.regexp_replace(v, BLANKS, " "))
        return F.zip_with(at, values[kind], lambda x, v: F.struct(x.alias("at"), F.lit(kind).alias("kind"), clean(v).alias("value")))

    return _let(_words(done), lambda toks: F.concat(*(of(kind, toks) for kind in values)))


def literals(text: Column) -> Column:
    """Lower-case words of ``text`` with their numbers and signs."""
    return F.filter(F.transform(F.split(F.lower(text), BLANKS), lambda w: F.regexp_replace(w, ENDS, "")), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def window_hashes(toks: Column, size: int = WINDOW) -> Column:
    """Hash of each run of ``size`` tokens; none if there are fewer."""

    def of(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, size)))
        return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(toks, lambda w: F.xxhash64(w)), of)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """``item_id, ipos, h, n_windows`` of each item's windows that hold enough literal tokens.

    Items of fewer than ``WINDOW`` tokens have none, nor have those that keep
    fewer than ``LEAST_WINDOWS`` of more.
    """
    t = items.select("item_id", tokens(text_or_empty()).alias("t")).select("item_id", "t", F.posexplode(window_hashes(F.col("t"))).alias("ipos", "h"))
    held = F.size(F.filter(F.slice("t", F.col("ipos") + 1, WINDOW), lambda w: w.startswith(SLOT)))
    each = t.select("item_id", "ipos", "h", (held <= MOST_SLOTS).alias("says")).distinct()
    per = each.groupBy("item_id").agg(F.count_distinct(F.when(F.col("says"), F.col("ipos"))).alias("n_windows"), F.count_distinct("ipos").alias("n"))
    per = per.where((F.col("n_windows") == F.col("n")) | (F.col("n_windows") >= LEAST_WINDOWS)).select("item_id", "n_windows")
    return each.where("says").select("item_id", "ipos", "h").join(per, "item_id")


def find_literal(base: DataFrame, items: DataFrame) -> DataFrame | None:
    """``doc_id, item_id`` of documents that hold an item of ``items`` word for word; None if these have no words.

    The first words of an item, ``WINDOW`` at most, are looked up; what they hit is compared in full.
    """
    sought = items.select("item_id", literals(text_or_empty()).alias("words")).where(F.size("words") > 0).distinct()
    sought = materialize(sought.withColumn("first", F.least(F.size("words"), F.lit(WINDOW))), "leak-literal")
    sizes = sorted(r["first"] for r in sought.select("first").distinct().collect())
    if not sizes:
        return None

    def struct(size: int) -> Callable[[Column, Column], Column]:
        return lambda h, i: F.struct(F.lit(size).alias("first"), i.alias("pos"), h.alias("h"))

    n_sought = sought.count()
    heads = sought.select("item_id", "words", "first", F.xxhash64(F.transform(F.slice("words", 1, WINDOW), lambda w: F.xxhash64(w))).alias("h"))
    each = _let(literals(F.col("text")), lambda w: F.concat(*[F.transform(window_hashes(w, size), struct(size)) for size in sizes]))
    windows = base.select("doc_id", F.explode(each).alias("w")).select("doc_id", "w.*")
    whole = heads.select("item_id", "first", "h", (F.size("words") == F.col("first")).alias("whole"))
    # a head that is the whole item is looked at once a document, a longer item wherever its head stands
    hits = windows.join(small_side(whole, n_sought), ["first", "h"]).groupBy("doc_id", "item_id", F.when(~F.col("whole"), F.col("pos")).alias("at")).agg(F.min("pos").alias("pos"))
    hits = materialize(hits.select("doc_id", "item_id", "pos"), "leak-heads")
    docs = base.join(small_side(hits.select("doc_id").distinct(), hits.count()), "doc_id", "left_semi").select("doc_id", literals(F.col("text")).alias("held")).distinct()
    both = hits.join(docs, "doc_id").join(small_side(heads.select("item_id", "words"), n_sought), "item_id")
    return both.where(F.slice("held", F.col("pos") + 1, F.size("words")) == F.col("words")).select("doc_id", "item_id").distinct()


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: ``doc_id, item_id, n_hits, n_windows, n_slots, n_changed, contaminated``.

    ``n_changed`` counts slots whose value differs from the item's: over 0 means
    re-parameterised. Pairs whose slots are inconsistent are left out, unless
    no value changed or ``VERBATIM_SHARE`` of the item's windows stand there
    with their values. Items found word for word for want of windows count as
    one hit of one window. Null texts and null ids hold nothing; rows that
    repeat count once; texts of any length go through as one row each; extra
    columns are not read, whatever their names; an empty table on either side
    gives no rows. A benchmark of up to ``common.BROADCAST_ROWS`` windows is
    broadcast, a larger one is joined by shuffle.
    """
    items = items.where("item_id is not null").select("item_id", "text")
    bench = materialize(benchmark_windows(items), "leak-windows")
    n_bench = bench.count()
    base = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    windows = base.select("doc_id", F.posexplode(window_hashes(tokens(F.col("text")))).alias("pos", "h"))
    hits = windows.join(small_side(bench, n_bench), "h").select("doc_id", "item_id", "n_windows", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"))
    keys = ["doc_id", "item_id", "shift"]
    # of a diagonal, the windows of one item: as many as the item has, whatever the document's length
    found = hits.groupBy(*keys).agg(F.collect_set("ipos").alias("at"), F.max("n_windows").alias("n_windows")).withColumn("n_hits", F.size("at").cast("long"))
    found = materialize(found.where(F.col("n_hits") >= F.least(F.lit(LEAST_HITS), F.col("n_windows"))), "leak-hits")
    n_found = found.count()

    held = base.join(small_side(found.select("doc_id").distinct(), n_found), "doc_id", "left_semi")
    held = held.select("doc_id", F.explode(slots(F.col("text"))).alias("s")).select("doc_id", F.col("s.at").alias("dat"), F.col("s.kind").alias("kind"), F.col("s.value").alias("dval"))
    sought = items.select("item_id", F.explode(slots(text_or_empty())).alias("s")).select("item_id", "s.*").distinct()
    inside = F.exists("at", lambda p: (F.col("sat") >= p) & (F.col("sat") < p + WINDOW))
    asked = found.join(sought.withColumnRenamed("at", "sat"), "item_id").where(inside)
    asked = asked.select(*keys, "sat", "kind", F.col("value").alias("ival"), (F.col("sat") + F.col("shift")).alias("dat"))
    pairs = asked.join(held, ["doc_id", "dat", "kind"]).distinct()
    # a capitalised neighbour joins a name at the item's ends
    part = (F.col("kind") == "n") & (F.col("dval").endswith(F.concat(F.lit(" "), "ival")) | F.col("dval").startswith(F.concat("ival", F.lit(" "))))
    pairs = pairs.withColumn("dval", F.when(part, F.col("ival")).otherwise(F.col("dval")))
    values = pairs.groupBy(*keys, "kind", "ival").agg(F.count_distinct("dval").alias("k"), F.count("*").alias("n"), F.collect_set(F.when(F.col("ival") != F.col("dval"), F.col("sat"))).alias("changed"))
    per = values.groupBy(*keys).agg(F.max("k").alias("forth"), F.sum("n").alias("n_slots"), F.flatten(F.collect_list("changed")).alias("changed"))
    zero = F.lit(0).cast("long")
    out = found.join(per, keys, "left").withColumn("changed", F.coalesce("changed", F.array().cast("array<int>")))
    same = F.size(F.filter("at", lambda p: ~F.exists("changed", lambda c: (c >= p) & (c < p + WINDOW))))
    out = out.where((F.coalesce("forth", zero) <= 1) | (F.size("changed") == 0) | (same >= VERBATIM_SHARE * F.col("n_windows")))
    out = out.select("doc_id", "item_id", "n_hits", "n_windows", F.coalesce("n_slots", zero).alias("n_slots"), F.size("changed").cast("long").alias("n_changed"))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_hits", "n_windows", "n_slots", (-F.col("n_changed")).alias("c"))).alias("b"))
    best = best.select("doc_id", "item_id", "b.n_hits", "b.n_windows", "b.n_slots", (-F.col("b.c")).alias("n_changed"), F.lit(True).alias("contaminated"))
    literal = find_literal(base, items.join(bench.select("item_id").distinct(), "item_id", "left_anti"))
    if literal is None:
        return best
    one = F.lit(1).cast("long")
    return best.unionByName(literal.select("doc_id", "item_id", one.alias("n_hits"), one.alias("n_windows"), zero.alias("n_slots"), zero.alias("n_changed"), F.lit(True).alias("contaminated")))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item, columns as given. Rows with a null doc_id stay."""
    gone = materialize(find_leaks(docs, items).select("doc_id").distinct(), "leak-gone")
    left = docs.join(small_side(gone, gone.count()), "doc_id", "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
