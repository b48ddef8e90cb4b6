"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words inside a sentence) and units (after a number)
become typed placeholders.  As what is a name depends on case, windows are taken a
second time with names as lower-case words, so that a verbatim copy is found in any
case.  Every window of WINDOW canonical tokens is hashed and joined with the windows of the benchmark items; hits vote for a diagonal (text
position minus item position) and neighbouring diagonals are merged.  Where enough
of an item's windows are found, the slots are compared, each on the diagonal of a
window that covers it: each value of the item must stand for one value of the text
throughout, so a re-parameterised question counts and a text that merely shares the
wording does not.

Edge cases: null text counts as empty; an item with fewer than WINDOW tokens, or
without a window of MIN_LITERALS words, is never found; repeated rows give one row
per (id, item); rows and items without an id are matched and reported with a null id;
different texts under one item id are items of their own, and the best match of them
is reported; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fjordquant.llm.common import window_hashes
from fjordquant.session import materialise

WINDOW = 5
MIN_LITERALS = 2
COVERAGE = 0.8        # of an item's windows that must be found
CONSISTENCY = 0.9     # of the slot values that must map to one value
GAP = 3
BROADCAST_WINDOWS = 2_000_000  # benchmark windows sent to all tasks (48 MB); beyond, a shuffle join
BROADCAST_KEYS = 1_000_000     # text keys sent to all tasks (8 MB)

# Units of measure.
UNITS = """
kg g mg km m cm mm mi ft in lb lbs oz l ml s sec second seconds min minute minutes h hour hours day days week
weeks month months year years percent dollar dollars euro euros cent cents usd eur meter meters metre metres
kilometer kilometers kilogram kilograms gram grams liter liters litre litres mile miles foot feet inch inches
pound pounds ounce ounces degree degrees
""".split()
NAME_MARK = "\u0002"


def tokens_of(text: Column) -> Column:
    """Lower-case tokens; a name begins with NAME_MARK, a number with a digit."""
    body = F.coalesce(text, F.lit(""))
    body = F.regexp_replace(body, "[\u0002\\s\\p{Z}]+", " ")
    body = F.regexp_replace(body, "(\\d)[.,:/](?=\\d)", "$1")
    body = F.regexp_replace(body, "(\\d)(?=[A-Za-z])", "$1 ")
    body = F.regexp_replace(body, "(?<=[\\p{Ll},;] )(?=\\p{Lu})", NAME_MARK)
    return F.array_remove(F.split(F.lower(body), "[^\\p{L}\\p{N}\u0002]+"), "")


def unmarked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.replace(t, F.lit(NAME_MARK), F.lit("")))


def kinds(tokens: Column) -> Column:
    """1 for a number, 2 for a name, 3 for a unit, 0 for a word."""
    def number(t: Column) -> Column:
        return (t >= "0") & (t < ":")

    return F.transform(tokens, lambda t, i: F.when(number(t), 1).when(t < "\u0003", 2).when(
        t.isin(UNITS) & F.coalesce(number(F.get(tokens, i - 1)), F.lit(False)), 3).otherwise(0))


def canonical(tokens: Column, kind: Column) -> Column:
    """A hash per token; placeholders hash by their kind alone."""
    return F.zip_with(tokens, kind, lambda t, k: F.when(k == 0, F.xxhash64(t)).otherwise(
        F.xxhash64(k)))


def windows_of(df: DataFrame, text: str) -> DataFrame:
    """Attach _tokens (without marks), _kinds, _windows, and _blind: windows without names."""
    out = df.withColumn("_marked", tokens_of(F.col(text)))
    out = out.withColumn("_tokens", unmarked(F.col("_marked")))
    for tokens, kind, windows in (("_marked", "_kinds", "_windows"), ("_tokens", "_plain", "_blind")):
        out = out.withColumn(kind, kinds(F.col(tokens)))
        out = out.withColumn("_hashes", canonical(F.col(tokens), F.col(kind)))
        out = out.withColumn(windows, window_hashes(F.col("_hashes"), WINDOW))
    return out.drop("_hashes", "_marked", "_plain")


def both_forms() -> Column:
    """(at, hash) of all windows, and of those without names where they differ."""
    numbered = [F.transform(c, lambda h, i: F.struct(i.alias("at"), h.alias("hash")))
                for c in ("_windows", "_blind")]
    other = F.filter(numbered[1], lambda w: w["hash"] != F.get("_windows", w["at"]))
    return F.concat(numbered[0], other)


def enough_words(kind: Column, at: Column) -> Column:
    return F.size(F.filter(F.slice(kind, at + 1, WINDOW), lambda k: k == 0)) >= MIN_LITERALS


def paired_slots(slots: Column, parts: Column, tokens: Column) -> Column:
    """(a, b, judged) per slot: the item's value and that of the text.

    ``parts`` are the (diagonal, found) of a run.  A slot is read on the diagonal of
    the nearest window found.  It is judged if it lies in that window, or in none that
    could be found at all; what lies only in windows that are missing tells nothing.
    """
    hits = F.flatten(F.transform(parts, lambda p: F.transform(p["found"], lambda at: F.struct(
        at.alias("at"), p["diagonal"].alias("diagonal"), F.size(p["found"]).alias("support")))))

    def one(s: Column) -> Column:
        near = F.array_min(F.transform(hits, lambda h: F.struct(
            F.greatest(h["at"] - s["at"], s["at"] - h["at"] - WINDOW + 1, F.lit(0)).alias("gap"),
            (-h["support"]).alias("support"), h["diagonal"].alias("diagonal"))))
        return F.struct(
            s["value"].alias("a"),
            F.get(tokens, (s["at"] + near["diagonal"]).cast("int")).alias("b"),
            ((near["gap"] == 0) | ~s["findable"]).alias("judged"))

    return F.transform(slots, one)


def item_windows(items: DataFrame) -> DataFrame:
    """(item, hash, at, n): windows with enough words, and how many an item has."""
    flat = items.select("item", "_kinds", F.explode(both_forms()).alias("w")).where(
        enough_words(F.col("_kinds"), F.col("w.at")))
    flat = flat.select("item", "w.hash", "w.at")
    n = flat.groupBy("item").agg(F.count_distinct("at").alias("n"))
    return flat.join(n, "item").select("item", "hash", "at", "n")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked to be sent to all tasks if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def matches(docs: DataFrame, text: str, benchmark: DataFrame, item_text: str) -> DataFrame:
    """(text_key, item, coverage, consistency, verbatim) of contaminated texts.

    ``text_key`` and ``item`` are xxhash64 of the texts; equal texts share one row.
    """
    wording = F.coalesce(F.col(item_text), F.lit(""))
    items = materialise(windows_of(
        benchmark.select(F.xxhash64(wording).alias("item"), wording.alias("text"))
        .dropDuplicates(["item"]), "text").drop("text"))
    lookup = materialise(item_windows(items))
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("text_key"), body.alias("text"))
    # outer: an inner explode would have the planner repeat the whole expression as a filter
    flat = windows_of(texts, "text").select(
        "text_key", F.explode_outer(both_forms()).alias("w")).select(
        "text_key", F.col("w.at").alias("pos"), "w.hash")
    hits = flat.join(small(lookup, BROADCAST_WINDOWS), "hash").groupBy(
        "text_key", "item", "n", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("found"))
    hits = materialise(hits)
    order = Window.partitionBy("text_key", "item").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(True))
    run = F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = (
        hits.withColumn("run", run).groupBy("text_key", "item", "n", "run")
        .agg(F.size(F.array_distinct(F.flatten(F.array_agg("found")))).alias("covered"),
             F.array_agg(F.struct("diagonal", "found")).alias("parts"))
        .withColumn("coverage", F.col("covered") / F.col("n"))
        .where(F.col("coverage") >= COVERAGE)
        .select("text_key", "item", "coverage", "parts"))
    best = materialise(best)
    wanted = small(best.select("text_key").distinct(), BROADCAST_KEYS)
    fetched = texts.join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"]).withColumn(
        "doc_tokens", unmarked(tokens_of(F.col("text")))).drop("text")
    findable = F.filter(F.transform("_windows", lambda h, i: i),
                        lambda at: enough_words(F.col("_kinds"), at))
    slots = items.withColumn("_findable", findable).select("item", F.filter(
        F.transform("_tokens", lambda t, i: F.struct(
            t.alias("value"), i.alias("at"), F.get("_kinds", i).alias("kind"),
            F.exists("_findable", lambda at: (at <= i) & (i < at + WINDOW)).alias("findable"))),
        lambda s: s["kind"] > 0).alias("slots"))
    paired = best.join(fetched, "text_key").join(slots, "item").withColumn(
        "pairs", paired_slots(F.col("slots"), F.col("parts"), F.col("doc_tokens")))
    paired = paired.withColumn("judged", F.array_distinct(F.filter("pairs", lambda p: p["judged"])))
    values = F.size(F.array_distinct(F.transform("judged", lambda p: p["a"])))
    consistency = F.when(F.size("judged") == 0, 1.0).otherwise(values / F.size("judged"))
    return (
        paired.withColumn("consistency", consistency)
        .withColumn("verbatim", F.forall("pairs", lambda p: F.coalesce(p["a"] == p["b"], F.lit(False))))
        .where(F.col("consistency") >= CONSISTENCY)
        .groupBy("text_key", "item").agg(
            F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"),
            F.max("verbatim").alias("verbatim")))


def report(docs: DataFrame, doc_id: str, text: str, benchmark: DataFrame, item_id: str,
           item_text: str) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, verbatim): one row per leak."""
    named = benchmark.select(F.col(item_id).alias("item_id"), F.xxhash64(
        F.coalesce(F.col(item_text), F.lit(""))).alias("item")).distinct()
    found = materialise(
        matches(docs, text, benchmark, item_text).join(named, "item").groupBy("text_key", "item_id")
        .agg(F.max("coverage").alias("coverage"), F.max("consistency").alias("consistency"),
             F.max("verbatim").alias("verbatim")))
    ids = docs.select(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    return ids.join(small(found, BROADCAST_KEYS), "text_key").select(
        doc_id, F.col("item_id").alias(item_id), "coverage", "consistency", "verbatim").distinct()


def clean(docs: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str
          ) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    found = materialise(matches(docs, text, benchmark, item_text).select("text_key").distinct())
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.join(small(found, BROADCAST_KEYS), key == F.col("text_key"), "left_anti")
