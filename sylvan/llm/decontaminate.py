"""Benchmark decontamination by template canonicalisation (native: DataFrame functions only).

Texts become templates: numbers, names (capitalised words inside a sentence) and units after numbers turn into typed
placeholders, the rest is lower-cased and stripped of punctuation.  Windows of five template words are hash-joined with
the benchmark's.  A document holds an item when ``share`` of the item's windows are found in it and the values behind
the placeholders are consistent: along some alignment each value of the item goes with one value of the document,
so a question with other numbers or names still counts, and a chance template does not.  A slot's place in the document
comes from a matching window that covers it; slots without one say nothing.

Names are known by their capital, so text in capitals has none.  Items are therefore indexed with and without the name
placeholders, and texts with a run of CAPITALS words in capitals are also looked up without; if an item has such a run,
all texts are.  An item of fewer than five template words, too short to be told from prose, is held by a text of which a
line has exactly its words.

Scale: the documents' windows are exploded lazily, filtered by the join at once and pre-aggregated; the benchmark's
windows are broadcast only after their number has been counted and is under ``most_broadcast``, else both sides are
shuffled and AQE splits hot windows.  Documents are identified by a digest of their text, since the verdict is a
function of the text: one shuffle of whole rows brings the verdicts back.

Edge cases: null and blank texts hold nothing, and blank items are held by none; repeated
documents and ids each get their text's verdict; equal items are each reported; empty tables give clean documents or no
rows; the documents' other columns never clash, because rows travel inside one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, let, read, words, written

WINDOW, SHARE, SLACK, CAPITALS = 5, 0.8, 0.2, 5
MOST_BROADCAST = 1_000_000
#: Placeholders: control characters, which are no white space and which the canonical form keeps.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec second seconds min minute minutes h hour hours day days week "
    "weeks month months year years mph kph kmh hz w kw wh kwh v a usd eur gbp dollar dollars euro euros cent cents "
    "percent meter meters metre metres inch inches foot feet mile miles gram grams kilogram kilograms liter liters"
).split()


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}\x01-\x03{WS}]+", "")


def clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x03]", " ")


def template(text: Column, names: bool = True) -> Column:
    """Array of template words; without ``names`` these stay words."""
    t = clean(text)
    if names:
        t = F.regexp_replace(t, rf"\p{{Lu}}(?<=[^.!?:{WS}][{WS}]\p{{Lu}})\p{{Ll}}\p{{L}}*", NAME)
    t = F.regexp_replace(t, r"[0-9](?:[0-9.,:/]*[0-9])?", NUMBER)
    t = F.regexp_replace(F.lower(t), rf"(?<=\x02[{WS}]|\x02)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    return words(stripped(t))


def values(text: Column) -> Column:
    """Array of the words behind the template's, position by position."""
    return words(stripped(F.lower(clean(text))))


def window_hashes(template_words: Column) -> Column:
    def hashes(ws: Column) -> Column:
        n = F.size(ws) - WINDOW + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(ws, i, WINDOW))))

    return let(template_words, hashes)


def in_capitals(text: Column) -> Column:
    """Whether so many words in capitals follow each other, numbers and signs aside."""
    return F.coalesce(text.rlike(rf"\p{{Lu}}{{2}}\p{{Lu}}*(?:[^\p{{L}}]+\p{{Lu}}+){{{CAPITALS - 1}}}(?!\p{{Ll}})"), F.lit(False))


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item windows: hash, item, at; items: item, n_windows, slots; the table both come from), each written once."""
    text = F.col("text")
    items = benchmark.select(
        F.col("item_id").alias("item"), template(text).alias("t"), values(text).alias("v"),
        window_hashes(template(text, False)).alias("blind"), in_capitals(text).alias("capitals"),
    )
    whole = written(items.select("*", window_hashes(F.col("t")).alias("hashes")), "bench-templates")
    items = whole.filter("hashes is not null")
    aligned = F.size("t") == F.size("v")
    slots = F.filter(
        F.transform("t", lambda w, i: F.struct(i.alias("at"), F.when(aligned, F.get("v", i)).alias("value"), w.alias("w"))),
        lambda s: s["w"].rlike(r"[\x01-\x03]") & s["value"].isNotNull(),
    )
    items = written(items.select("item", "hashes", "blind", F.transform(slots, lambda s: s.dropFields("w")).alias("slots")), "bench-items")
    windows = items.select("item", F.posexplode("hashes").alias("at", "hash")).union(
        items.select("item", F.posexplode("blind").alias("at", "hash"))
    )
    windows = written(windows.distinct(), "bench-windows")
    return windows, items.select("item", "slots", F.size("hashes").alias("n_windows")), whole


def whole_lines(docs: DataFrame, short: DataFrame, digest: Column) -> DataFrame:
    """(digest, lines: items of which a line of the text has exactly the words). ``short`` is item, v."""
    items = short.select("item", F.xxhash64("v").alias("hash"), F.col("v").alias("own"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(rf"[^{WS}]"))
    lines = docs.select(digest, F.explode(F.array_distinct(F.transform(lines, values))).alias("v"))
    found = lines.join(items, F.xxhash64("v") == items["hash"]).filter(F.col("v") == F.col("own"))
    return written(found.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("lines")).select("digest", "lines"), "leaks-lines")


def covered(slots: Column, hits: Column) -> Column:
    """The slots that a matching window covers, each with the shifts at which one does."""

    def shifts(at: Column) -> Column:
        near = F.filter(hits, lambda h: (h["at"] <= at) & (h["at"] > at - WINDOW))
        return F.array_distinct(F.transform(near, lambda h: h["shift"]))

    found = F.transform(slots, lambda s: F.struct(s["at"], s["value"], shifts(s["at"]).alias("shifts")))
    return F.filter(found, lambda s: F.size(s["shifts"]) > 0)


def consistent(held: Column, ws: Column) -> Column:
    """Whether some alignment's slots map the item's values to one document value each, but for a few.

    An alignment follows one shift; a slot that no window matched there takes the nearest shift of one that covers it, so
    words put in or left out move the slots behind them, and a passage elsewhere does not disturb.
    """

    def agrees(lead: Column) -> Column:
        def own(s: Column) -> Column:
            near = F.array_min(F.transform(s["shifts"], lambda x: F.struct(F.abs(x - lead).alias("far"), x.alias("shift"))))
            return F.get(ws, s["at"] + near["shift"])

        pairs = F.transform(held["slots"], lambda s: F.struct(s["value"], own(s).alias("own")))
        pairs = F.filter(pairs, lambda p: p["own"].isNotNull())
        surplus = lambda ps: F.size(F.array_distinct(ps)) - F.size(F.array_distinct(F.transform(ps, lambda p: p["value"])))
        return let(pairs, surplus) <= F.floor(SLACK * held["n_slots"])

    return F.exists(held["leads"], agrees)


def text_windows(docs: DataFrame, names: bool = True) -> DataFrame:
    """(digest, pos, hash) of every window of every text; one row of nulls for a text without any.

    The explode is an outer one, because Spark adds a filter on the size of the array below an inner one, which works the
    templates out a second time.
    """
    digest = F.md5(F.encode(F.col("text"), "UTF-8")).alias("digest")
    found = docs.select(digest, window_hashes(template(F.col("text"), names)).alias("h"))
    return found.select("digest", F.posexplode_outer("h").alias("pos", "hash"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc (struct of the row), items (sorted ids of the items it holds, empty if clean): one row per input row."""
    windows, items, whole = benchmark_windows(benchmark)
    short = whole.filter("hashes is null and size(v) > 0").select("item", "v")
    small = windows.count() <= most_broadcast
    digest = F.md5(F.encode(F.col("text"), "UTF-8")).alias("digest")
    blind = docs if not whole.filter("capitals").isEmpty() else docs.filter(in_capitals(F.col("text")))
    spread = text_windows(docs).union(text_windows(blind, False))
    hits = spread.join(F.broadcast(windows) if small else windows, "hash")
    # every place where a window of the item was found, as a set: copies of a text fall together in each task
    hit = F.struct("at", (F.col("pos") - F.col("at")).alias("shift"))
    held = hits.groupBy("digest", "item").agg(F.collect_set(hit).alias("hits"))
    found = F.size(F.array_distinct(F.transform("hits", lambda h: h["at"])))
    held = held.join(items, "item").filter(found >= share * F.col("n_windows"))
    leads = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["shift"])))
    one = F.struct("item", covered(F.col("slots"), F.col("hits")).alias("slots"), F.size("slots").alias("n_slots"), leads.alias("leads"))
    held = held.groupBy("digest").agg(F.sort_array(F.collect_list(one)).alias("held"))
    held = written(held, "leaks")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    out = docs.select(row, digest).join(held, "digest", "left")
    ws = F.when(F.col("held").isNotNull(), values(F.col("doc.text")))
    good = let(ws, lambda own: F.filter(F.col("held"), lambda h: consistent(h, own)))
    none = F.array().cast("array<bigint>")
    ids = F.coalesce(F.transform(good, lambda h: h["item"]), none)
    if not short.isEmpty():
        out = out.join(whole_lines(docs, short, digest), "digest", "left")
        ids = F.array_sort(F.concat(ids, F.coalesce("lines", none)))
    return out.select("doc", ids.alias("items"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    return find_leaks(docs, benchmark).filter(F.size("items") == 0).select("doc.*")


def op7_decontamination(spark, sf_dir):
    """For every document: whether it holds benchmark items, how many and which."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read(spark, sf_dir, "benchmark"))
    n = F.size("items")
    return found.select("doc.doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"), "items")
