"""Benchmark passages in documents, by SimHash of item-sized windows.

All steps are DataFrame operations.

1. Probes: a window with similarity t to an item of N shingles lacks at most
   N * (1 - t) of them, so one of any floor(N * (1 - t)) + 1 is in the window.
   So many shingles of each item, evenly spread, are looked up in all documents.
2. Every window of the item's size that holds enough probes is a candidate,
   wherever in the item they are from; in the candidates all shingles of the items
   are looked up, and the windows that hold enough of these are kept.  "Enough" is
   what no window of similarity t can fall below.  At the ends of a text windows
   are cut short.
3. Windows and items get a SimHash of 63 bits from their counted shingles.
   Split into 21 blocks of 3 bits, two fingerprints within distance 20 agree on
   a whole block, so a join on (item size, block, value) finds all of them.
4. The counted shingles of window and item give the exact similarity
   sum(min) / sum(max).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import saved
from parley.session import attach

SHINGLE = 5
THRESHOLD = 0.8
BITS = 63
BLOCKS = 21
WIDTH = BITS // BLOCKS
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text: Column) -> Column:
    """Lower-case words; a blank text gives one empty word, too short to match."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE)), r"[\x20\x09-\x0D]+")


def shingles_of(words: Column, start: Column, stop: Column, size: int) -> Column:
    """Hashes of the shingles that begin at words start .. stop - 1 (from 0)."""
    at = F.sequence(start, stop - 1)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(size))))
    return F.when(stop > start, hashes).otherwise(F.array().cast("array<bigint>"))


def simhash(counted: DataFrame, *keys: str) -> DataFrame:
    """One fingerprint per key from rows (key, shingle, weight)."""
    signed = [F.sum(F.when(F.col("shingle").bitwiseAND(1 << b) != 0, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(BITS)]
    sums = counted.groupBy(*keys).agg(F.sum("weight").alias("total"), *signed)
    print_ = F.lit(0).cast("bigint")
    for b in range(BITS):
        print_ = print_.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint"))
    return sums.select(*keys, "total", print_.alias("fingerprint"))


def _blocks(fingerprint: Column) -> Column:
    mask = (1 << WIDTH) - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda b: F.struct(b.alias("block"), F.call_function("shiftright", fingerprint, b * WIDTH).bitwiseAND(mask).alias("value")),
    )


def _windows(places: Column, last: Column, item: Column, looked_up: Column, threshold: float) -> Column:
    """(start, stop) of the windows that hold enough of ``places``, in shingles.

    places: where the text has one of the ``looked_up`` shingles of items of
    ``item`` shingles, in order; last: the number of shingles of the text.  A
    window of T shingles and similarity t shares at least t * (T + item) / (1 + t)
    with the item, and so it lacks no more than the rest of ``looked_up``.
    """
    enough = lambda size: F.greatest(
        looked_up - item + F.ceil((size + item) * threshold / (1 + threshold) - 1e-6).cast("int"), F.lit(1)
    )
    pair = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    # uncut: from place i to place i + enough - 1 is not more than a window; no start is given twice
    full = enough(item)
    reach = F.transform(
        F.slice(places, 1, F.greatest(F.size(places) - full + 1, F.lit(0))),
        lambda at, i: F.struct(
            F.greatest(F.element_at(places, i + full) - item + 1, F.when(i > 0, F.element_at(places, F.greatest(i, F.lit(1))) + 1).otherwise(0), F.lit(0)).alias("low"),
            F.least(at, last - item).alias("high"),
        ),
    )
    starts = F.flatten(F.transform(F.filter(reach, lambda r: r["low"] <= r["high"]), lambda r: F.sequence(r["low"], r["high"])))
    uncut = F.transform(starts, lambda s: pair(s, s + item))
    # cut: they begin before the text or end after it
    miss = F.floor(item * (1 - threshold) + 1e-6).cast("int")
    after = F.greatest(last - item + 1, F.lit(0))
    outside = F.concat(
        F.when(miss > 0, F.sequence(-miss, F.lit(-1))).otherwise(F.array().cast("array<int>")),
        F.when(last - item + miss >= after, F.sequence(after, last - item + miss)).otherwise(F.array().cast("array<int>")),
    )
    edges = F.array_distinct(F.transform(outside, lambda s: pair(F.greatest(s, F.lit(0)), F.least(s + item, last))))
    ends = F.filter(places, lambda at: (at < item) | (at >= last - item))
    held = lambda w: F.size(F.filter(ends, lambda at: (at >= w["start"]) & (at < w["stop"])))
    cut = F.filter(edges, lambda w: (w["stop"] > w["start"]) & (held(w) >= enough(w["stop"] - w["start"])))
    return F.concat(uncut, cut)


def find_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each
    document for each benchmark item that it contains.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored.
    Letters are compared in lower case.  Null, blank and very short texts (less
    than ``shingle`` words) contain nothing and are contained in nothing.  Rows
    without a key are left out; repeated rows count once.  ``start`` counts
    words from 0; of equally similar windows the first is given.
    """
    items = (
        benchmark.filter("item_id is not null")
        .select("item_id", words_of(F.col("text")).alias("words"))
        .withColumn("n", F.size("words"))
        .filter(F.col("n") >= shingle)
        .withColumn("shingles", shingles_of(F.col("words"), F.lit(0), F.col("n") - (shingle - 1), shingle))
        .withColumn("miss", F.floor((F.col("n") - (shingle - 1)) * (1 - threshold) + 1e-9).cast("int"))
        .select("item_id", "n", "miss", "shingles")
        .distinct()
    )
    items = saved(items, "items")
    step = (F.size("shingles") / (F.col("miss") + 1)).cast("double")
    probes = (
        items.select(
            "n",
            "shingles",
            F.explode(F.transform(F.sequence(F.lit(0), F.col("miss")), lambda k: F.floor(k * step).cast("int"))).alias("offset"),
        )
        .select(F.element_at("shingles", F.col("offset") + 1).alias("shingle"), "n")
        .distinct()
    )
    texts = docs.filter("doc_id is not null").select("doc_id", words_of(F.col("text")).alias("words"))
    last = F.size("words") - (shingle - 1)
    places = texts.select("doc_id", F.posexplode(shingles_of(F.col("words"), F.lit(0), last, shingle)).alias("at", "shingle"))
    hits = attach(places, probes, ["shingle"], how="inner").groupBy("doc_id", "n").agg(F.sort_array(F.collect_set("at")).alias("places"))
    asked = hits.groupBy("doc_id").agg(F.collect_list(F.struct("n", "places")).alias("asked"))
    # rows that repeat a document's text are read once
    once = texts.join(asked, "doc_id").withColumn("copy", F.xxhash64("words")).dropDuplicates(["doc_id", "copy"])
    item = F.col("n") - (shingle - 1)
    looked_up = F.floor(item * (1 - threshold) + 1e-9).cast("int") + 1
    spans = (
        once.select("doc_id", "copy", "words", last.alias("last"), F.explode("asked").alias("a"))
        .select("doc_id", "copy", "words", "last", "a.n", "a.places")
        .withColumn("w", _windows(F.col("places"), F.col("last"), item, looked_up, threshold))
        .select(
            "doc_id",
            "copy",
            "words",
            "last",
            "n",
            F.array_min(F.transform("w", lambda w: w["start"])).alias("low"),
            F.array_max(F.transform("w", lambda w: w["stop"])).alias("high"),
        )
        .select("doc_id", "copy", "last", "n", "low", F.posexplode(shingles_of(F.col("words"), F.col("low"), F.col("high"), shingle)).alias("at", "shingle"))
        .select("doc_id", "copy", "last", "n", (F.col("low") + F.col("at")).alias("at"), "shingle")
    )
    own = items.select("item_id", "n", F.explode("shingles").alias("shingle")).groupBy("item_id", "n", "shingle").agg(F.count(F.lit(1)).alias("weight"))
    known = own.select("n", "shingle").distinct().withColumn("known", F.lit(True))
    spelled = attach(spans, known, ["n", "shingle"]).groupBy("doc_id", "copy", "n", "last").agg(F.sort_array(F.collect_list(F.struct("at", "shingle", "known"))).alias("all"))
    inside = F.transform(F.filter("all", lambda x: x["known"].isNotNull()), lambda x: x["at"])
    # a window that stands out of the span has not enough probes
    shift = F.element_at("all", 1)["at"]
    within = lambda w: (w["start"] >= shift) & (w["stop"] <= shift + F.size("all"))
    found = spelled.withColumn("places", inside).withColumn("w", F.explode(F.filter(_windows(F.col("places"), F.col("last"), item, item, threshold), within)))
    windows = found.select(
        "doc_id",
        "copy",
        "w.start",
        "n",
        (F.col("w.stop") - F.col("w.start") + (shingle - 1)).alias("length"),
        F.explode(F.transform(F.slice("all", F.col("w.start") - shift + 1, F.col("w.stop") - F.col("w.start")), lambda x: x["shingle"])).alias("shingle"),
    )
    window = ["doc_id", "copy", "start", "n", "length"]
    counted = saved(windows.groupBy(*window, "shingle").agg(F.count(F.lit(1)).alias("weight")), "windows")
    item_prints = simhash(own, "item_id", "n").select("item_id", "n", F.col("total").alias("item_total"), F.col("fingerprint").alias("item_print"), F.explode(_blocks(F.col("fingerprint"))).alias("b"))
    window_prints = simhash(counted, *window).select("*", F.explode(_blocks(F.col("fingerprint"))).alias("b"))
    near = (
        window_prints.select(*window, "total", "fingerprint", "b.block", "b.value")
        .join(item_prints.select("item_id", "n", "item_total", "item_print", "b.block", "b.value"), ["n", "block", "value"])
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) < BLOCKS)
        .select(*window, "total", "item_id", "item_total")
        .distinct()
    )
    shared = (
        near.join(counted, window)
        .join(own.select("item_id", "n", "shingle", F.col("weight").alias("item_weight")), ["item_id", "n", "shingle"])
        .groupBy(*window, "item_id", "total", "item_total")
        .agg(F.sum(F.least("weight", "item_weight")).alias("both"))
    )
    alike = shared.withColumn("similarity", F.col("both") / (F.col("total") + F.col("item_total") - F.col("both")))
    best = F.max_by(F.struct("start", "length"), F.struct(F.col("similarity"), -F.col("start"), F.col("length")))
    return (
        alike.filter(F.col("similarity") >= threshold)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("w"), F.max("similarity").alias("similarity"))
        .select("doc_id", "item_id", F.col("w.start").cast("bigint").alias("start"), F.col("w.length").cast("bigint").alias("n_words"), "similarity")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without any benchmark passage; rows without a doc_id stay."""
    return docs.join(find_passages(docs, benchmark, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
