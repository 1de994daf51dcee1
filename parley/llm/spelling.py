"""Spelling variants: words one edit apart, joined by asymmetric chunks.

Of two words the shorter (of equal ones, either) gives two disjoint chunks of
half its length; the other gives its positional grams of that length.  One
inserted, deleted or replaced code point leaves one of the chunks whole, at the
same place or one further on, so joining chunks to grams within a shift of one
finds every pair; the candidates are verified.

A chunk that very many words share would give too many pairs.  There the chunk
is replaced by a mark in both words, and what remains is one edit apart too: it
is chunked and joined again, within the chunk that it shares.  That ends at
remains of two letters, of which there are only so many.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, saved, workers_ready
from parley.llm.words import parts

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A form occurs at least so many times as often as its variant.
RATIO = 2
#: Pairs of a chunk that are compared; chunks with more are split on.
PAIRS = 10_000
#: Different words that a task counts before it hands them on.
HELD = 200_000

_RUN = re.compile(f"[{LETTERS}]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_MARK = "_"


def _lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def _counts(least: int, slip: int | None):
    def batch_of(total: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for part in parts(batch, "text"):
                for key, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                    begun = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for found, n in Counter(_RUN.findall(text or "")).items():
                        word = _lowered(found)
                        if slip is not None:
                            h = zlib.crc32(word.encode(), begun)
                            if h % slip == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= HELD:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    return run


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, of at least
    ``least_length`` code points that occur at least ``least_count`` times.

    slip: where it divides the crc32 of ``<doc_id>:<run>``, the run loses its code
    point number crc32 mod length first: slips of the pen to find again.  Null
    and empty texts have no words; a null doc_id counts as the empty text;
    repeated rows count each time; other columns are ignored.
    """
    rows = workers_ready(docs).select("doc_id", "text").mapInArrow(_counts(least_length, slip), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _cut(text: str, at: Column, length: Column) -> Column:
    return F.substring(F.col(text), at + 1, length)


def _keyed(rows: DataFrame, places: Column) -> DataFrame:
    """One row per place (chunk at, own at) with its key, and the rest around a mark.

    ``length`` is the length of the chunked word's rest, on both sides.
    """
    half = F.floor(F.col("length") / 2).cast("int")
    split = rows.withColumn("half", half).withColumn("place", F.explode(places))
    own, at = F.col("place.own"), F.col("place.at")
    return split.select(
        "word",
        "n",
        F.concat_ws("|", "path", F.col("length").cast("string"), at.cast("string"), _cut("rest", own, F.col("half"))).alias("path"),
        F.concat(_cut("rest", F.lit(0), own), F.lit(_MARK), _cut("rest", own + F.col("half"), F.char_length("rest"))).alias("rest"),
        (F.col("length") - F.col("half") + 1).alias("length"),
    )


def _place(at: Column, own: Column) -> Column:
    return F.struct(at.alias("at"), own.alias("own"))


def _chunks(rows: DataFrame) -> DataFrame:
    zero, half = F.lit(0), F.col("half")
    return _keyed(rows, F.array(_place(zero, zero), _place(half, half)))


def _grams(rows: DataFrame) -> DataFrame:
    """Of all positional grams those that a chunk can meet: at its place, or one
    further on if the word is longer by one."""
    zero, half = F.lit(0), F.col("half")
    same = [_place(zero, zero), _place(half, half)]
    later = [_place(zero, zero + 1), _place(half, half + 1)]
    longer = F.char_length("rest") > F.col("length")
    return _keyed(rows, F.when(longer, F.array(*same, *later)).otherwise(F.array(*same)))


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, a_n, b, b_n): each two of the distinct words (word, n) that one edit parts, once."""
    rows = words.select("word", "n", F.lit("").alias("path"), F.col("word").alias("rest"), F.char_length("word").alias("length"))
    chunks = rows
    # a word meets words of its own length and words shorter by one
    grams = rows.withColumn("length", F.explode(F.array("length", F.col("length") - 1)))
    found = None
    while True:
        chunks, grams = saved(_chunks(chunks), "chunks"), saved(_grams(grams), "grams")
        left = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.max("length").alias("length"))
        keys = saved(left.join(grams.groupBy("path").agg(F.count(F.lit(1)).alias("g")), "path"), "keys")
        much = (F.col("c") * F.col("g") > pairs) & (F.col("length") > 3)
        light, heavy = keys.filter(~much).select("path"), keys.filter(much).select("path")
        a = chunks.join(light, "path", "left_semi").select("path", F.col("word").alias("a"), F.col("n").alias("a_n"))
        b = grams.join(light, "path", "left_semi").select("path", F.col("word").alias("b"), F.col("n").alias("b_n"))
        shorter = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
        # the bounded distance is -1 beyond its bound
        links = a.join(b, "path").filter(shorter & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        found = links if found is None else found.union(links)
        if heavy.isEmpty():
            return found.distinct()
        chunks, grams = chunks.join(heavy, "path", "left_semi"), grams.join(heavy, "path", "left_semi")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last, twice as far in each round."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    # a form occurs more often than its word, so that no chain comes back
    while not now.join(now.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = saved(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return now


def variants(words: DataFrame, ratio: int = RATIO, pairs: int = PAIRS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of the distinct words (word, n).

    Near words differ by one inserted, deleted or replaced code point; n_near
    counts them.  form: the near word of largest n (of equal ones the first in
    code-point order) if its n is at least ``ratio`` times the word's; form_n is
    its n; both are null otherwise.  root: the last word that is reached by
    forms, the word itself if it has none.  Rows without a word or an n are
    left out, words that repeat count together, other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms do not go round in circles")
    words = words.filter("word is not null and n > 0").groupBy("word").agg(F.sum("n").cast("bigint").alias("n"))
    words = saved(words, "words")
    pairs_ = near_words(words, pairs)
    near = pairs_.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    near = near.union(pairs_.select("b", "a", "a_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("rare"), F.col("near")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has = -F.col("best.rare") >= ratio * F.col("n")
    table = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"),
        F.when(has, -F.col("best.rare")).alias("form_n"),
    )
    table = saved(table, "variants")
    roots = _roots(table.filter("form is not null"))
    out = table.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
