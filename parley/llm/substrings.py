"""Removal of repeated word windows, by super-k-mers.

A window is ``size`` consecutive words of one text.  Every window has a
minimiser: the least hash of its runs of ``seed`` words.  Equal windows have
equal minimisers, and consecutive windows mostly share one, so they travel
together as one packed string (a super-k-mer) to the bucket of their minimiser.
There their windows are sorted as strings, and each run of equal windows shows
the least document it starts in.

Only super-k-mers whose minimiser occurs in two documents are packed at all.
A minimiser with more than ``heavy`` super-k-mers would make one bucket too
large: its windows travel one by one, pre-aggregated by Spark.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, grouped, saved, workers_ready
from parley.llm.words import Words, parts, rolling

SIZE = 50
SEED = 10
HEAVY = 50_000
_KEY = ["doc_id", "mark"]
LONGEST_RUN = 512  # windows of one packed string: bounds its length in texts of one repeated word


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x[:n]


def _runs(words: Words, size: int, seed: int):
    """(minimiser, text, first word in the text, windows) of each super-k-mer."""
    last = words.first[1:] - size  # the last word at which a window of the text starts
    n = len(words.hash) - size + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    least = _sliding_least(rolling(words.hash, seed), size - seed + 1)
    text = np.searchsorted(words.first, np.arange(n), side="right") - 1
    good = np.arange(n) <= last[text]
    breaks = np.ones(n, dtype=bool)
    breaks[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])
    begin = np.flatnonzero(breaks)
    length = np.diff(np.append(begin, n))
    begin, length = begin[good[begin]], length[good[begin]]
    if len(length) and length.max() > LONGEST_RUN:
        pieces = -(-length // LONGEST_RUN)
        order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(length, pieces) - order * LONGEST_RUN
        begin = np.repeat(begin, pieces) + order * LONGEST_RUN
        length = np.minimum(left, LONGEST_RUN)
    of = text[begin]
    return least[begin].view(np.int64), of, begin - words.first[of], length


def _minimisers(size: int, seed: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                least, of, at, n = _runs(Words(column(part, "text")), size, seed)
                doc, mark = (column(part, c).take(pa.array(of.astype(np.int64))) for c in _KEY)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least), doc, mark, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["least", *_KEY, "at", "n"],
                )

    return run


def _pack(size: int, single: bool):
    """The packed strings of the listed super-k-mers; one per window if ``single``."""

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                texts, keys = column(part, "text").to_pylist(), zip(*(column(part, c).to_pylist() for c in _KEY), strict=True)
                least, doc, mark, at, packed = [], [], [], [], []
                for text, key, runs in zip(texts, keys, column(part, "runs").to_pylist(), strict=True):
                    words = text.encode("utf-8").split()
                    for r in runs:
                        for i, n in [(r["at"] + j, 1) for j in range(r["n"])] if single else [(r["at"], r["n"])]:
                            least.append(r["least"])
                            doc.append(key[0])
                            mark.append(key[1])
                            at.append(i)
                            packed.append(b" ".join(words[i : i + n + size - 1]))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(a, pa.int64()) for a in (least, doc, mark)), pa.array(at, pa.int32()), pa.array(packed, pa.binary())],
                    names=["least", *_KEY, "at", "packed"],
                )

    return run


def _repeats_of(rows: list[tuple[bytes, int, int, int]], size: int, out: list) -> None:
    """Windows of one bucket that start in a smaller document too."""
    owners: dict[bytes, list[tuple[int, int, int]]] = {}
    for packed, doc, mark, at in rows:
        owners.setdefault(packed, []).append((doc, mark, at))
    windows = []
    for packed, places in owners.items():
        places.sort()
        edges = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
        starts = [0, *(e + 1 for e in edges)]
        stops = [*edges, len(packed)]
        n = len(starts) - size + 1
        least = places[0][0]
        if len(owners) == 1:  # all the same string
            out.extend((d, m, a, n) for d, m, a in places if d > least)
            return
        windows += [(packed[starts[i] : stops[i + size - 1]], least, packed, i) for i in range(n)]
    windows.sort(key=lambda w: w[:2])
    for _, same in groupby(windows, key=lambda w: w[0]):
        same = list(same)
        first = same[0][1]
        for _, _, packed, i in same:
            out.extend((d, m, a + i, 1) for d, m, a in owners[packed] if d > first)


def _repeats(size: int):
    def run(batches):
        out: list[tuple[int, int, int, int]] = []
        for _, (packed, docs, marks, at) in grouped(batches, "least", "packed", *_KEY, "at"):
            if min(docs) < max(docs):
                _repeats_of(list(zip(packed, docs, marks, at, strict=True)), size, out)
            if len(out) > 50_000:
                yield _spans(out)
                out = []
        yield _spans(out)

    return run


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Neighbouring windows of a document become one span."""
    rows.sort()
    merged: list[list[int]] = []
    for doc, mark, at, n in rows:
        last = merged[-1] if merged else None
        if last and last[:2] == [doc, mark] and last[2] + last[3] >= at:
            last[3] = max(last[3], at + n - last[2])
        else:
            merged.append([doc, mark, at, n])
    arrays = zip(*merged, strict=True) if merged else ([], [], [], [])
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(list(a), t) for a, t in zip(arrays, types, strict=True)], names=[*_KEY, "at", "n"])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text) of rows with a doc_id: mark is a hash of the text where
    some doc_id has more than one row, else 0."""
    docs = docs.filter("doc_id is not null")
    once = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    mark = F.lit(0).cast("bigint") if once else F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), mark.alias("mark"), "text")


def repeated_windows(docs: DataFrame, size: int = SIZE, seed: int = SEED, heavy: int = HEAVY) -> DataFrame:
    """Spans (doc_id, mark, at, n): the windows that start at words at .. at + n - 1
    of the document also start in a document with a smaller doc_id.

    docs: doc_id bigint, text string (null: no words), and mark bigint, which
    tells texts of the same doc_id apart (see ``keyed``).  Texts shorter than a
    window have none.  Other columns are ignored.
    """
    if not 1 <= seed <= size:
        raise ValueError("seed must lie between 1 and size")
    docs = workers_ready(docs).select(*_KEY, "text").filter("doc_id is not null and text is not null")
    seen = saved(docs.mapInArrow(_minimisers(size, seed), "least bigint, doc_id bigint, mark bigint, at int, n int"), "minimisers")
    shared = (
        seen.groupBy("least")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("rows"))
        .filter("lo < hi")
        .select("least", (F.col("rows") > heavy).alias("heavy"))
    )
    wanted = saved(seen.join(shared, "least"), "wanted")

    def packed(rows: DataFrame, single: bool) -> DataFrame:
        runs = rows.groupBy(*_KEY).agg(F.collect_list(F.struct("least", "at", "n")).alias("runs"))
        return docs.join(runs, _KEY).mapInArrow(_pack(size, single), "least bigint, doc_id bigint, mark bigint, at int, packed binary")

    light = packed(wanted.filter("not heavy"), False)
    spans = light.repartition("least").sortWithinPartitions("least").mapInArrow(_repeats(size), "doc_id bigint, mark bigint, at int, n int")
    if not wanted.filter("heavy").isEmpty():
        single = packed(wanted.filter("heavy"), True)
        first = single.groupBy("packed").agg(F.min("doc_id").alias("first"))
        more = single.join(first, "packed").filter("doc_id > first").select(*_KEY, "at", F.lit(1).alias("n"))
        spans = spans.union(more)
    return spans


def _cut(size: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                texts = column(part, "text").to_pylist()
                spans = column(part, "spans").to_pylist()
                kept, total, gone = [], [], []
                for text, found in zip(texts, spans, strict=True):
                    words = (text or "").encode("utf-8").split()
                    n = len(words)
                    if found:
                        edge = np.zeros(n + 1, dtype=np.int32)
                        for s in found:
                            edge[s["at"]] += 1
                            edge[s["at"] + s["n"] + size - 1] -= 1
                        inside = np.cumsum(edge[:-1]) > 0
                        words = [w for w, x in zip(words, inside.tolist(), strict=True) if not x]
                    total.append(n)
                    gone.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, seed: int = SEED, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a
    window repeated from a smaller document covers.

    Words are separated by ASCII white space and kept as they are; kept words
    are joined by one space.  A null or empty text gives no words and an empty
    ``kept``.  Windows are judged on the input.  Rows that repeat a doc_id give a
    row each; their windows never count as those of a smaller document for one
    another.  Rows without a doc_id are left out.
    """
    docs = keyed(docs)
    spans = repeated_windows(docs, size, seed, heavy)
    runs = spans.groupBy(*_KEY).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    joined = docs.join(runs, _KEY, "left")
    return joined.mapInArrow(_cut(size), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def kept_digest(removed: DataFrame) -> DataFrame:
    """The digest of what remains of each document."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


__all__ = ["kept_digest", "keyed", "remove_repeats", "repeated_windows"]
