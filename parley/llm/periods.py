"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words with smallest period q, at least ``exponent`` times
q and ``least`` words long, that cannot be extended.

1. Lagging by q, a run matches itself over ``gram`` words or more, so each of
   its words lies in a sequence of ``gram`` words that its text holds twice.
   Only stretches of such words go on; they hold every run whole.
2. Re-Pair over the word ids: in each round every pair of neighbours that is
   the most frequent one at its place becomes a nonterminal, until no pair
   occurs twice.  What then remains of a stretch is joined pairwise.
3. A run lies in a least nonterminal and crosses the boundary between its two
   halves.  Runs over the boundary are computed once for each nonterminal, by
   comparing words around it: of all periods at once by prefix hashes, which
   only tell what cannot be a run, then word by word.
4. They are carried to every place that derives the nonterminal, and
   intervals of one period that overlap by a period become one.

The work of a text is a task's own: nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, workers_ready
from parley.llm.words import Words, mix, parts, power_table, rolling

LEAST = 24
EXPONENT = 3
#: Pairs (nonterminal, period) that are looked at together: bounds the memory of a task.
TOGETHER = 1 << 19


def gram_for(least: int, exponent: int) -> int:
    """Words over which any run matches itself at the lag of its period, at least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def _starts(flags: np.ndarray) -> np.ndarray:
    """For each True, where its stretch of Trues begins."""
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    return np.maximum.accumulate(np.where(first, np.arange(len(flags)), 0))


def _stretches(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in sequences that their text holds twice: their numbers, and which stretch each belongs to."""
    none = np.zeros(0, np.int64)
    n = len(words.hash) - gram + 1
    if n <= 0:
        return none, none
    text = np.repeat(np.arange(len(words.first) - 1), words.counts())
    whole = np.flatnonzero(text[:n] == text[gram - 1 :])
    keys = rolling(words.hash, gram)[whole] + mix(text[whole].astype(np.uint64))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(whole), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(edge, whole[twice], 1)
    np.add.at(edge, whole[twice] + gram, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(at):
        return none, none
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])
    return at, np.cumsum(fresh) - 1


class _Boundaries:
    """Runs over the boundaries of nonterminals, carried to all their places."""

    def __init__(self, ids: np.ndarray, least: int, exponent: int):
        self.ids, self.least, self.exponent = ids, least, exponent
        self.up, self.down = power_table(len(ids) + 1)
        steps = mix(ids.astype(np.uint64) + np.uint64(1)) * self.up[: len(ids)]
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)))
        self.found: list[tuple[np.ndarray, int, int]] = []  # places, length, period

    def _blocks_equal(self, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        total, down = self.total, self.down
        return (total[i + k] - total[i]) * down[i] == (total[j + k] - total[j]) * down[j]

    def _possible(self, a, b, e, q) -> np.ndarray:
        """Whether a run of period q may cross b inside [a, e): from one side of
        the boundary, or of the place a period before it, half of its matches follow."""
        k = (np.maximum((self.exponent - 1) * q, self.least - q) + 1) // 2
        possible = np.zeros(len(q), dtype=bool)
        # matches of word x with word x + q, for x from there on or before there
        for i, back in ((b, False), (b, True), (b - q, False), (b - q, True)):
            x = i - k if back else i
            left = np.flatnonzero(~possible & (x >= a) & (x + k + q <= e))
            possible[left] = self._blocks_equal(x[left], x[left] + q[left], k[left])
        return possible

    def _matches(self, i: int, q: int, stop: int) -> int:
        """How many words from i on equal those q later, which end before ``stop``."""
        ids, n, step = self.ids, 0, 64
        while i + n + q < stop:
            m = min(step, stop - q - i - n)
            wrong = ids[i + n : i + n + m] != ids[i + n + q : i + n + q + m]
            if wrong.any():
                return n + int(wrong.argmax())
            n, step = n + m, step * 4
        return n

    def _matches_before(self, i: int, q: int, stop: int) -> int:
        """How many words before i, not before ``stop``, equal those q later."""
        ids, n, step = self.ids, 0, 64
        while i - n > stop:
            m = min(step, i - n - stop)
            wrong = ids[i - n - m : i - n] != ids[i - n - m + q : i - n + q]
            if wrong.any():
                return n + int(wrong[::-1].argmax())
            n, step = n + m, step * 4
        return n

    def _runs(self, a: int, b: int, e: int, periods: np.ndarray) -> list[tuple[int, int, int]]:
        """Runs (start, stop, period) over b inside [a, e), of the given ascending periods."""
        out: list[tuple[int, int, int]] = []
        while len(periods):
            q = int(periods[0])
            for i in (b, b - q):
                # a multiple of the period of a run that holds [i, i + q) gives that run again
                if i < a or i + q > e or any(s <= i and i + q <= t and q % p == 0 for s, t, p in out):
                    continue
                start = i - self._matches_before(i, q, a)
                stop = i + q + self._matches(i, q, e)
                if stop - start >= max(self.least, self.exponent * q) and start < b < stop:
                    out.append((start, stop, q))
            periods = periods[1:]
            if out and out[-1][2] == q:
                again = np.zeros(len(periods), dtype=bool)
                for s, t, p in out:
                    inner = (s <= b - periods) | (b - periods < a)
                    again |= inner & ((b + periods <= t) | (b + periods > e)) & (periods % p == 0)
                periods = periods[~again]
        return out

    def add(self, a: np.ndarray, split: np.ndarray, length: np.ndarray, places: list[np.ndarray]) -> None:
        """Nonterminals by one place ``a``, the length of the first half and of both, and all their places."""
        long = np.flatnonzero(length >= self.least)
        many = length[long] // self.exponent
        upto = np.cumsum(many)
        i = 0
        while i < len(long):
            before = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + TOGETHER, side="right")))
            node = np.repeat(long[i:j], many[i:j])
            q = np.arange(len(node)) - np.repeat(upto[i:j] - many[i:j] - before, many[i:j]) + 1
            start = a[node]
            maybe = np.flatnonzero(self._possible(start, start + split[node], start + length[node], q))
            node, q = node[maybe], q[maybe]
            edges = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
            for x, y in zip(edges, np.append(edges, len(node))[1:], strict=True):
                v = node[x]
                at = int(a[v])
                runs = self._runs(at, at + int(split[v]), at + int(length[v]), q[x:y])
                for s, t, period in sorted(set(runs), key=lambda r: r[2]):
                    if not any(u <= s and t <= w and period % p == 0 and p < period for u, w, p in runs):
                        self.found.append((places[v] + (s - at), t - s, period))
            i = j

    def merged(self) -> np.ndarray:
        """Rows (start, stop, period): intervals of one period that overlap by a period are one."""
        if not self.found:
            return np.zeros((0, 3), np.int64)
        start = np.concatenate([p for p, _, _ in self.found])
        size = [len(p) for p, _, _ in self.found]
        stop = start + np.repeat([n for _, n, _ in self.found], size)
        period = np.repeat([q for _, _, q in self.found], size)
        order = np.lexsort((-stop, start, period))
        start, stop, period = start[order], stop[order], period[order]
        rank = np.cumsum(np.append(False, period[1:] != period[:-1])) * (len(self.ids) + 1)
        reach = np.maximum.accumulate(stop + rank)
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = start[1:] + rank[1:] + period[1:] > reach[:-1]
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(start)) - 1
        return np.stack((start[first], reach[last] - rank[last], period[first]), axis=1)


def _replace(chosen, names, symbol, start, length, owner, seen: _Boundaries) -> tuple[np.ndarray, ...]:
    """Join each chosen symbol with the next one.  Equal ``names`` are one nonterminal."""
    order = np.argsort(names, kind="stable")
    _, first = np.unique(names[order], return_index=True)
    places = np.split(start[chosen[order]], first[1:])
    rep = chosen[order[first]]
    seen.add(start[rep], length[rep], length[rep] + length[rep + 1], places)
    symbol[chosen] = names
    length[chosen] += length[chosen + 1]
    keep = np.ones(len(symbol), dtype=bool)
    keep[chosen + 1] = False
    return symbol[keep], start[keep], length[keep], owner[keep]


def runs_of(ids: np.ndarray, owner: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, stop, period) of all runs of the stretches that ``owner`` tells apart."""
    seen = _Boundaries(ids, least, exponent)
    symbol = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    start, length = np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
    names = int(symbol.max(initial=0)) + 1
    while len(symbol) > 1:
        inside = owner[1:] == owner[:-1]
        pair = np.where(inside, symbol[:-1] * names + symbol[1:], -1)
        _, which, count = np.unique(pair, return_inverse=True, return_counts=True)
        often = np.where(inside, count[which], 0)
        # a pair is replaced where no pair that overlaps it comes first; ties by a hash of the pair
        rank = np.empty(len(count), dtype=np.int64)
        rank[np.argsort(mix(np.arange(len(count), dtype=np.uint64)))] = np.arange(len(count))
        first = np.where(often > 1, often * len(count) + rank[which], -1)
        best = first >= 0
        best[1:] &= first[1:] >= first[:-1]
        best[:-1] &= first[:-1] >= first[1:]
        # neighbours that are both best are the same pair x x of x x x ...: every other one
        best &= (np.arange(len(best)) - _starts(best)) % 2 == 0
        chosen = np.flatnonzero(best)
        if not len(chosen):
            break
        new = np.unique(which[chosen], return_inverse=True)[1]
        symbol, start, length, owner = _replace(chosen, names + new, symbol, start, length, owner, seen)
        names += int(new.max()) + 1
    while True:
        inside = owner[1:] == owner[:-1]
        if not inside.any():
            return seen.merged()
        begin = np.append(True, ~inside)
        order = np.arange(len(owner)) - np.maximum.accumulate(np.where(begin, np.arange(len(owner)), 0))
        chosen = np.flatnonzero(inside & (order[:-1] % 2 == 0))
        symbol, start, length, owner = _replace(chosen, names + np.arange(len(chosen)), symbol, start, length, owner, seen)
        names += len(chosen)


def text_runs(texts: pa.Array, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period."""
    words = Words(texts)
    at, stretch = _stretches(words, gram_for(least, exponent))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    if not len(at):
        return out
    found = runs_of(words.hash[at], stretch, least, exponent)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    begin = at[found[:, 0]]
    text = np.searchsorted(words.first, begin, side="right") - 1
    for d, s, n, q in zip(text.tolist(), (begin - words.first[text]).tolist(), (found[:, 1] - found[:, 0]).tolist(), found[:, 2].tolist(), strict=True):
        out[d].append((s, n, q))
    return out


def _collapsed(least: int, exponent: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                texts = column(part, "text")
                runs = text_runs(texts, least, exponent)
                kept, total = [], []
                for text, found in zip(texts.to_pylist(), runs, strict=True):
                    words = (text or "").encode("utf-8").split()
                    total.append(len(words))
                    if found:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, n, q in found:
                            edge[s + q] += 1
                            edge[s + n] -= 1
                        gone = np.cumsum(edge[:-1]) > 0
                        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    kept.append(b" ".join(words))
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                arrays = [part.column("doc_id").cast(pa.int64()), pa.array(total, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "runs", "collapsed"])

    return run


def collapsed(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    runs: array of (start, length, period) by start, then period; start counts
    words from 0.  collapsed: the text without the words that a run holds after
    its first period, words joined by one space.  Words are separated by ASCII
    white space and compared as they are, by 64-bit hashes.  A null or empty
    text has no words, no runs and an empty ``collapsed``.  Each row is judged
    on its own: repeated rows give equal rows, a null doc_id stays null; other
    columns are ignored and an empty table gives no rows.
    """
    if exponent < 2 or least < exponent:
        raise ValueError("exponent must be 2 or more and least not below it")
    kind = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return workers_ready(docs).select("doc_id", "text").mapInArrow(_collapsed(least, exponent), kind)


def run_digest(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the run of greatest length by period, and digests."""

    def higher(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (
            F.when(a != b, F.when(a > b, -1).otherwise(1))
            .when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .otherwise(F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
        )

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.get(F.array_sort("runs", higher), 0)
    named = found.select("doc_id", "runs", "collapsed", top.alias("top"))
    return named.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def overlaid(docs: DataFrame) -> DataFrame:
    """Documents of which every tenth, by the crc32 of its id, repeats words from some place on."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def again(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(ws, place(i).cast("int"))), " "))

    ws = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # the words are bound to a variable, so that the text is split once
    bound = F.get(F.transform(F.array(ws), again), 0)
    return docs.select("doc_id", F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")).alias("text"))
