"""Language-model scores by a hierarchical Pitman-Yor model.

The model is a bigram model: every word has a restaurant for what follows it,
and all of them share the parent restaurant of single words, whose base is the
uniform distribution over the known words and one unknown.

1. Blocks of texts give their distinct word pairs, packed as arrays and keyed by
   the shard of the context.  Contexts that hold more than a quarter of a shard
   are dealt over all shards by the pair instead (at most ``HOT`` contexts, which
   then hold more than 1 / ``HOT`` of all tokens each).
2. A shard seats the customers of its restaurants.  A Gibbs sweep empties each
   dish of a restaurant in turn and seats its customers again, one by one, given
   all other tables and the parent's probability of the dish.  First sweeps use
   the shard's own tables as parent.
3. Shards send their tables per word to the root shards, which add them up, seat
   them at the parent's tables and answer.  The same exchange sums the tables of
   the contexts that were dealt over shards, and counts words for the base score.
4. Shards go on from the same seats with the true parent; after some sweeps the
   predictive probabilities of several are averaged.  The logarithms go back to
   the block, one for each of its pairs, and are added up there by text.

Arrays travel per block and shard, so Spark moves few, large rows; no table of
the vocabulary is broadcast or collected.  What a row holds grows with its pairs
alone, so that the bytes moved do not depend on the number of shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, crc_mod, saved, workers_ready
from parley.llm.words import Words, mix, parts

HELD_OUT = (5, 1)  # crc32(doc_id) mod 5 = 1 is never learned from
SHARD_BYTES = 10 << 20
BLOCK_BYTES = 8 << 20
HOT = 1 << 14  # most contexts that are dealt over all shards: their list goes to every task
DISCOUNT = (0.5, 0.8)  # of the parent and of the contexts
STRENGTH = (10.0, 2.0)
LOCAL_SWEEPS, BURN_IN, SAMPLES = 1, 2, 4
END, START = mix(np.array([0x454E44, 0x5354415254], dtype=np.uint64))
SCORE_STEPS = 1 << 16  # to one power of ten: a rounding of 1e-5 a token, far below what the seats of another run change
_STEP = 32  # customers i to i + i // _STEP of a dish are seated together


def _shard(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and text of every token, with an end after each text."""
    n = len(words.first) - 1
    token = np.insert(words.hash, words.first[1:], END)
    text = np.repeat(np.arange(n), words.counts() + 1)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[words.first[:-1] + np.arange(n)] = START
    return context, token, text


def _small(values: np.ndarray) -> bytes:
    """Numbers from 0, after the width that the largest needs: compressed bytes, those of the same place together."""
    if not len(values):
        return b""
    top = int(values.max())
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    width = np.dtype(kind).itemsize
    places = values.astype(kind).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + pa.compress(places.tobytes(), codec="zstd", asbytes=True)


def _numbers(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``_small``."""
    if not n:
        return np.zeros(0, dtype=np.int64)
    places = np.frombuffer(pa.decompress(raw[1:], n * raw[0], codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(places.reshape(raw[0], n).T).view(f"u{raw[0]}").ravel().astype(np.int64)


def _frequent(most: int):
    """Tokens of each block and its contexts with over 1 / (4 * most) of them.

    A context with 1 / most of all tokens has three quarters of them in such blocks at least.
    """

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text", BLOCK_BYTES):
                context, _, _ = _tokens(Words(column(part, "text"), lower=True))
                values, counts = np.unique(context, return_counts=True)
                often = counts * 4 * most >= len(context)
                values, counts = np.append(values[often].view(np.int64), 0), np.append(counts[often], len(context))
                total = np.append(np.zeros(int(often.sum()), bool), True)
                yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(values), pa.array(counts)], names=["total", "context", "n"])

    return run


PAIRS = "shard int, block bigint, docs binary, texts int, learned int, context binary, runs binary, words binary, word binary, times binary, text binary"


def pair_row(shard: int, block: int, docs: bytes | None, texts: int, learned: int, context: np.ndarray, token: np.ndarray, text: np.ndarray) -> tuple:
    """Occurrences in order of their pairs, as one row of ``PAIRS``: contexts and their
    numbers of words, the steps between the sorted distinct words and the word of each
    pair, the numbers of occurrences of the pairs, and the text of each occurrence.  Of the
    block's texts the first ``learned`` are learned from."""
    first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (token[1:] != token[:-1])))
    times = np.diff(np.append(first, len(context)))
    context, token = context[first], token[first]
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    runs = np.diff(np.append(new, len(context)))
    words, word = np.unique(token, return_inverse=True)
    return (shard, block, docs, texts, learned, context[new].tobytes(), _small(runs), _small(np.diff(words, prepend=np.uint64(0))), _small(word), _small(times), _small(text))


def _pairs(shards: int, hot: np.ndarray, held_out: tuple[int, int]):
    """The distinct pairs of each block by shard.  Only the first row of a block
    carries the keys of its texts."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in parts(batch, "text", BLOCK_BYTES):
                number += 1
                ids = column(part, "doc_id")
                held = crc_mod_text(ids, held_out[0]) == held_out[1]
                place = np.argsort(held, kind="stable")
                context, token, text = _tokens(Words(column(part, "text"), lower=True))
                text = np.argsort(place)[text]
                top = mix(context)
                if len(hot):
                    dealt = np.isin(context, hot)
                    top[dealt] = mix(context[dealt] ^ mix(token[dealt]))
                key = (top & np.uint64(0xFFFFFFFF00000000)) | (mix(token) >> np.uint64(32))
                order = np.argsort(key, kind="stable")
                context, token, text, key = context[order], token[order], text[order], key[order]
                shard = _shard(key, shards)
                edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist() + [len(shard)]
                keys = ids.to_numpy(zero_copy_only=False).astype(np.int64)[place].tobytes()
                rows = []
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    rows.append(pair_row(int(shard[i]), number, None if rows else keys, len(ids), int((~held).sum()), context[i:j], token[i:j], text[i:j]))
                for i in range(0, len(rows), 16):
                    yield from _table(rows[i : i + 16], PAIRS).to_batches()

    return run


def crc_mod_text(ids: pa.Array, n: int) -> np.ndarray:
    """crc32 of keys as text, mod n; null as empty text."""
    return crc_mod(np.array(["" if k is None else k for k in ids.to_pylist()], dtype=object), n)


class Shard:
    """The restaurants of one shard."""

    def __init__(self, rows: pa.Table, discount: float, strength: float):
        self.blocks, context, word = [], [], []
        times = []
        for row in sorted(rows.to_pylist(), key=lambda r: r["block"]):
            c = np.frombuffer(row["context"], dtype=np.uint64)
            c = np.repeat(c, _numbers(row["runs"], len(c)))
            n = _numbers(row["times"], len(c))
            learn = _numbers(row["text"], int(n.sum())) < row["learned"]
            context.append(c)
            w = _numbers(row["word"], len(c))
            word.append(np.cumsum(_numbers(row["words"], int(w.max()) + 1).view(np.uint64))[w])
            times.append(np.add.reduceat(learn.astype(np.int64), np.cumsum(n) - n))
            self.blocks.append((row["block"], row["docs"], row["texts"], len(c), row["times"], row["text"]))
        context, word, times = np.concatenate(context), np.concatenate(word), np.concatenate(times)
        pair = mix(context) + np.uint64(3) * word
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        new = np.append(True, sorted_pair[1:] != sorted_pair[:-1])
        self.entry = np.empty(len(pair), dtype=np.int64)  # of each block's pairs
        self.entry[order] = np.cumsum(new) - 1
        first = order[np.flatnonzero(new)]
        self.count = np.bincount(self.entry, weights=times).astype(np.int64)
        self.contexts, self.at = np.unique(context[first], return_inverse=True)
        self.words, self.dish = np.unique(word[first], return_inverse=True)
        self.guests = self._by_context(self.count)
        self.discount, self.strength = discount, strength
        many = np.flatnonzero(self.count > 1)
        self.many = many[np.argsort(-self.count[many], kind="stable")]
        self.tables = np.minimum(self.count, 1)
        self.more_tables = np.zeros(len(self.contexts), dtype=np.int64)  # of the same context in other shards

    def _by_context(self, values) -> np.ndarray:
        return np.bincount(self.at, weights=values, minlength=len(self.contexts)).astype(np.int64)

    def of_words(self, values) -> np.ndarray:
        return np.bincount(self.dish, weights=values, minlength=len(self.words)).astype(np.int64)

    def sweep(self, parent: np.ndarray, random: np.random.Generator) -> None:
        """Seat the customers of every dish anew; ``parent``: probability of each word."""
        self.tables[self.many] = seat(
            self.count[self.many],
            (self._by_context(self.tables) + self.more_tables)[self.at[self.many]] - self.tables[self.many],
            parent[self.dish[self.many]],
            self.discount,
            self.strength,
            random,
        )

    def predictive(self, parent: np.ndarray) -> np.ndarray:
        all_tables = (self._by_context(self.tables) + self.more_tables)[self.at]
        own = np.maximum(self.count - self.discount * self.tables, 0)
        return (own + (self.strength + self.discount * all_tables) * parent[self.dish]) / (self.strength + self.guests[self.at])


def seat(count, other_tables, parent, discount, strength, random) -> np.ndarray:
    """Tables of each dish after its ``count`` customers (in falling order) took
    their seats in turn.  Customer i + 1 opens a table with the weight
    (strength + discount * tables) * parent against i - discount * own tables.
    Customers i to i + i // 32 decide together on the state before them."""
    tables = np.ones(len(count), dtype=np.int64)
    i = 1
    n = int(np.searchsorted(-count, -1, side="left"))
    while n:
        together = 1 + i // _STEP
        own = tables[:n]
        fresh = (strength + discount * (other_tables[:n] + own)) * parent[:n]
        chance = fresh / (fresh + i - discount * own)
        if together == 1:
            tables[:n] += random.random(n) < chance
        else:
            tables[:n] += random.binomial(np.minimum(together, count[:n] - i), chance)
        i += together
        n = int(np.searchsorted(-count[:n], -i, side="left"))
    return tables


def _local(rows: pa.Table, shard: int) -> tuple[Shard, np.random.Generator]:
    """The shard after its sweeps with its own tables as parent."""
    own = Shard(rows, DISCOUNT[1], STRENGTH[1])
    random = np.random.default_rng([shard, 7])
    for _ in range(LOCAL_SWEEPS):
        guests = own.of_words(own.tables)
        dishes = np.minimum(guests, 1)
        rest = (STRENGTH[0] + DISCOUNT[0] * dishes.sum()) / (len(own.words) + 1)
        own.sweep((guests - DISCOUNT[0] * dishes + rest) / (STRENGTH[0] + guests.sum()), random)
    return own, random


UP = "root int, shard int, word binary, tables binary, count binary, hot binary, hot_tables binary, hot_guests binary"
DOWN = "shard int, root int, tables binary, seats binary, count binary, hot_tables binary, hot_guests binary, totals array<double>"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[k]) for i, (n, k) in enumerate(fields)})


def _to_roots(roots: int, hot: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        own, _ = _local(rows, shard)
        tables, count = own.of_words(own.tables), own.of_words(own.count)
        root = _shard(mix(own.words), roots).astype(np.int64)
        dealt = np.flatnonzero(np.isin(own.contexts, hot))
        dealt_root = _shard(mix(own.contexts[dealt]), roots).astype(np.int64)
        by_context = own._by_context(own.tables)
        out = []
        for r in range(roots):
            a, b = root == r, dealt[dealt_root == r]
            out.append((r, shard, own.words[a].tobytes(), _small(tables[a]), _small(count[a]), own.contexts[b].tobytes(), by_context[b].tobytes(), own.guests[b].tobytes()))
        return _table(out, UP)

    return run


def _at_root(roots: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        root = key[0].as_py()
        rows = sorted(rows.to_pylist(), key=lambda r: r["shard"])
        lists = [np.frombuffer(r["word"], dtype=np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        add = lambda name: np.bincount(
            at, weights=np.concatenate([_numbers(r[name], len(w)) for r, w in zip(rows, lists, strict=True)]), minlength=len(words)
        ).astype(np.int64)
        tables, count = add("tables"), add("count")
        known = int((count > 0).sum())
        random = np.random.default_rng([root, 11])
        seats = np.minimum(tables, 1)
        many = np.flatnonzero(tables > 1)
        many = many[np.argsort(-tables[many], kind="stable")]
        base = np.full(len(many), 1 / (known * roots + 1))  # words are dealt evenly over the roots
        for _ in range(BURN_IN):
            seats[many] = seat(tables[many], seats.sum() * roots - seats[many], base, DISCOUNT[0], STRENGTH[0], random)
        hot = [np.frombuffer(r["hot"], dtype=np.uint64) for r in rows]
        contexts, place = np.unique(np.concatenate(hot), return_inverse=True)
        sums = [
            np.bincount(place, weights=np.concatenate([np.frombuffer(r[n], dtype=np.int64) for r in rows]), minlength=len(contexts)).astype(np.int64)
            for n in ("hot_tables", "hot_guests")
        ]
        totals = [float(known), float(count.sum()), float(tables.sum()), float(seats.sum())]
        out, i, j = [], 0, 0
        for row, own, h in zip(rows, lists, hot, strict=True):
            a, b = at[i : i + len(own)], place[j : j + len(h)]
            i, j = i + len(own), j + len(h)
            out.append((row["shard"], root, _small(tables[a]), _small(seats[a]), _small(count[a]), sums[0][b].tobytes(), sums[1][b].tobytes(), totals))
        return _table(out, DOWN)

    return run


SCORES = "block bigint, shard int, docs binary, texts int, pairs int, times binary, text binary, score binary, count binary, vocabulary double, train double"


def _score(roots: int, hot: np.ndarray):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        own, random = _local(rows, shard)
        root = _shard(mix(own.words), roots).astype(np.int64)
        dealt = np.flatnonzero(np.isin(own.contexts, hot))
        dealt_root = _shard(mix(own.contexts[dealt]), roots).astype(np.int64)
        guests, seats, count = (np.zeros(len(own.words), dtype=np.int64) for _ in range(3))
        mine, totals = own._by_context(own.tables), np.zeros(4)
        for row in answers.to_pylist():
            a, b = root == row["root"], dealt[dealt_root == row["root"]]
            for values, name in ((guests, "tables"), (seats, "seats"), (count, "count")):
                values[a] = _numbers(row[name], int(a.sum()))
            own.more_tables[b] = np.frombuffer(row["hot_tables"], dtype=np.int64) - mine[b]
            own.guests[b] = np.frombuffer(row["hot_guests"], dtype=np.int64)
            totals += row["totals"]
        vocabulary, train, all_guests, all_seats = totals
        rest = (STRENGTH[0] + DISCOUNT[0] * all_seats) / (vocabulary + 1)
        parent = (np.maximum(guests - DISCOUNT[0] * seats, 0) + rest) / (STRENGTH[0] + all_guests)
        mean = np.zeros(len(own.count))
        for k in range(BURN_IN + SAMPLES):
            own.sweep(parent, random)
            if k >= BURN_IN:
                mean += own.predictive(parent)
        steps = np.rint(-SCORE_STEPS * np.log10(mean / SAMPLES)).astype(np.int64)
        count = count[own.dish]
        out, i = [], 0
        for block, docs, many, n, times, text in own.blocks:
            entry = own.entry[i : i + n]
            i += n
            out.append((block, shard, docs, many, n, times, text, _small(steps[entry]), _small(count[entry]), vocabulary, train))
        return _table(out, SCORES)

    return run


OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _of_block(held_out: tuple[int, int]):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["shard"])
        ids = np.frombuffer(next(r["docs"] for r in rows if r["docs"] is not None), dtype=np.int64)
        score, base, known, tokens = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for r in rows:
            times, count = _numbers(r["times"], r["pairs"]), _numbers(r["count"], r["pairs"])
            text = _numbers(r["text"], int(times.sum()))
            add = lambda values: np.bincount(text, weights=np.repeat(values, times), minlength=len(ids))  # noqa: B023, E731
            score -= add(_numbers(r["score"], r["pairs"]) / SCORE_STEPS)
            base += add(np.log10(count + 0.5))
            known += add(count > 0).astype(np.int64)
            tokens += np.bincount(text, minlength=len(ids))
        vocabulary, train = rows[0]["vocabulary"], rows[0]["train"]
        base -= tokens * np.log10(train + 0.5 * (vocabulary + 1))
        held = crc_mod(ids, held_out[0]) == held_out[1]
        values = [ids, held, tokens, known, np.full(len(ids), int(train)), base, score]
        return pa.table({f.split()[0]: pa.array(v) for f, v in zip(OUT.split(", "), values, strict=True)})

    return run


def perplexity_scores(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are the words of the text, with A-Z in lower case, and one end; a null
    or empty text is one end.  Documents whose crc32(doc_id) modulo held_out[0] is
    held_out[1] are scored, but not learned from.  score is the sum of log10 of
    the averaged predictive probabilities, base_score that of smoothed word
    frequencies.  Repeated rows are learned from and scored each; rows without a
    doc_id are left out; other columns are ignored.  Runs agree.
    """
    docs = workers_ready(docs).select("doc_id", "text").filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    most = min(HOT, 4 * shards)
    blocks = docs.mapInArrow(_frequent(most), "total boolean, context bigint, n bigint")
    seen = saved(blocks.groupBy("total", "context").agg(F.sum("n").alias("n")), "frequent")
    everything = seen.filter("total").agg(F.sum("n")).first()[0] or 0
    hot_rows = seen.filter(~F.col("total") & (F.col("n") * most >= everything)).collect()  # at most HOT rows
    hot = np.array([r.context for r in hot_rows], dtype=np.int64).view(np.uint64)
    roots = max(1, round(shards**0.6))
    pairs = docs.mapInArrow(_pairs(shards, hot, held_out), PAIRS)
    up = pairs.groupBy("shard").applyInArrow(_to_roots(roots, hot), UP)
    down = up.groupBy("root").applyInArrow(_at_root(roots), DOWN)
    scores = pairs.groupBy("shard").cogroup(down.groupBy("shard")).applyInArrow(_score(roots, hot), SCORES)
    return scores.groupBy("block").applyInArrow(_of_block(held_out), OUT)
