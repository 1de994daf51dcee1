"""Exact removal of equal texts against an indexed history, by minimal perfect hashing.

The distinct digests of the history are dealt to shards by their first bytes.
Each shard is one row of the index: a minimal perfect hash over its digests
(levels of bit arrays; a digest belongs to the first level where no other
digest shares its bit, and its slot is the rank of that bit) and, slot by slot,
the full digest and the locator of the text that stays.  Every digest that is
looked up hits some slot, so all its bytes are compared there: equal ones are
members and repeat a text of the history, the others are grouped on their own.

Digests are even, so shards are too, whatever the texts.  Equal texts are
aggregated before anything is shuffled by their digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import remainder, saved, workers_ready
from parley.llm.words import mix

#: Digests of one shard of the index, about: 50 bytes each in memory.
SHARD = 1 << 15
#: Bits of a level for each digest that reaches it.
GAMMA = 2.0
BYTES = 32
#: A group of more than this part of all rows is hot.  There are at most so many, which bounds what is broadcast.
HOT_PART = 4096

_SPACES = " \t\n\x0b\x0c\r"
_INDEX = "shard bigint, sizes array<bigint>, bits binary, digests binary, ids array<bigint>, lengths array<bigint>, counts array<bigint>"


def _hashes(digests: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit hash per row of an (n, 4) array of 64-bit words, for a level."""
    out = np.full(len(digests), level + 1, dtype=np.uint64)
    for word in digests.T:
        out = mix(out ^ word) + np.uint64(level)
    return out


def build(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, one after the other, of distinct rows (n, 4)."""
    left, sizes, bits = digests, [], []
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        at = (_hashes(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at]]
        if len(sizes) > 1000:
            raise RuntimeError("digests of a shard are not distinct")
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each row: a bijection for the rows that were built on; -1 or any slot for others."""
    rank = np.cumsum(bits) - 1
    out = np.full(len(digests), -1, dtype=np.int64)
    open_, start = np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = start + (_hashes(digests[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, start = open_[~hit], start + size
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BYTES // 8)


def _build_shard(group: pa.Table) -> pa.Table:
    digests = _rows(group["digest"])
    sizes, bits = build(digests)
    order = np.argsort(slots(digests, sizes, bits))
    row = {
        "shard": group["shard"][0].as_py(),
        "sizes": sizes,
        "bits": np.packbits(bits).tobytes(),
        "digests": digests[order].tobytes(),
        "ids": group["id"].take(pa.array(order)).to_pylist(),
        "lengths": group["length"].to_numpy()[order].tolist(),
        "counts": group["n"].to_numpy()[order].tolist(),
    }
    types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    return pa.table([pa.array([row[k]], t) for k, t in zip(row, types, strict=True)], names=list(row))


def _lookup(asked: pa.Table, index: pa.Table) -> pa.Table:
    """Adds to each asked group what the history holds of the same digest, byte for byte."""
    n = asked.num_rows
    slot = np.full(n, -1, dtype=np.int64)
    ids = lengths = counts = pa.nulls(n, pa.int64())
    if n and index.num_rows:
        shard = {name: index[name][0].as_py() for name in index.column_names}
        digests = _rows(asked["digest"])
        bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8), count=sum(shard["sizes"])).astype(bool)
        held = np.frombuffer(shard["digests"], dtype=np.uint64).reshape(-1, BYTES // 8)
        slot = slots(digests, shard["sizes"], bits)
        same = slot >= 0
        same[same] = (held[slot[same]] == digests[same]).all(axis=1)
        take = pa.array(slot, mask=~same)
        ids, lengths, counts = (pa.array(shard[k], pa.int64()).take(take) for k in ("ids", "lengths", "counts"))
    columns = [asked["digest"], asked["id"], asked["length"], asked["n"], ids, lengths, counts]
    return pa.table(columns, names=["digest", "id", "length", "n", "old_id", "old_length", "old_n"])


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _SPACES, "")


def digested(docs: DataFrame) -> DataFrame:
    """(id, digest, length, text_sha256) of each document: rows that repeat a doc_id
    with an equal text are one document, of their greatest length."""
    hexed = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("length"), F.unhex(hexed).alias("digest"))
    return rows.groupBy("id", "digest").agg(F.max("length").alias("length"))


def _winner() -> Column:
    """The longest, then the least id (null last)."""
    return F.min(F.struct((-F.col("length")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))


def _groups(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("digest").agg(_winner().alias("best"), F.count(F.lit(1)).alias("n"))
    return best.select("digest", F.col("best.id").alias("id"), (-F.col("best.short")).alias("length"), "n")


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    """The first seven bytes of the digest say which shard it belongs to."""
    first = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint")
    return groups.withColumn("shard", F.pmod(first, F.lit(shards).cast("bigint")))


def history_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index of groups (digest, id, length, n) with distinct digests: one row per shard."""
    return _sharded(workers_ready(groups), shards).groupBy("shard").applyInArrow(_build_shard, _INDEX)


def looked_up(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """Groups with old_id, old_length and old_n of the history, null where its index has no equal digest."""
    asked = _sharded(workers_ready(groups), shards).groupBy("shard").cogroup(index.groupBy("shard"))
    return asked.applyInArrow(_lookup, "digest binary, id bigint, length bigint, n bigint, old_id bigint, old_length bigint, old_n bigint")


def shards_for(n: int, per_shard: int = SHARD) -> int:
    return max(1, -(-n // per_shard))


def deduplicated(docs: DataFrame, historical: Column | None = None, per_shard: int = SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each document.

    Texts are equal if they are the same without ASCII white space; null counts
    as empty.  Of equal texts the one with the most code points, white space
    included, stays, then the least doc_id.  ``historical`` marks the rows that
    the index is built from (a third, by a hash of doc_id, unless given); which
    they are does not change the result.  A null doc_id is a value of its own
    that loses every tie; rows that repeat a doc_id with an equal text are one
    document and give one row, a doc_id with different texts gives one row for
    each.  An empty table gives no rows; other columns are ignored.
    """
    old = F.coalesce((remainder(F.col("id"), 3) == 0) if historical is None else F.col("old"), F.lit(False))
    rows = digested(docs) if historical is None else _marked(docs, historical)
    rows = saved(rows.withColumn("old", old), "digests")
    history = saved(_groups(rows.filter("old")), "history-groups")
    fresh = saved(_groups(rows.filter("not old")), "fresh-groups")
    shards = shards_for(max(history.count(), fresh.count()), per_shard)
    index = saved(history_index(history, shards), "history-index")
    met = saved(looked_up(fresh, index, shards), "looked-up")
    # a member is settled with what its slot holds; the history keeps what no fresh text repeats
    members = met.filter("old_n is not null")
    better = F.struct((-F.col("length")).alias("short"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    was = F.struct((-F.col("old_length")).alias("short"), F.col("old_id").isNull().alias("none"), F.col("old_id").alias("id"))
    settled = members.select("digest", F.least(better, was).alias("best"), (F.col("n") + F.col("old_n")).alias("n"))
    untouched = history.join(members.select("digest"), "digest", "left_anti")
    alone = met.filter("old_n is null").select("digest", "id", "length", "n").union(untouched)
    final = settled.select("digest", F.col("best.id").alias("keep_id"), "n").union(alone.select("digest", F.col("id").alias("keep_id"), "n"))
    repeated = saved(final.filter("n > 1"), "repeated")
    return _told(rows, repeated)


def _marked(docs: DataFrame, historical: Column) -> DataFrame:
    """Digests with the caller's mark; of rows that are one document, any mark counts for all."""
    length = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    digest = F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), length.alias("length"), digest.alias("digest"), historical.alias("old"))
    return rows.groupBy("id", "digest").agg(F.max("length").alias("length"), F.max("old").alias("old"))


def _told(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Tell every row its group.  Hot groups are few, so they are broadcast; the
    others are small, so a join by the digest is even."""
    hot_bound = F.lit(max(1, rows.count() // HOT_PART))
    hot = repeated.filter(F.col("n") > hot_bound)
    named = rows.join(F.broadcast(hot.select("digest", F.col("keep_id").alias("hot_id"), F.col("n").alias("hot_n"))), "digest", "left")
    rest = named.filter("hot_n is null").join(repeated.filter(F.col("n") <= hot_bound), "digest", "left")
    out = rest.select("id", "digest", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"))
    out = out.union(named.filter("hot_n is not null").select("id", "digest", "hot_id", "hot_n"))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").cast("bigint").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat a doc_id with an equal text, each stays."""
    digest = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    gone = deduplicated(docs, **options).filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (digest == gone["_sha"]), "left_anti")
