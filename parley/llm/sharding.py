"""Placement of rows on shards through a permutation-filled lookup table.

Each shard has its own preference order of the table's slots, a permutation
offset + k * skip modulo the prime table size.  Shards take turns; at its turn a
shard claims the first slot of its order that is still free.  Every shard ends
with the same number of slots, give or take one, and when a shard is added or
removed few slots change hands.  The table has a fixed size, so it is broadcast,
and a row finds its shard by hashing its key to a slot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 128


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    names = list(shards)
    if not names or len(set(names)) != len(names):
        raise ValueError("shards must have different names, and at least one is needed")
    if not _is_prime(slots) or slots < len(names):
        raise ValueError("the number of slots must be a prime not below the number of shards")
    steps = []
    for name in names:
        digest = hashlib.blake2b(name.encode("utf-8"), digest_size=16).digest()
        offset = int.from_bytes(digest[:8], "big") % slots
        steps.append((offset, int.from_bytes(digest[8:], "big") % (slots - 1) + 1 if slots > 2 else 1))
    at = [offset for offset, _ in steps]
    table = [-1] * slots
    free = slots
    while free:
        for i, (_, skip) in enumerate(steps):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip) % slots
            table[slot] = i
            at[i] = (slot + skip) % slots
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text modulo the table size."""
    digits = F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def placed(docs: DataFrame, shards: Sequence[str] | None = None, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """All rows with their ``slot`` and ``shard``.

    Rows with equal keys go to the same shard; a null key counts as empty text.
    Columns of the same names are replaced; nothing else changes.  The table is
    broadcast: it has ``slots`` rows, however large the input is.
    """
    names = list(shards) if shards is not None else shard_names(SHARDS)
    owners = fill_table(names, slots)
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, names[o]) for i, o in enumerate(owners)], "slot int, shard string")
    rows = docs.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    return rows.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")
