"""Constant-time word lookups inside an expression.

A map literal is searched entry by entry, which is too slow for a few thousand
words per token.  ``word_lookup`` spreads the entries over buckets by CRC-32,
so a lookup is one array access and a search among a handful of entries.  It
stays in the JVM and needs no explode, join or shuffle.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_lookup(entries: Mapping[str, object], value_type: str) -> Callable[[Column], Column]:
    """A function word -> value (null when absent) for a small, fixed mapping."""
    n_buckets = max(1, len(entries) // 2)
    buckets: list[dict] = [{} for _ in range(n_buckets)]
    for word, value in entries.items():
        buckets[zlib.crc32(word.encode("utf-8")) % n_buckets][word] = value
    # one JSON literal, folded to an array literal by the optimizer
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{value_type}>>")

    def find(word: Column) -> Column:
        bucket = (F.crc32(word.cast("binary")) % n_buckets).cast("int")
        return F.try_element_at(F.get(table, bucket), word)

    return find
