"""Helpers the operators share: tables, scratch tables, connected components."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import saved, ship_package

#: One word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_ready(df: DataFrame) -> DataFrame:
    """Make sure that Python workers can import this package."""
    ship_package(df.sparkSession)
    return df


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(n))


def crc_mod(keys: np.ndarray, n: int) -> np.ndarray:
    return np.array([zlib.crc32(str(k).encode()) % n for k in keys.tolist()], dtype=np.int64)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    found = batch.column(name)
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def grouped(batches, key: str, *names: str):
    """Runs of equal keys in batches sorted by ``key``: (key, one list per name).

    A run may span batches.  Only one run is held at a time.
    """
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy(zero_copy_only=False)
        lists = [column(batch, name).to_pylist() for name in names]
        edges = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for i, j in zip([0, *edges], [*edges, len(keys)], strict=True):
            if held is not None and keys[i] == last:
                for own, new in zip(held, lists, strict=True):
                    own.extend(new[i:j])
                continue
            if held is not None:
                yield last, held
            last, held = keys[i], [new[i:j] for new in lists]
    if held is not None:
        yield last, held


class Forest:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root the least node.

    Alternating large and small stars: each round hangs every node below the
    least node that it or its neighbours know, so that few rounds are needed.
    Every round is written to the shared folder.  Nothing is collected; a node
    with very many neighbours only meets its own minimum, so that a skewed join
    can be split.
    """
    now = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b")
        now = saved(star.distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
