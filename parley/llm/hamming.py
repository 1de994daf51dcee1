"""Exact k nearest binary codes by incremental multi-index hashing.

Vectors become 64-bit codes: the signs of seeded random projections of the
centred vector.  A code is cut into m segments of about log2(n) bits.  Two codes
within distance m * (s + 1) - 1 agree on some segment up to s bits, so after all
segment values within s of a query's were looked up, its k best are certain as
soon as the k-th verified distance is at most m * (s + 1) - 1.  Rounds grow s;
queries that are certain leave.

The index is spread over blocks by segment and hash of the segment value, large
ones cut further, so that each task holds a bounded number of rows; a query goes
to the blocks that own one of its probes.  Equal codes are one index row and one
query, so a vector that fills a third of the table is looked up once.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import column, saved, workers_ready
from parley.llm.words import mix

BITS = 64
BLOCK = 16_384
QUERIES = 100_000  # of a block, per task
EVERY = 20


def _encode(mean: np.ndarray):
    turn = np.random.default_rng(64).standard_normal((len(mean), BITS))

    def run(batches):
        for batch in batches:
            vectors = column(batch, "embedding")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)).astype(np.float64)
            codes = np.packbits((np.nan_to_num(x) - mean) @ turn > 0, axis=1).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes)], names=["vec_id", "code"])

    return run


def binary_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code) of the vectors of the commonest length.

    Null vectors and those of another length have no code; a null or NaN element
    counts as 0.  The centre is the mean over all vectors.
    """
    vectors = workers_ready(vectors).select("vec_id", "embedding").filter("vec_id is not null and embedding is not null")
    sizes = vectors.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None or sizes.n < 1:
        return vectors.select("vec_id", F.lit(0).cast("bigint").alias("code")).limit(0)
    clean = vectors.filter(F.size("embedding") == sizes.n).select(
        "vec_id", F.transform("embedding", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))).alias("embedding")
    )
    means = clean.agg(*[F.avg(F.col("embedding")[i]) for i in range(sizes.n)]).first()
    return clean.mapInArrow(_encode(np.array(means, dtype=np.float64)), "vec_id bigint, code bigint")


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment for an index of n codes."""
    bits = min(16, max(4, round(math.log2(max(n, 2)))))
    m = -(-BITS // bits)
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``radius`` ones."""
    return np.array([sum(1 << b for b in ones) for ones in combinations(range(bits), radius)], dtype=np.int64)


def _values(codes: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _owner(values: np.ndarray, parts: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _spread(cuts: list[tuple[int, int]], parts: int):
    """Index rows: each code under every segment."""

    def run(batches):
        for batch in batches:
            codes = column(batch, "code").to_numpy()
            for i, (shift, bits) in enumerate(cuts):
                own = _owner(_values(codes, shift, bits), parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), i)), pa.array(own), pa.array(codes)], names=["segment", "part", "code"])

    return run


def _probes(cuts: list[tuple[int, int]], parts: int, radius: int):
    """The blocks that own a probe of a query at this radius."""

    def run(batches):
        for batch in batches:
            codes, bound = column(batch, "query").to_numpy(), column(batch, "bound")
            for i, (shift, bits) in enumerate(cuts):
                if radius > bits:
                    continue
                masks, values = _masks(bits, radius), _values(codes, shift, bits)
                query, part = [], []
                for k, v in enumerate(values.tolist()):
                    own = np.arange(parts) if len(masks) > 8 * parts else np.unique(_owner(masks ^ v, parts))
                    query.append(np.full(len(own), k))
                    part.append(own)
                rows = np.concatenate(query) if query else np.zeros(0, np.int64)
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i)), pa.array(np.concatenate(part)), pa.array(codes[rows]), bound.take(pa.array(rows))],
                        names=["segment", "part", "query", "bound"],
                    )

    return run


FOUND = "query bigint, code bigint, distance int"


def _look_up(cuts: list[tuple[int, int]], radius: int, k: int):
    """Verified codes of one block that can be among a query's k best."""

    def run(key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "code": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
        if not index.num_rows or not queries.num_rows:
            return empty
        shift, bits = cuts[key[0].as_py()]
        codes = column(index, "code").to_numpy()
        values = _values(codes, shift, bits)
        order = np.argsort(values, kind="stable")
        codes = codes[order]
        at = np.searchsorted(values[order], np.arange((1 << bits) + 1))
        masks = _masks(bits, radius)
        asked, bound = column(queries, "query").to_numpy(), column(queries, "bound").to_numpy()
        out = []
        for query, limit, value in zip(asked, bound, _values(asked, shift, bits).tolist(), strict=True):
            probe = masks ^ value
            begin, n = at[probe], at[probe + 1] - at[probe]
            full = np.flatnonzero(n)
            if not len(full):
                continue
            begin, n = begin[full], n[full]
            rows = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
            distance = np.bitwise_count((codes[rows] ^ query).view(np.uint64))  # signed numbers count their absolute value
            good = np.flatnonzero(distance <= limit)
            if len(good) > k:
                nearest = np.lexsort((codes[rows[good]], distance[good]))[:k]
                worst = distance[good[nearest[-1]]]
                good = good[distance[good] <= worst]  # ties are decided by id, later
            out.append((np.full(len(good), query), codes[rows[good]], distance[good].astype(np.int32)))
        if not out:
            return empty
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out])) for i, n in enumerate(("query", "code", "distance"))})

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = EVERY, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k vectors with the nearest codes to
    each vector whose vec_id is divisible by ``every``, itself excepted.

    Equally near vectors go by vec_id.  With fewer than k others, all are given.
    Repeated rows of one vec_id count once; other columns are ignored.
    """
    rows = saved(binary_codes(vectors).distinct(), "codes")
    first = Window.partitionBy("code").orderBy("vec_id")
    ids = saved(rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1), "code-ids")
    codes = saved(ids.filter("place = 1").select("code"), "distinct-codes")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n = codes.count()
    state = saved(asked.select(F.col("code").alias("query")).distinct().withColumn("bound", F.lit(BITS)), "queries")
    cuts = segments(n)
    m, parts = len(cuts), max(1, n // block)
    index = saved(codes.mapInArrow(_spread(cuts, parts), "segment bigint, part bigint, code bigint"), "index")
    counts = index.groupBy("segment", "part").agg(F.ceil(F.count(F.lit(1)) / (2 * block)).cast("int").alias("chunks"))
    counts = saved(counts, "index-sizes")
    chunk = F.pmod(F.xxhash64("code"), F.col("chunks")).cast("int").alias("chunk")
    place = ["segment", "part", "chunk", "side"]
    found = None
    done = []
    for radius in range(max(bits for _, bits in cuts) + 1):
        probes = state.mapInArrow(_probes(cuts, parts, radius), "segment bigint, part bigint, query bigint, bound int")
        probes = saved(probes, "probes")
        # only blocks that are asked take part, and only those asked very often are copied
        asked_of = probes.groupBy("segment", "part").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("sides"))
        asked_of = saved(asked_of.join(counts, ["segment", "part"]), "asked-blocks")
        blocks = index.join(asked_of, ["segment", "part"]).select(
            "segment", "part", chunk, "code", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side")
        )
        probes = probes.join(asked_of, ["segment", "part"]).select(
            "segment", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.pmod(F.xxhash64("query"), F.col("sides")).cast("int").alias("side"), "query", "bound",
        )
        new = blocks.groupBy(*place).cogroup(probes.groupBy(*place)).applyInArrow(_look_up(cuts, radius, k + 1), FOUND)
        best = new if found is None else found.join(state.select("query"), "query").union(new)
        order = Window.partitionBy("query").orderBy("distance")
        kept = best.distinct().withColumn("r", F.rank().over(order)).filter(F.col("r") <= k + 1).select("query", "code", "distance")
        found = saved(kept, "found")
        sizes = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
        state = state.join(sizes, "query", "left").select(
            "query", F.when(F.col("n") > k, F.col("far")).otherwise(F.lit(BITS)).cast("int").alias("bound"), F.coalesce("n", F.lit(0)).alias("n")
        )
        certain = (F.col("n") > k) & (F.col("bound") <= m * (radius + 1) - 1)
        state = saved(state.withColumn("certain", certain), "queries")
        done.append(found.join(state.filter("certain").select("query"), "query"))
        open_ = state.filter(~F.col("certain")).select("query", "bound")
        if open_.isEmpty():
            break
        state = saved(open_, "queries")
    else:
        done.append(found.join(state.select("query"), "query"))
    result = done[0]
    for more in done[1:]:
        result = result.union(more)
    pairs = (
        asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
        .join(result, "query")
        .join(ids.select("code", "vec_id"), "code")
        .filter("vec_id <> query_id")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return pairs.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("bigint").alias("distance"))
