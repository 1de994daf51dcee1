"""Near-duplicate join of word-shingle sets by the chosen-path method.

1. Each text becomes its set of hashed shingles.  Texts with equal sets are one
   class; the rest works on one representative per class.
2. A sketch of ``SKETCH`` min-wise values per set gives the tokens of the
   chosen-path recursion.  In a node, a set follows each token whose hash,
   seeded by the path, lies below SPREAD / (threshold * SKETCH), so that similar
   sets go on together for more than one child on average.  Sets alone in a
   node drop out; nodes of at most ``limit`` sets are compared by brute force
   on the sketches.  In a larger node every set is compared with a few pivots.
   Sets alike to one pivot are connected through it; where they are all but
   ``limit`` sets of the node, they are compared with those others, block by
   block, and the node is done, so that near copies, which no split separates,
   do not go down together.  The remaining nodes are split again; after
   ``MAX_DEPTH`` levels what is left is compared block by block.  Runs are
   repeated until a pair at the threshold is met with probability ``recall``
   even at ``MAX_DEPTH``.
3. Candidates only say which sets to read: connected candidates are compared
   exactly, all with all, in blocks.  Tasks give the number of links of each
   set and a spanning forest, never the pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import Forest, column, components, grouped, saved, workers_ready
from parley.llm.words import Words, mix, parts, rolling

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
SKETCH = 64
SPREAD = 1.15  # children per node that two sets at the threshold share on average
LIMIT = 1024
BLOCK = 512
MAX_DEPTH = 6
PIVOTS = 4

_random = np.random.default_rng(20240)
_FACTOR = _random.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _random.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)


def _agreeing(threshold: float) -> list[float]:
    """Probability that so many sketch values of two sets at the threshold agree."""
    return [math.comb(SKETCH, x) * threshold**x * (1 - threshold) ** (SKETCH - x) for x in range(SKETCH + 1)]


def least_agreeing(recall: float, threshold: float = THRESHOLD) -> int:
    """Sketch values that candidates share at least: half of what may be missed lies below."""
    lost, x = 0.0, 0
    for x, odds in enumerate(_agreeing(threshold)):
        lost += odds
        if lost > (1 - recall) / 2:
            break
    return x


def runs_for(recall: float, depth: int = MAX_DEPTH, threshold: float = THRESHOLD) -> int:
    """Runs after which a pair at the threshold was met with this probability.

    Two sets of which x sketch values agree share s = SPREAD * x / (threshold *
    SKETCH) children per node on average (Poisson), so they are still together
    after d levels with probability p(d), where p(0) = 1 and
    p(d) = 1 - exp(-s * p(d - 1)).  All runs share the sketch, so what is missed
    is averaged over x after the runs; pairs below ``least_agreeing`` are missed.
    """
    least = least_agreeing(recall, threshold)
    odds = _agreeing(threshold)
    apart = []
    for x in range(least, SKETCH + 1):
        p = 1.0
        for _ in range(depth):
            p = 1 - math.exp(-SPREAD * x / (threshold * SKETCH) * p)
        apart.append(1 - p)
    runs = 1
    while sum(odds[:least]) + sum(o * q**runs for o, q in zip(odds[least:], apart, strict=True)) > 1 - recall:
        runs += 1
    return runs


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted per text, and where each text's begin.
    A text of fewer words than a shingle has one shingle: all its words."""
    words = Words(texts)
    first = words.first
    rolled = rolling(words.hash, size)
    sets = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= size:
            sets.append(np.unique(rolled[i : j - size + 1]))
        elif j > i:
            sets.append(mix(rolling(words.hash[i:j], j - i) + np.uint64(j - i)))
        else:
            sets.append(np.zeros(0, np.uint64))
    at = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at


def _reduce(function, values, at):
    """function.reduceat over at[:-1], 0 for empty stretches."""
    out = np.zeros(len(at) - 1, dtype=values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = function.reduceat(values, at[full])
    return out


def _sketches(size: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                values, at = shingle_sets(column(part, "text"), size)
                one = _reduce(np.add, mix(values), at)
                two = _reduce(np.bitwise_xor, mix(values + np.uint64(0x5851F42D4C957F2D)), at)
                low = (values >> np.uint64(32)).astype(np.uint32)
                sketch = np.stack([_reduce(np.minimum, low * a + b, at) for a, b in zip(_FACTOR, _SHIFT, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(at)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        pa.array([row.tobytes() for row in sketch], pa.binary()),
                    ],
                    names=["doc_id", "size", "one", "two", "sketch"],
                )

    return run


def _sketch_matrix(sketches: list[bytes], width: int = SKETCH) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint32).reshape(len(sketches), width)


def _tokens(sketch: np.ndarray) -> np.ndarray:
    return mix((np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)) | sketch.astype(np.uint64))


def _children(tokens: np.ndarray, paths: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Row and path of each chosen child; ``paths`` has one entry per row of tokens."""
    hashes = mix(tokens ^ paths[:, None])
    row, col = np.nonzero(hashes < limit)
    return row, mix(hashes[row, col] + paths[row])


def _roots(runs: int, threshold: float):
    limit = np.uint64(min(int((1 << 64) * SPREAD / (threshold * SKETCH)), (1 << 64) - 1))
    seeds = mix(np.arange(1, runs + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                tokens = _tokens(_sketch_matrix(column(part, "sketch").to_pylist()))
                for seed in seeds:
                    row, path = _children(tokens, np.full(len(tokens), seed), limit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path.view(np.int64)), column(part, "rep").take(pa.array(row))], names=["path", "rep"]
                    )

    return run


def _deeper(threshold: float):
    limit = np.uint64(min(int((1 << 64) * SPREAD / (threshold * SKETCH)), (1 << 64) - 1))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                tokens = _tokens(_sketch_matrix(column(part, "sketch").to_pylist()))
                above = column(part, "path").to_numpy().view(np.uint64)
                row, path = _children(tokens, above, limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), column(part, "rep").take(pa.array(row))], names=["path", "rep"]
                )

    return run


def _marked(least: int):
    """Which pivots of its node (column ``pivots``, their sketches) each set is a candidate for, as bits."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                own = _sketch_matrix(column(part, "sketch").to_pylist())
                pivots = _sketch_matrix(column(part, "pivots").to_pylist(), PIVOTS * SKETCH).reshape(-1, PIVOTS, SKETCH)
                alike = (pivots == own[:, None, :]).sum(axis=2) >= least
                bits = (alike << np.arange(PIVOTS)).sum(axis=1)
                arrays = [column(part, "path"), column(part, "rep"), column(part, "sketch"), pa.array(bits.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "rep", "sketch", "alike"])

    return run


def _brute_force(least: int):
    """Candidate links of each bucket, as a spanning forest; what is connected
    already (``joined``, or by a link found here) is not compared again."""

    def run(batches):
        a, b = [], []
        for _, (reps, sketches, joined) in grouped(batches, "bucket", "rep", "sketch", "joined"):
            if len(reps) > 1:
                sketch, part = _sketch_matrix(sketches), np.arange(len(reps))
                together = np.flatnonzero(joined)
                part[together] = together[:1]
                for i in range(len(reps) - 1):
                    other = np.flatnonzero(part[i + 1 :] != part[i]) + i + 1
                    near = other[(sketch[other] == sketch[i]).sum(axis=1) >= least]
                    if len(near):
                        parts_, at = np.unique(part[near], return_index=True)
                        a += [reps[i]] * len(parts_)
                        b += [reps[j] for j in near[at].tolist()]
                        part[np.isin(part, parts_)] = part[i]
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, key: str, rep: str, block: int, *keep: str) -> DataFrame:
    """Give each row the bucket of every pair of blocks its own block is in.

    ``members`` is the number of rows of the key.  A key of up to ``block`` rows
    is one bucket.  ``bucket`` is a hash; rows of other keys that fall into the
    same one only cost time, as links are always checked.
    """
    n = F.ceil(F.col("members") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(rep, F.lit(7)), n).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"))))
    split = rows.select(key, rep, own.alias("own"), pairs.alias("pair"), *keep)
    return split.withColumn("bucket", F.xxhash64(key, "pair.x", "pair.y"))


def _dense(large: DataFrame, least: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Large nodes (path, rep, sketch) that one pivot connects but for ``limit``
    sets: links to the pivot and buckets that compare its sets with the others.
    The rows of all other nodes come third."""
    chosen = [F.min(F.struct(F.xxhash64(F.lit(k), "rep").alias("order"), "rep", "sketch")).alias(f"p{k}") for k in range(PIVOTS)]
    pivots = saved(large.groupBy("path").agg(*chosen), "pivots")
    packed = pivots.select("path", F.concat(*[f"p{k}.sketch" for k in range(PIVOTS)]).alias("pivots"))
    kind = "path bigint, rep bigint, sketch binary, alike int"
    marked = saved(large.select("path", "rep", "sketch").join(packed, "path").mapInArrow(_marked(least), kind), "marked")

    counts = [F.count_if(F.col("alike").bitwiseAND(1 << k) != 0).alias(f"n{k}") for k in range(PIVOTS)]
    met = marked.groupBy("path").agg(F.count(F.lit(1)).alias("members"), *counts)
    best = F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("k")) for k in range(PIVOTS)])
    met = met.select("path", "members", best.alias("best")).join(pivots, "path")
    pivot = F.element_at(F.array(*[f"p{k}.rep" for k in range(PIVOTS)]), F.col("best.k") + 1)
    nodes = met.select("path", (F.col("members") - F.col("best.n")).alias("others"), F.col("best.n").alias("n"), F.col("best.k").alias("k"), pivot.alias("pivot"))
    rows = saved(marked.join(nodes, "path"), "large-nodes")

    done = rows.filter(F.col("others") <= limit).withColumn("joined", F.expr("alike & shiftleft(1, k)") != 0)
    links = done.filter("joined and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    own = F.array(F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int"))
    block = F.explode(F.when(F.col("joined"), own).otherwise(F.sequence(F.lit(0), blocks - 1)))
    dealt = done.filter("others > 0").select("path", "rep", "sketch", "joined", block.alias("block"))
    buckets = dealt.select(F.xxhash64("path", "block").alias("bucket"), "rep", "sketch", "joined")
    return links, buckets, rows.filter(F.col("others") > limit).select("path", "rep", "sketch", (F.col("n") + F.col("others")).alias("members"))


def _candidates(reps: DataFrame, threshold: float, recall: float, limit: int) -> DataFrame:
    sketches, least = reps.select("rep", "sketch"), least_agreeing(recall, threshold)
    nodes = sketches.mapInArrow(_roots(runs_for(recall, threshold=threshold), threshold), "path bigint, rep bigint")
    found = None
    for depth in range(1, MAX_DEPTH + 1):
        nodes = saved(nodes, "paths")
        counts = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        shared = saved(nodes.join(counts, "path"), "shared-paths")
        alone = F.lit(False).alias("joined")
        buckets = shared.filter(F.col("members") <= limit).join(sketches, "rep").select(F.col("path").alias("bucket"), "rep", "sketch", alone)
        large = shared.filter(F.col("members") > limit)
        large = None if large.isEmpty() else saved(large.join(sketches, "rep"), "large")
        if large is not None:
            links, more, large = _dense(large, least, limit)
            found = links if found is None else found.union(links)
            buckets = buckets.union(more)
            large = None if large.isEmpty() else large
        if large is not None and depth == MAX_DEPTH:
            rest = _in_blocks(large, "path", "rep", limit, "sketch")
            buckets, large = buckets.union(rest.select("bucket", "rep", "sketch", alone)), None
        links = buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_brute_force(least), "a bigint, b bigint")
        found = links if found is None else found.union(links)
        if large is None:
            return found
        nodes = large.select("path", "rep", "sketch").mapInArrow(_deeper(threshold), "path bigint, rep bigint")
    return found


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                values, at = shingle_sets(column(part, "text"), size)
                packed = [values[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                arrays = [part.column(c) for c in ("root", "rep", "copies", "members")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(packed, pa.binary())], names=["root", "rep", "copies", "members", "shingles"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices."""
    sets = [*left, *right]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    number = np.cumsum(fresh) - 1
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], number[often]
    if not len(number):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(number[-1]) + 1, width):
        i, j = np.searchsorted(number, (at, at + width))
        ones = np.zeros((len(sets), min(width, int(number[-1]) + 1 - at)), dtype=np.float32)
        ones[owner[i:j], number[i:j] - at] = 1
        out += ones[: len(left)] @ ones[len(left) :].T
    return np.rint(out).astype(np.int64)


def _verify(threshold: float):
    exact = Fraction(str(threshold))

    def linked(left, right):
        both = shared_counts(left, right)
        sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
        return both * exact.denominator >= exact.numerator * (sizes - both)

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for _, (own, x, y, reps, copies, packed) in grouped(batches, "bucket", "own", "x", "y", "rep", "copies", "shingles"):
            sets = [np.frombuffer(p, dtype=np.uint64) for p in packed]
            left = [i for i in range(len(reps)) if own[i] == x[0]]
            right = left if x[0] == y[0] else [i for i in range(len(reps)) if own[i] != x[0]]
            if not left or not right:
                continue
            links = linked([sets[i] for i in left], [sets[i] for i in right])
            if left is right:
                np.fill_diagonal(links, False)
            weight = np.array(copies, dtype=np.int64)
            sums, forest = np.zeros(len(reps), dtype=np.int64), Forest(len(reps))
            sums[left] += links @ weight[right]
            if left is not right:
                sums[right] += links.T @ weight[left]
            for i, row in zip(left, links, strict=True):
                for j in np.flatnonzero(row).tolist():
                    forest.join(i, right[j])
            out.extend((reps[i], int(sums[i]), reps[forest.find(i)]) for i in range(len(reps)) if sums[i])
            if len(out) > 50_000:
                yield _link_rows(out)
                out = []
        yield _link_rows(out)

    return run


def _link_rows(rows) -> pa.RecordBatch:
    names = ["rep", "links", "near"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=names)


def jaccard_links(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    recall: float = RECALL,
    limit: int = LIMIT,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, class_id, n_links) of every document.

    n_links counts the other documents whose shingle sets have a Jaccard
    similarity of at least ``threshold``, copies included; class_id is the least
    doc_id that is connected by such links.  Null and empty texts have no
    shingles: each is its own class without links.  A text of fewer than
    ``shingle`` words is one shingle.  Words are compared as they are; doc_id
    must be unique, rows without one are left out; other columns are ignored.
    """
    docs = workers_ready(docs).select("doc_id", "text").filter("doc_id is not null")
    sketches = saved(
        docs.mapInArrow(_sketches(shingle), "doc_id bigint, size bigint, one bigint, two bigint, sketch binary"), "sketches"
    )
    same = ["one", "two", "size"]
    reps = saved(
        sketches.filter("size > 0")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("sketch").alias("sketch")),
        "representatives",
    )
    candidates = components(_candidates(reps, threshold, recall, limit))
    sizes = candidates.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    chosen = (
        candidates.join(sizes, "root")
        .withColumnRenamed("node", "rep")
        .join(reps.select("rep", "copies"), "rep")
    )
    texts = chosen.join(docs.withColumnRenamed("doc_id", "rep"), "rep")
    sets = texts.mapInArrow(_sets(shingle), "root bigint, rep bigint, copies bigint, members bigint, shingles binary")
    blocks = _in_blocks(sets, "root", "rep", block, "copies", "shingles").select(
        "bucket", "rep", "copies", "shingles", "own", F.col("pair.x").alias("x"), F.col("pair.y").alias("y")
    )
    verified = saved(
        blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_verify(threshold), "rep bigint, links bigint, near bigint"),
        "verified",
    )
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("rep").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "rep")
    by_rep = reps.select(*same, "rep", "copies").join(links, "rep", "left").join(classes, "rep", "left")
    out = sketches.select("doc_id", *same).join(by_rep, same, "left")
    return out.select(
        "doc_id",
        F.coalesce("root", "rep", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that are the least of their class; rows without a doc_id stay.
    Rows that repeat a doc_id stay or go together."""
    classes = jaccard_links(docs, **options)
    gone = classes.filter("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
