"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

1. Each whole text becomes a row of statistics (lengths, shares of character
   classes, repetition of words and lines, word shapes).
2. Standardised statistics go through random Fourier features, cos(w x + b) with
   Gaussian w, whose products approximate a Gaussian kernel.
3. Each partition of the labelled rows sums its normal equations, per fold of
   the key; the sums are added up by Spark, and the driver solves one small
   system.  Its size depends on the number of features alone.
4. Scores of each fold by the model of the other folds are binned and made
   monotone by pooling adjacent violators; the curve turns scores into
   probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import column, crc_mod, remainder, saved, workers_ready
from parley.llm.words import Words, parts

FEATURES = 256
RIDGE = 1e-2
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations of a statistic
FOLDS = 5
BINS = 2000
HELD_OUT = (4, 2)  # crc32(doc_id) mod 4 = 2 is never learned from
ACCEPT = 0.7

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "short_words", "distinct_words",
    "top_word", "repeated_runs", "log_lines", "repeated_lines", "mean_line", "space", "upper", "lower", "digit", "stops",
    "commas", "marks", "symbols", "pipes", "other_ascii", "not_ascii", "control", "capital_words",
    "shouted_words", "marked_words", "lined_words",
]

_CLASS = {
    "space": b" \t\n\r\x0b\x0c",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": bytes(range(48, 58)),
    "stops": b".",
    "commas": b",;:",
    "marks": b"!?",
    "symbols": b"#$%&*@^~+=<>\\/_`",
    "pipes": b"|",
    "other_ascii": b"\"'()-[]{}",
}


def _class_table() -> np.ndarray:
    out = np.full(256, len(_CLASS), dtype=np.int64)  # not ASCII
    out[:128] = len(_CLASS) + 1  # control
    for i, chars in enumerate(_CLASS.values()):
        out[list(chars)] = i
    return out


_BYTE_CLASS = _class_table()
_N_CLASSES = len(_CLASS) + 2


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each stretch, and the count of its commonest."""
    different, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if j > i:
            part = np.sort(hashes[i:j])
            edges = np.flatnonzero(part[1:] != part[:-1])
            different[k] = len(edges) + 1
            most[k] = np.diff(np.concatenate(([-1], edges, [j - i - 1]))).max()
    return different, most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text; a null or empty text gives zeros."""
    words = Words(texts)
    data, ends, first = words.data, words.offsets, words.first
    size = np.diff(ends).astype(np.float64)
    n = np.diff(first).astype(np.float64)
    some, per_word = np.maximum(size, 1), np.maximum(n, 1)
    kinds = _BYTE_CLASS[data]
    owner = np.repeat(np.arange(len(size)), np.diff(ends))
    shares = np.bincount(owner * _N_CLASSES + kinds, minlength=len(size) * _N_CLASSES).reshape(len(size), _N_CLASSES) / some[:, None]
    length = (words.stop - words.start).astype(np.float64)
    mean = _per_text(length, first) / per_word
    spread = np.sqrt(np.maximum(_per_text(length**2, first) / per_word - mean**2, 0))
    different, top = _distinct(words.hash, first)
    pairs = np.zeros(len(words.hash), dtype=bool)
    pairs[1:] = words.hash[1:] == words.hash[:-1]
    pairs[first[:-1][n > 0]] = False  # a text's first word follows nothing
    lines = np.append(data == 10, False)
    line_edges = np.flatnonzero(data == 10)
    n_lines = _per_text(lines[:-1], ends) + (size > 0)
    begin = data[words.start]
    last = data[words.stop - 1] if len(words.stop) else begin
    second = data[np.minimum(words.start + 1, words.stop - 1)] if len(words.start) else begin
    is_upper = lambda x: (x >= 65) & (x <= 90)
    symbol = np.isin(_BYTE_CLASS[last], [list(_CLASS).index("symbols"), list(_CLASS).index("marks")]) if len(last) else last
    piped = begin == 124
    rows = [
        np.log1p(size),
        np.log1p(n),
        mean,
        spread,
        _per_text(length > 12, first) / per_word,
        _per_text(length < 4, first) / per_word,
        different / per_word,
        top / per_word,
        _per_text(pairs, first) / per_word,
        np.log1p(n_lines),
        _repeated_lines(words, line_edges, n_lines),
        np.log1p(size / np.maximum(n_lines, 1)),
        *shares.T,
        _per_text(is_upper(begin), first) / per_word,
        _per_text(is_upper(begin) & is_upper(second) & (length > 1), first) / per_word,
        _per_text(symbol, first) / per_word,
        _per_text(piped, first) / per_word,
    ]
    return np.stack(rows, axis=1)


def _repeated_lines(words: Words, line_edges: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Share of a text's lines that another of its lines repeats, by the sum of their word hashes."""
    if not len(words.hash):
        return np.zeros(len(n_lines))
    edges = np.union1d(np.searchsorted(words.start, line_edges), words.first[:-1])
    edges = edges[edges < len(words.hash)]
    sums = np.add.reduceat(words.hash, edges)
    at = np.searchsorted(edges, words.first)
    different, _ = _distinct(sums, at)
    return (np.diff(at) - different) / np.maximum(np.diff(at), 1)


def _read(batches, run, names, *keep):
    """``run`` over slices of bounded size."""
    for batch in batches:
        for part in parts(batch, "text"):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *run(part)], names=[*keep, *names])


def _statistics(*keep: str):
    def rows(part):
        values = statistics(column(part, "text"))
        flat = pa.array(values.ravel())
        at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), flat)]

    return lambda batches: _read(batches, rows, ["stats"], *keep)


def _matrix(batch, name: str = "stats") -> np.ndarray:
    values = column(batch, name)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(STATISTICS))


class Kernel:
    """Standardisation and random Fourier features; the same on every machine."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float):
        random = np.random.default_rng(zlib.crc32(b"quality"))
        self.mean, self.scale = mean, scale
        self.turn = random.standard_normal((len(mean), features)) / width
        self.shift = random.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        phi = np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack((np.ones((len(z), 1)), z / np.sqrt(len(self.mean)), phi))


def _equations(kernel: Kernel, folds: int):
    """Per fold, the sums X'X and X'y of a partition as one row each."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = kernel(_matrix(batch))
            y = column(batch, "label").to_numpy().astype(np.float64)
            fold = crc_mod(column(batch, "doc_id").to_numpy(), 1 << 30) // 4 % folds
            for k in np.unique(fold):
                xk, yk = x[fold == k], y[fold == k]
                sums[int(k)] = sums.get(int(k), 0) + np.hstack((xk.T @ xk, (xk.T @ yk)[:, None]))
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()])], names=["fold", "sums"])

    return run


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(column(batch, "fold").to_pylist(), column(batch, "sums").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(raw)
    for k, value in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([value.tobytes()])], names=["fold", "sums"])


def _solve(total: np.ndarray, ridge: float) -> np.ndarray:
    n = len(total)
    penalty = np.full(n, ridge * max(total[0, 0], 1) / n)
    penalty[0] = 1e-9
    return np.linalg.solve(total[:, :n] + np.diag(penalty), total[:, n])


def isotonic(position: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: positions in order with their monotone means."""
    blocks: list[list[float]] = []  # weight, weighted sum, first position, last position
    for p, w, m in zip(position.tolist(), weight.tolist(), mean.tolist(), strict=True):
        blocks.append([w, w * m, p, p])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, p2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2], p2]
    x = [p for b in blocks for p in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    y = [b[1] / b[0] for b in blocks for _ in range(2 if b[2] < b[3] else 1)]
    return np.array(x), np.array(y)


def _scored_bins(kernel: Kernel, models: dict[int, np.ndarray], folds: int, bins: int):
    def run(batches):
        for batch in batches:
            x = kernel(_matrix(batch))
            fold = crc_mod(column(batch, "doc_id").to_numpy(), 1 << 30) // 4 % folds
            raw = np.zeros(len(x))
            for k in np.unique(fold):
                raw[fold == k] = x[fold == k] @ models[int(k)]
            yield pa.RecordBatch.from_arrays([pa.array(_bin(raw, bins)), column(batch, "label")], names=["bin", "label"])

    return run


def _bin(raw: np.ndarray, bins: int) -> np.ndarray:
    """Scores around 0 to 1 in equal bins; what lies beyond goes to the first and last."""
    return np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written to the shared folder: texts are read once."""
    rows = workers_ready(docs).select("doc_id", "text").mapInArrow(_statistics("doc_id"), "doc_id bigint, stats array<double>")
    return saved(rows, "statistics")


def fit(
    stats: DataFrame,
    labels: DataFrame,
    features: int = FEATURES,
    ridge: float = RIDGE,
    width: float = WIDTH,
    folds: int = FOLDS,
    bins: int = BINS,
    held_out: tuple[int, int] | None = HELD_OUT,
):
    """A function from statistics to probabilities, learned from the labelled documents.

    stats: as from ``measured``.
    labels: doc_id, quality (0 or 1; other values and nulls are ignored).  The
    driver gets ``folds`` systems of features squared numbers and at most
    ``bins`` sums.  Without any usable label every score is 0.5; a document with
    several labels counts once for each.
    """
    use = labels.filter("quality in (0, 1) and doc_id is not null")
    if held_out:
        use = use.filter(remainder(F.col("doc_id"), held_out[0]) != held_out[1])
    rows = saved(stats.join(use.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id"), "labelled")
    sums = rows.agg(
        F.count(F.lit(1)),
        *[f(F.col("stats")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)],
    ).first()
    if not sums[0]:
        return lambda stats: np.full(len(stats), 0.5)
    mean, scale = np.array(sums[1::2]), np.array(sums[2::2])
    kernel = Kernel(mean, np.where(scale > 1e-9, scale, 1.0), features, width)
    partial = rows.mapInArrow(_equations(kernel, folds), "fold bigint, sums binary")
    for n in (64, 8, 1):  # few numbers in the end: one matrix per fold
        partial = partial.repartition(n).mapInArrow(_added, "fold bigint, sums binary")
    size = 1 + len(STATISTICS) + features
    by_fold: dict[int, np.ndarray] = {}
    for row in partial.collect():
        by_fold[row.fold] = by_fold.get(row.fold, 0) + np.frombuffer(row.sums).reshape(size, size + 1)
    total = sum(by_fold.values())
    model = _solve(total, ridge)
    models = {k: _solve(total - own, ridge) if len(by_fold) > 1 else model for k, own in by_fold.items()}
    found = (
        rows.mapInArrow(_scored_bins(kernel, models, folds, bins), "bin bigint, label double")
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("mean"))
        .orderBy("bin")
        .collect()
    )
    at, level = isotonic(*(np.array([r[i] for r in found], dtype=np.float64) for i in range(3)))
    middle = (at + 0.5) / bins * 2 - 0.5

    def score(stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(kernel(stats) @ model, middle, level), 0, 1)

    return score


def scored(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Scores come from the whole text alone.  Null and empty texts have all
    statistics 0 and are scored like any other; repeated rows are scored each.
    Other columns are ignored.
    """
    stats = measured(docs)
    score = fit(stats, labels, **options)
    held = options.get("held_out", HELD_OUT)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(_matrix(batch)))], names=["doc_id", "score"])

    out = stats.mapInArrow(run, "doc_id bigint, score double")
    is_held = remainder(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), held[0]) == held[1] if held else F.lit(False)
    return out.select("doc_id", is_held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """The documents whose score reaches ``accept``, with their own columns only."""
    score = fit(measured(docs), labels, **options)
    names = docs.columns
    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                good = score(statistics(column(part, "text"))) >= accept
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema).select(*names)
