"""One topic model for each group, all groups in the same jobs.

Batch variational Bayes for latent Dirichlet allocation.  A group's model is a
row of at most ``max_features`` terms times the topics, whatever the group's
size; its messages lie in chunks of a bounded number of words.  In a round every
chunk meets its group's model and hands on, for each of its terms, what its
messages expect of the topics; Spark sums these by (group, term), partly before
the shuffle, and the sums are the next model.  Thousands of groups and one group
with most of the messages run through the same plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.once import computed_once, unnest
from parley.operators.topics import LABEL_WORDS, MAX_FEATURES, SEED, feature_tokens, topic_weights
from parley.session import attach, checkpointed, ship_package

#: Different words of messages that a chunk holds, about.
CHUNK = 50_000
INNER_ROUNDS = 1000
#: Topics of messages are computed until they change by less than this on average.
PRECISION = 1e-3

_CHUNKS = "_group string, _chunk bigint, docs array<string>, sizes array<int>, terms array<int>, weights array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    x, low = x.copy(), np.zeros_like(x)
    for _ in range(6):
        low -= 1 / x
        x += 1
    y = 1 / (x * x)
    return low + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, low = np.array(x, dtype=float), 0.0
    for _ in range(6):
        low = low - np.log(x)
        x = x + 1
    y = 1 / (x * x)
    return low + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y / 1260)) / x


def _expected_log(parameters: np.ndarray) -> np.ndarray:
    """Expected logarithm of a Dirichlet variable, along the last axis."""
    return digamma(parameters) - digamma(parameters.sum(axis=-1, keepdims=True))


def first_model(group: str, n_terms: int, n_topics: int, seed: int) -> np.ndarray:
    """The model that the rounds of a group start from: (topics, terms)."""
    return np.random.default_rng([seed, zlib.crc32(group.encode())]).gamma(100, 0.01, (n_topics, n_terms))


def expected_topics(sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, model: np.ndarray, precision: float = PRECISION):
    """Topics of messages under a model: their parameters (messages, topics), the
    expected topics of each (topic, term), and the bound of their log likelihood."""
    k, prior = len(model), 1 / len(model)
    log_beta = _expected_log(model)
    beta = np.exp(log_beta[:, terms]).T
    starts, doc = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    gamma = np.ones((len(sizes), k))
    for _ in range(INNER_ROUNDS):
        theta = np.exp(_expected_log(gamma))
        share = weights / np.maximum((theta[doc] * beta).sum(axis=1), 1e-300)
        new = prior + theta * np.add.reduceat(share[:, None] * beta, starts, axis=0)
        change = np.abs(new - gamma).mean(axis=1).max()
        gamma = new
        if change < precision:
            break
    log_theta = _expected_log(gamma)
    theta = np.exp(log_theta)
    total = (theta[doc] * beta).sum(axis=1)
    each = theta[doc] * beta * (weights / np.maximum(total, 1e-300))[:, None]
    expected = np.stack([np.bincount(terms, each[:, i], minlength=model.shape[1]) for i in range(k)])
    bound = (weights * np.log(np.maximum(total, 1e-300))).sum()
    bound += ((prior - gamma) * log_theta + log_gamma(gamma)).sum() - len(sizes) * k * log_gamma(np.array(prior))
    bound += (log_gamma(np.array(k * prior)) - log_gamma(gamma.sum(axis=1))).sum()
    return gamma, expected, float(bound)


def model_bound(model: np.ndarray) -> float:
    """The part of the bound that the model itself adds."""
    k, v = model.shape
    prior = 1 / k
    bound = ((prior - model) * _expected_log(model) + log_gamma(model) - log_gamma(np.array(prior))).sum()
    return float(bound + (log_gamma(np.array(v * prior)) - log_gamma(model.sum(axis=1))).sum())


def _packed(group: pa.Table) -> pa.Table:
    """The words of a chunk, message by message, each message of length 1."""
    group = group.sort_by([("_doc", "ascending"), ("_term", "ascending")])
    docs, sizes = np.unique(np.array(group["_doc"].to_pylist(), dtype=object), return_counts=True)
    weights = group["weight"].to_numpy().astype(float)
    norms = np.sqrt(np.add.reduceat(weights * weights, np.cumsum(sizes) - sizes))
    row = [group["_group"][0].as_py(), group["_chunk"][0].as_py(), docs.tolist(), sizes.tolist(), group["_term"].to_pylist(), (weights / np.repeat(norms, sizes)).tolist()]
    types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["_group", "_chunk", "docs", "sizes", "terms", "weights"])


def _chunk_rows(batches, n_topics: int, seed: int):
    """Each chunk with its model: (group, docs, sizes, terms, weights, model)."""
    for batch in batches:
        for r in batch.to_pylist():
            model = r["model"]
            model = first_model(r["_group"], r["n_terms"], n_topics, seed) if model is None else np.array(model).reshape(-1, n_topics).T
            yield r["_group"], r["docs"], np.array(r["sizes"]), np.array(r["terms"]), np.array(r["weights"]), model


def _round(n_topics: int, seed: int, precision: float):
    """Of each chunk the expected topics of its terms; as term -1 the bound of its
    messages, as term -2 that of the model."""

    def run(batches):
        for group, _, sizes, terms, weights, model in _chunk_rows(batches, n_topics, seed):
            _, expected, bound = expected_topics(sizes, terms, weights, model, precision)
            own = np.unique(terms)
            values = [*expected[:, own].T.tolist(), [bound] * n_topics, [model_bound(model)] * n_topics]
            arrays = [pa.array([group] * len(values)), pa.array([*own.tolist(), -1, -2], pa.int32()), pa.array(values, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_group", "_term", "expected"])

    return run


def _assigned(n_topics: int, seed: int, precision: float):
    def run(batches):
        for group, docs, sizes, terms, weights, model in _chunk_rows(batches, n_topics, seed):
            gamma, _, _ = expected_topics(sizes, terms, weights, model, precision)
            share = gamma / gamma.sum(axis=1, keepdims=True)
            arrays = [pa.array([group] * len(docs)), pa.array(docs), pa.array(share.argmax(axis=1).astype(np.int32)), pa.array(share.max(axis=1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_group", "_doc", "topic_id", "topic_score"])

    return run


def group_terms(tokens: DataFrame, sizes: DataFrame, max_features: int) -> tuple[DataFrame, DataFrame]:
    """Term counts (_group, _doc, term, tf) and each group's commonest terms
    (_group, term, _term, idf); of equally common ones the first are kept."""
    counts = checkpointed(unnest(tokens, ["_group", "_doc"], "_terms", "term").groupBy("_group", "_doc", "term").agg(F.count(F.lit(1)).alias("tf")))
    terms = counts.groupBy("_group", "term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("_group").orderBy(F.desc("cf"), "term")
    kept = terms.withColumn("_term", F.row_number().over(order) - 1).filter(F.col("_term") < max_features)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return counts, attach(kept, sizes, ["_group"], "inner").select("_group", "term", "_term", idf.alias("idf"))


def topics_lda_per_group(
    messages: DataFrame,
    row_key: Sequence[str],
    n_topics: int = 5,
    keys: Sequence[str] = ("group_name",),
    text: str = "cleaned_message",
    max_features: int = MAX_FEATURES,
    max_iter: int = 10,
    seed: int = SEED,
    chunk: int = CHUNK,
    precision: float = PRECISION,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fit one model for each group; return (messages + topic_id, topic_score;
    topic table; bounds).

    ``row_key`` names the columns that tell messages of a group apart; messages
    that share them are one text.  A message without a word of its group's
    vocabulary gets topic 0 with score 1/k, a topic without words the label
    "word0 / word1 / ...".  bounds has, for each group and round, the lower bound
    of the log likelihood before that round.
    """
    ship_package(messages.sparkSession)
    every = {"ignoreNullFields": "false"}
    named = messages.withColumns({"_group": F.to_json(F.struct(*keys), every), "_doc": F.to_json(F.struct(*row_key), every)})
    tokens = computed_once(named.select("_group", "_doc", text), "_terms", feature_tokens(F.col(text)))
    sizes = checkpointed(named.groupBy("_group", *keys).agg(F.count_distinct("_doc").alias("n")))
    counts, vocabulary = group_terms(tokens, sizes.select("_group", "n"), max_features)
    vocabulary = checkpointed(vocabulary)
    words = attach(counts, vocabulary, ["_group", "term"], "inner").select("_group", "_doc", "_term", (F.col("tf") * F.col("idf")).alias("weight"))
    words = checkpointed(words)
    per_group = checkpointed(words.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).alias("_chunks")))
    dealt = attach(words, per_group, ["_group"], "inner").withColumn("_chunk", F.pmod(F.xxhash64("_doc"), F.col("_chunks"))).drop("_chunks")
    packed = dealt.groupBy("_group", "_chunk").applyInArrow(_packed, _CHUNKS)
    # much work for few bytes: dealt by number, and models go to the chunks, as by
    # group most chunks of a large one would meet its model in one task
    n_chunks = per_group.agg(F.sum("_chunks")).first()[0] or 1
    chunks = checkpointed(packed.repartition(min(int(n_chunks), 8 * messages.sparkSession.sparkContext.defaultParallelism)))

    n_terms = vocabulary.groupBy("_group").agg(F.count(F.lit(1)).cast("int").alias("n_terms"))
    model = checkpointed(n_terms.withColumn("model", F.lit(None).cast("array<double>")))
    bounds = None
    for step in range(max_iter):
        rows = attach(chunks, model, ["_group"], "inner").mapInArrow(_round(n_topics, seed, precision), "_group string, _term int, expected array<double>")
        sums = F.array(*(F.sum(F.get("expected", k)) for k in range(n_topics)))
        summed = checkpointed(rows.groupBy("_group", "_term").agg(sums.alias("sums"), F.max(F.get("expected", F.lit(0))).alias("own")))
        bound = summed.filter("_term < 0").groupBy("_group").agg(F.sum(F.when(F.col("_term") == -1, F.get("sums", F.lit(0))).otherwise(F.col("own"))).alias("bound"))
        bound = bound.withColumn("round", F.lit(step))
        bounds = bound if bounds is None else bounds.union(bound)
        # at most ``max_features`` terms per group
        packed = F.array_sort(F.collect_list(F.struct("_term", "sums")))
        values = F.flatten(F.transform(packed, lambda t: F.transform(t["sums"], lambda s: s + F.lit(1 / n_topics))))
        model = summed.filter("_term >= 0").groupBy("_group").agg(F.count(F.lit(1)).cast("int").alias("n_terms"), values.alias("model"))
    model = checkpointed(model)

    placed = attach(chunks, model, ["_group"], "inner").mapInArrow(_assigned(n_topics, seed, precision), "_group string, _doc string, topic_id int, topic_score double")
    given = [c for c in messages.columns if c not in ("topic_id", "topic_score")]
    annotated = named.select(*given, "_group", "_doc").join(placed, ["_group", "_doc"], "left").select(
        *given, F.coalesce("topic_id", F.lit(0)).alias("topic_id"), F.coalesce("topic_score", F.lit(1 / n_topics)).alias("topic_score")
    )
    # every topic's heaviest terms, from models of bounded size
    rows = model.select("_group", F.posexplode("model").alias("at", "value"))
    rows = rows.select("_group", F.floor(F.col("at") / n_topics).cast("int").alias("_term"), F.pmod("at", F.lit(n_topics)).alias("topic_id"), "value")
    order = Window.partitionBy("_group", "topic_id").orderBy(F.desc("value"), "_term")
    top = rows.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= LABEL_WORDS).join(vocabulary, ["_group", "_term"])
    listed = top.groupBy("_group", "topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda x: x["term"]).alias("_w"))
    padding = F.array(*(F.lit(f"word{i}") for i in range(LABEL_WORDS)))
    found = F.coalesce("_w", F.array().cast("array<string>"))
    label = F.array_join(F.concat(found, F.slice(padding, F.size(found) + 1, F.lit(LABEL_WORDS))), " / ")
    weights = topic_weights(annotated, n_topics, keys).withColumn("_group", F.to_json(F.struct(*keys), every))
    table = weights.join(listed, ["_group", "topic_id"], "left").select(*keys, "topic_id", label.alias("topic_label"), "weight")
    told = bounds.join(sizes, "_group").select(*keys, "round", "bound")
    return annotated, table, told
