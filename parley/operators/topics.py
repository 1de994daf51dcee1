"""Topic models on cleaned messages, with Spark ML doing the fitting."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.once import computed_once, unnest
from parley.operators.temporal import fill_slots
from parley.session import checkpointed

MAX_FEATURES = 1000
LABEL_WORDS = 5
SEED = 42


def feature_tokens(text: Column) -> Column:
    """Words of two or more characters of a cleaned text."""
    words = T.split_words(F.coalesce(text, F.lit("")))
    return F.filter(words, lambda w: F.length(w) > 1)


def frequent_terms(messages: DataFrame, max_features: int = MAX_FEATURES, tokens: str = "_terms") -> list[str]:
    """The most frequent terms, sorted.  Ties by term."""
    return sorted(r["word"] for r in word_frequency(messages, max_features, tokens).collect())


def term_counts(messages: DataFrame, terms: list[str], tokens: str = "_terms") -> DataFrame:
    """Add ``_tf``, how often each of the terms occurs in a message."""
    return CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol="_tf").transform(messages)


def idf_weights(counted: DataFrame) -> list[float]:
    """ln((1+n)/(1+df)) + 1 of each term of ``_tf``."""
    seen = IDF(inputCol="_tf", outputCol="_idf").fit(counted)
    return [math.log((1 + seen.numDocs) / (1 + df)) + 1 for df in seen.docFreq]


def vocabulary(
    messages: DataFrame, max_features: int = MAX_FEATURES, tokens: str = "_terms"
) -> list[tuple[str, float]]:
    """The most frequent terms with their idf.  At most ``max_features`` rows reach the driver."""
    terms = frequent_terms(messages, max_features, tokens)
    return list(zip(terms, idf_weights(term_counts(messages, terms, tokens)))) if terms else []


def tfidf_vectors(
    messages: DataFrame,
    max_features: int = MAX_FEATURES,
    text: str = "cleaned_message",
    output: str = "features",
) -> tuple[DataFrame, list[str]]:
    """Add an L2-normalised TF-IDF vector; also return the vocabulary.

    The texts are read twice: for the vocabulary, and for the counts of its
    terms, which are written once.  In how many messages a term occurs is
    counted on those; the rest is a per-row projection.
    """
    prepared = computed_once(messages, "_terms", feature_tokens(F.col(text)))
    names = frequent_terms(prepared, max_features)
    if not names:
        raise ValueError("empty vocabulary: no message has a usable word")
    counted = checkpointed(term_counts(prepared, names).drop("_terms"))
    weight = ElementwiseProduct(
        scalingVec=Vectors.dense(idf_weights(counted)), inputCol="_tf", outputCol="_tfidf"
    )
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=output)
    return norm.transform(weight.transform(counted)).drop("_tf", "_tfidf"), names


def tfidf_features(
    messages: DataFrame,
    row_key: Sequence[str],
    max_features: int = MAX_FEATURES,
    text: str = "cleaned_message",
) -> DataFrame:
    """Long form: one row per message and term with its weight."""
    vectors, names = tfidf_vectors(messages.select(*dict.fromkeys([*row_key, text])), max_features, text)
    # the stored form of the vector lists its entries; dense ones have no indices
    stored = F.unwrap_udt("features")
    at = F.coalesce(stored["indices"], F.sequence(F.lit(0), F.size(stored["values"]) - 1))
    pairs = F.zip_with(at, stored["values"], lambda i, w: F.struct(i.alias("i"), w.alias("weight")))
    rows = unnest(vectors, list(row_key), pairs, "p").filter("p.weight <> 0")
    terms = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return rows.select(*row_key, F.get(terms, F.col("p.i")).alias("term"), "p.weight")


def first_argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def topic_weights(
    messages: DataFrame,
    n_topics: int | None,
    keys: Sequence[str] = ("group_name",),
) -> DataFrame:
    """Share of messages per topic; with ``n_topics`` unseen topics get 0."""
    counts = messages.groupBy(*keys, "topic_id").agg(F.count(F.lit(1)).alias("messages"))
    if n_topics is None:
        # as many rows per group as topics
        total = F.sum("messages").over(Window.partitionBy(*keys))
        return counts.select(*keys, "topic_id", (F.col("messages") / total).alias("weight"))
    filled = fill_slots(counts, keys, "topic_id", n_topics)
    total = F.sum("messages").over(Window.partitionBy(*keys))
    return filled.select(*keys, "topic_id", (F.col("messages") / total).alias("weight"))


def topic_message_count(
    messages: DataFrame, keys: Sequence[str] = ("group_name",), label: str = "topic_label"
) -> DataFrame:
    return messages.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("messages"))


def topics_lda(
    messages: DataFrame,
    n_topics: int = 5,
    keys: Sequence[str] = ("group_name",),
    text: str = "cleaned_message",
    max_features: int = MAX_FEATURES,
    max_iter: int = 10,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Fit LDA on TF-IDF; return (messages + topic_id, topic_score; topic table).

    Term counts are written once, and every pass over the corpus reads those.
    One model serves all groups of the input, so labels compare across groups;
    weights are per group.  A message without any vocabulary word gets topic 0
    with score 1/k.
    """
    vectors, names = tfidf_vectors(messages, max_features, text, "_features")
    lda = LDA(
        k=n_topics, seed=seed, optimizer="online", subsamplingRate=1.0, maxIter=max_iter,
        featuresCol="_features", topicDistributionCol="_dist",
    )
    training = vectors.select("_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = lda.fit(training)  # reads its input once per iteration
    finally:
        training.unpersist()
    dist = vector_to_array(F.col("_dist"))
    placed = model.transform(vectors).withColumn("_p", dist)
    empty = F.array_max("_p") <= 0
    annotated = placed.select(
        *messages.columns,
        F.when(empty, 0).otherwise(first_argmax(F.col("_p"))).alias("topic_id"),
        F.when(empty, 1.0 / n_topics).otherwise(F.array_max("_p")).alias("topic_score"),
    )
    described = model.describeTopics(LABEL_WORDS).select("topic", "termIndices").collect()
    labels = {
        row["topic"]: " / ".join(names[i] for i in row["termIndices"]) for row in described
    }
    return annotated, _labelled(topic_weights(annotated, n_topics, keys), labels, keys)


def _labelled(weights: DataFrame, labels: dict[int, str], keys: Sequence[str]) -> DataFrame:
    label = F.lit(None).cast("string")
    case = None
    for topic, name in sorted(labels.items()):  # n_topics entries
        hit = F.col("topic_id") == topic
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return weights.select(
        *keys, "topic_id", (case if case is not None else label).alias("topic_label"), "weight"
    )


def topic_scores_rule(probabilities: Column | None, topic_id: Column, per_topic: bool = True) -> Column:
    """Score of an assignment: 1.0 without probabilities, the single confidence
    as it is, or the assigned topic's entry (the last one if out of range)."""
    if probabilities is None:
        return F.lit(1.0)
    if not per_topic:
        return F.coalesce(probabilities.cast("double"), F.lit(1.0))
    index = F.least(topic_id, F.size(probabilities) - 1).cast("int")
    return F.when(probabilities.isNull(), 1.0).otherwise(F.get(probabilities, index))


def class_tfidf(
    messages: DataFrame, keys: Sequence[str] = ("topic_id",), tokens: str = "tokens"
) -> DataFrame:
    """Class-based TF-IDF: (n / words in class) * ln(1 + average class size / corpus n).

    Tokens are counted per (class, term) before anything else is shuffled.
    """
    counts = unnest(messages, list(keys), tokens, "term").groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n")
    )
    # from here on the text is not read again
    counts = checkpointed(counts)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_class_n"))
    corpus = counts.groupBy("term").agg(F.sum("n").alias("_term_n"))
    average = sizes.agg(F.avg("_class_n").alias("avg")).first()["avg"]
    # all sides come from the same counted rows: adaptive joins turn and split them
    joined = counts.join(sizes, list(keys)).join(corpus, "term")
    weight = F.col("n") / F.col("_class_n") * F.log1p(F.lit(average or 0.0) / F.col("_term_n"))
    return joined.select(*keys, "term", "n", weight.alias("weight"))


def topic_labels(
    weights: DataFrame, keys: Sequence[str] = ("topic_id",), n_words: int = LABEL_WORDS
) -> DataFrame:
    """The heaviest terms of each class joined by ' / ', padded with word0, word1, ..."""
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    top = weights.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n_words)
    listed = top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "term"))), lambda x: x["term"]).alias("_w")
    )
    padding = F.array(*(F.lit(f"word{i}") for i in range(n_words)))
    padded = F.concat("_w", F.slice(padding, F.lit(1), F.lit(n_words) - F.size("_w")))
    return listed.select(*keys, F.array_join(padded, " / ").alias("topic_label"))


def topics_embedding(
    messages: DataFrame,
    n_topics: int = 5,
    embedding: str | None = None,
    keys: Sequence[str] = ("group_name",),
    text: str = "cleaned_message",
    tokens: str = "tokens",
    probabilities: str | None = None,
    seed: int = SEED,
    max_features: int = MAX_FEATURES,
) -> tuple[DataFrame, DataFrame]:
    """Cluster embeddings into topics.

    ``embedding`` names an array column; without one the TF-IDF vector of the
    ``max_features`` commonest terms is used.
    Only topics that occur are listed; labels come from class TF-IDF.
    """
    if embedding is None:
        prepared, _ = tfidf_vectors(messages, max_features, text, "_vec")
    else:
        prepared = messages.withColumn(
            "_vec", array_to_vector(F.col(embedding).cast("array<double>"))
        )
    model = KMeans(k=n_topics, seed=seed, featuresCol="_vec", predictionCol="_topic").fit(
        prepared.select("_vec")
    )
    topic = F.greatest(F.col("_topic"), F.lit(0))
    scores = topic_scores_rule(F.col(probabilities) if probabilities else None, topic)
    annotated = model.transform(prepared).select(
        *messages.columns, topic.alias("topic_id"), scores.alias("topic_score")
    )
    weights = topic_weights(annotated, None, keys)
    if tokens not in messages.columns:
        filler = " / ".join(f"word{i}" for i in range(LABEL_WORDS))
        return annotated, weights.select(*keys, "topic_id", F.lit(filler).alias("topic_label"), "weight")
    labels = topic_labels(class_tfidf(annotated, ("topic_id",), tokens))
    rows = {r["topic_id"]: r["topic_label"] for r in labels.limit(n_topics).collect()}
    filler = " / ".join(f"word{i}" for i in range(LABEL_WORDS))
    group_topics = _labelled(weights, rows, keys)
    return annotated, group_topics.withColumn(
        "topic_label", F.coalesce("topic_label", F.lit(filler))
    )


def top_topic_labels(
    group_topics: DataFrame, n: int = 3, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "topic_id")
    return group_topics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def topic_word_weights(
    group_topics: DataFrame, topic_id: int | None = None, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    """Rank weights n, n-1, ..., 1 for the words of a topic label."""
    rows = group_topics if topic_id is None else group_topics.filter(F.col("topic_id") == topic_id)
    words = F.split("topic_label", " / ")
    ranked = rows.select(*keys, "topic_id", F.size(words).alias("_n"), F.posexplode(words).alias("_pos", "_w"))
    return ranked.select(
        *keys,
        "topic_id",
        T.strip_space(F.col("_w")).alias("word"),
        F.greatest(F.lit(1), F.col("_n") - F.col("_pos")).alias("weight"),
    )


def word_frequency(
    messages: DataFrame,
    top_n: int = 15,
    tokens: str = "tokens",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Most frequent tokens, overall or per key."""
    counts = unnest(messages, list(keys), tokens, "word").groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("n")
    )
    if not keys:
        return counts.orderBy(F.desc("n"), "word").limit(top_n)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "word")
    return counts.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= top_n).drop("_rn")
