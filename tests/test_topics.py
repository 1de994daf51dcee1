import math

import pytest
from pyspark.sql import functions as F

from parley.operators import topics

TEXTS = [
    "match score stade joueur", "match joueur ballon stade", "cours examen prof salle", "examen note prof cours",
    "match stade score but", "cours salle note examen", "a b", "",
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [("g" if i % 2 else "h", i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(data, "group_name string, seq int, cleaned_message string").withColumn(
        "tokens", F.filter(F.split("cleaned_message", " "), lambda w: w != "")
    )


def test_tfidf(rows):
    got = topics.tfidf_features(rows, ["seq"]).collect()
    docs = [[w for w in t.split() if len(w) > 1] for t in TEXTS]
    n = len(docs)
    for r in got:
        doc = docs[r["seq"]]
        weight = {w: doc.count(w) * (math.log((1 + n) / (1 + sum(w in d for d in docs))) + 1) for w in doc}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        assert r["weight"] == pytest.approx(weight[r["term"]] / norm)
    assert len(got) == sum(len(set(d)) for d in docs)


def test_vocabulary_cap(rows):
    prepared = rows.withColumn("_terms", topics.feature_tokens(F.col("cleaned_message")))
    kept = [t for t, _ in topics.vocabulary(prepared, 4)]
    counts = {}
    for t in TEXTS:
        for w in t.split():
            if len(w) > 1:
                counts[w] = counts.get(w, 0) + 1
    assert kept == sorted(sorted(counts, key=lambda w: (-counts[w], w))[:4])


def test_lda(rows):
    annotated, table = topics.topics_lda(rows, n_topics=2)
    out = annotated.orderBy("seq").collect()
    assert len(out) == len(TEXTS)
    assert all(0 <= r["topic_id"] < 2 and 0 < r["topic_score"] <= 1 for r in out)
    assert (out[-1]["topic_id"], out[-1]["topic_score"]) == (0, 0.5)
    assert annotated.columns == [*rows.columns, "topic_id", "topic_score"]
    listed = table.collect()
    assert {(r["group_name"], r["topic_id"]) for r in listed} == {(g, t) for g in "gh" for t in (0, 1)}
    for g in "gh":
        assert sum(r["weight"] for r in listed if r["group_name"] == g) == pytest.approx(1)
    assert all(len(r["topic_label"].split(" / ")) == 5 for r in listed)
    again, _ = topics.topics_lda(rows, n_topics=2)
    assert [r["topic_id"] for r in again.orderBy("seq").collect()] == [r["topic_id"] for r in out]


def test_lda_needs_words(rows):
    with pytest.raises(ValueError):
        topics.topics_lda(rows.filter("seq >= 6"), n_topics=2)


def test_embedding_topics(spark):
    data = [("g", i, [1.0 * (i % 2), 1.0 - (i % 2)], ["un", "mot"] if i % 2 else ["autre"]) for i in range(20)]
    rows = spark.createDataFrame(data, "group_name string, seq int, emb array<float>, tokens array<string>")
    annotated, table = topics.topics_embedding(rows, n_topics=2, embedding="emb")
    ids = {r["seq"] % 2: r["topic_id"] for r in annotated.collect()}
    assert sorted(ids.values()) == [0, 1]
    assert {r["topic_score"] for r in annotated.collect()} == {1.0}
    labels = {r["topic_id"]: r["topic_label"] for r in table.collect()}
    assert labels[ids[0]] == "autre / word0 / word1 / word2 / word3"
    assert set(labels[ids[1]].split(" / ")) == {"un", "mot", "word0", "word1", "word2"}
    assert all(r["weight"] == 0.5 for r in table.collect())


def test_embedding_topics_from_text(rows):
    annotated, table = topics.topics_embedding(rows, n_topics=2)
    assert annotated.count() == len(TEXTS)
    assert sum(r["weight"] for r in table.collect()) == pytest.approx(2)


def test_score_rule(spark):
    rows = spark.createDataFrame([(0, [0.7, 0.2]), (1, [0.7, 0.2]), (5, [0.7, 0.2]), (0, None)], "t int, p array<double>")
    got = rows.select(topics.topic_scores_rule(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in got] == [0.7, 0.2, 0.2, 1.0]
    flat = rows.select(topics.topic_scores_rule(F.get("p", 0), F.col("t"), per_topic=False)).collect()
    assert [r[0] for r in flat] == [0.7, 0.7, 0.7, 1.0]
    assert rows.select(topics.topic_scores_rule(None, F.col("t"))).first()[0] == 1.0


def test_weights_of_unseen_topics(spark):
    rows = spark.createDataFrame([("g", 0), ("g", 0), ("g", 2)], "group_name string, topic_id int")
    got = {r["topic_id"]: r["weight"] for r in topics.topic_weights(rows, 4).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: 0, 2: pytest.approx(1 / 3), 3: 0}


def test_labels_and_words(spark):
    table = spark.createDataFrame(
        [("g", 0, "a / b / c", 0.2), ("g", 1, "d", 0.5), ("g", 2, "e", 0.2), ("g", 3, "f", 0.1)],
        "group_name string, topic_id int, topic_label string, weight double",
    )
    top = topics.top_topic_labels(table).orderBy("rank").collect()
    assert [r["topic_id"] for r in top] == [1, 0, 2]
    words = {r["word"]: r["weight"] for r in topics.topic_word_weights(table, 0).collect()}
    assert words == {"a": 3, "b": 2, "c": 1}
    assert topics.topic_word_weights(table, 9).count() == 0


def test_word_frequency(rows):
    top = topics.word_frequency(rows, 2).collect()
    assert [(r["word"], r["n"]) for r in top] == [("cours", 3), ("examen", 3)]
    plan = topics.word_frequency(rows, 2, keys=["group_name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_vectors_do_not_read_the_texts_again(rows, tmp_path):
    spark = rows.sparkSession
    rows.write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    vectors, names = topics.tfidf_vectors(stored)
    assert stored.inputFiles() and not vectors.inputFiles()
    annotated, _ = topics.topics_lda(stored, n_topics=2)
    assert not annotated.inputFiles() and annotated.columns == [*rows.columns, "topic_id", "topic_score"]
