import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, corpus, crc, frame, sentence, words

from parley.llm import pitman_yor, quality


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        text = sentence(rng, rng.randrange(20, 120)) if good else "!! ".join(sentence(rng, 40).upper().split())
        rows.append((i, text, "a"))
        if i % 2:
            labels.append((i, int(good), 0))
    rows += [(400, None, None), (401, "", "a"), (402, "x" * 20_000, "a")]
    labels += [(400, None, 0), (None, 1, 0), (9999, 1, 1)]
    return rows, labels


def test_quality_on_held_out_documents(spark, labelled):
    rows, labels = labelled
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scored(frame(spark, rows), table).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(i, q) for i, q, _ in labels if q is not None and i is not None and i < 400 and crc(i, 4) == 2]
    assert len(held) > 20
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.95
    assert got[400].score == got[401].score


def test_labels_of_held_out_documents_are_not_learned(spark, labelled):
    rows, labels = labelled
    swapped = [(i, 1 - q if q is not None and i is not None and crc(i, 4) == 2 else q, t) for i, q, t in labels]
    docs, schema = frame(spark, rows), "doc_id bigint, quality int, toxic int"
    one, two = (quality.scored(docs, spark.createDataFrame(x, schema)).select("doc_id", "score").collect() for x in (labels, swapped))
    assert sorted(one) == sorted(two)


def test_accepted_keeps_rows_as_they_are(spark, labelled):
    rows, labels = labelled
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    good = {r.doc_id for r in quality.scored(docs, table).filter("predicted = 1").collect()}
    kept = quality.accepted(docs, table)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == good


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.scored(frame(spark, corpus()[:5]), none).collect()} == {0.5}
    assert quality.scored(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_statistics_depend_on_the_text_alone():
    texts = ["a a b\nc d\nc d", None, "HEY!! YOU!!", "x", "a a b\nc d\nc d", ""]
    whole = quality.statistics(pa.array(texts))
    assert whole.shape == (6, len(quality.STATISTICS))
    for i, text in enumerate(texts):
        assert np.allclose(whole[i], quality.statistics(pa.array([text], pa.string()))[0])
    at = quality.STATISTICS.index
    assert whole[0, at("repeated_lines")] == pytest.approx(1 / 3)
    assert whole[0, at("repeated_runs")] == pytest.approx(1 / 7)
    assert whole[2, at("shouted_words")] == whole[2, at("marked_words")] == 1
    assert not whole[1].any()


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all()
    assert np.interp([1, 2], x, y).tolist() == [0.5, 0.5]


def check_model(spark, rows):
    got = {r.doc_id: r for r in pitman_yor.perplexity_scores(frame(spark, rows)).collect()}
    tokens = {i: [*(w.lower() if w.isascii() else w for w in words(t)), None] for i, t, _ in rows}
    count = Counter(w for i, ws in tokens.items() if crc(i, 5) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    assert sorted(got) == sorted(tokens)
    for i, ws in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i, 5) == 1, len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    return got


def test_scores_and_counts(spark):
    rows = corpus(3)
    got = check_model(spark, rows)
    again = pitman_yor.perplexity_scores(frame(spark, rows).repartition(1)).collect()
    assert len(again) == len(got)


def test_model_beats_word_frequencies_on_held_out_text(spark):
    import random

    rng = random.Random(8)
    follow = {i: [rng.randrange(200) for _ in range(3)] for i in range(200)}
    rows = []
    for i in range(300):
        at, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"W{at}")
            at = rng.choice(follow[at])
        rows.append((i, " ".join(out), "a"))
    got = check_model(spark, rows)
    held = [r for r in got.values() if r.held_out]
    per_token = sum(r.score for r in held) / sum(r.n_tokens for r in held)
    base = sum(r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert per_token > base + 0.8


def test_many_shards_and_hot_contexts(spark, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(pitman_yor, "SHARD_BYTES", 20_000)
    check_model(spark, [*rows, (900, "the cat " * 5000, "a")])


def test_probabilities_of_a_shard_sum_to_one():
    random = np.random.default_rng(1)
    words = np.arange(1, 6, dtype=np.uint64)
    times = [9, 1, 3, 1, 40]
    row = pitman_yor.pair_row(0, 1, None, 1, 1, np.full(54, words[0]), np.repeat(words, times), np.zeros(54, np.int64))
    own = pitman_yor.Shard(pitman_yor._table([row], pitman_yor.PAIRS), 0.8, 2.0)
    assert own.count.tolist() == times
    parent = np.full(5, 0.2)
    for _ in range(5):
        own.sweep(parent, random)
        assert (own.tables >= 1).all() and (own.tables <= own.count).all()
        assert own.predictive(parent).sum() == pytest.approx(1)


def test_seating_follows_the_sequential_process():
    random = np.random.default_rng(2)
    n, count = 4000, 20
    tables = pitman_yor.seat(np.full(n, count), np.zeros(n), np.full(n, 0.5), 0.5, 1.0, random)
    slow = []
    for _ in range(n):
        t = 1
        for i in range(1, count):
            fresh = (1.0 + 0.5 * t) * 0.5
            t += random.random() < fresh / (fresh + i - 0.5 * t)
        slow.append(t)
    assert abs(tables.mean() - np.mean(slow)) < 0.15


def test_bytes_moved_do_not_grow_with_the_shards(spark):
    docs = frame(spark, corpus(4) * 4).select("doc_id", "text").coalesce(1)
    nothing = np.zeros(0, dtype=np.uint64)
    sizes = {}
    for shards in (4, 40):
        rows = docs.mapInArrow(pitman_yor._pairs(shards, nothing, (5, 1)), pitman_yor.PAIRS).toArrow()
        assert rows.num_rows > shards / 2
        # what a compressed array or a row costs by itself is less than 100 bytes
        sizes[shards] = sum(c.nbytes for c in rows.columns) - 100 * rows.num_rows
    assert sizes[40] < 1.2 * sizes[4]


@pytest.mark.parametrize("values", [[], [0], [255, 3], [256, 0, 70_000], [1 << 40, 5]])
def test_packed_numbers_come_back(values):
    numbers = np.array(values, dtype=np.int64)
    assert pitman_yor._numbers(pitman_yor._small(numbers), len(numbers)).tolist() == values


def test_texts_that_repeat_a_key_and_texts_without_one(spark):
    rows = [(1, "a b a", "x"), (1, "a b a", "x"), (1, "c", "x"), (2, None, None), (None, "a b", "x"), (3, "", "x")]
    got = pitman_yor.perplexity_scores(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 2), (1, 4), (1, 4), (2, 1), (3, 1)]
    same = [r.base_score for r in got if r.n_tokens == 4]
    assert same[0] == same[1]


def test_no_documents(spark):
    assert pitman_yor.perplexity_scores(frame(spark, [])).collect() == []
