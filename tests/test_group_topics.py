import json
import math
import random
from collections import Counter

import numpy as np
import pytest

from parley.operators import group_topics as G


def test_gamma_functions():
    x = np.array([0.05, 0.2, 1.0, 3.7, 250.0])
    assert G.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-8, abs=1e-8)
    slope = [(math.lgamma(v + 1e-6) - math.lgamma(v - 1e-6)) / 2e-6 for v in x]
    assert G.digamma(x) == pytest.approx(slope, rel=1e-4)


def by_hand(texts, name, k, max_features, rounds, seed=G.SEED):
    """Topics of the texts of one group, message by message."""
    words = [[w for w in (t or "").lower().split() if len(w) > 1] for t in texts]
    often, spread = Counter(w for ws in words for w in ws), Counter(w for ws in words for w in set(ws))
    terms = sorted(often, key=lambda w: (-often[w], w))[:max_features]
    at = {w: i for i, w in enumerate(terms)}
    docs = []
    for ws in words:
        tf = Counter(at[w] for w in ws if w in at)
        weight = {i: n * (math.log((1 + len(texts)) / (1 + spread[terms[i]])) + 1) for i, n in tf.items()}
        norm = math.sqrt(sum(v * v for v in weight.values()))
        docs.append({i: v / norm for i, v in weight.items()})
    model = G.first_model(json.dumps({"group_name": name}, separators=(",", ":")), len(terms), k, seed)
    for step in range(rounds + 1):
        beta = np.exp([[math.lgamma(v + 1e-5) / 2e-5 - math.lgamma(v - 1e-5) / 2e-5 for v in row] for row in model])
        beta /= np.exp([math.lgamma(r + 1e-5) / 2e-5 - math.lgamma(r - 1e-5) / 2e-5 for r in model.sum(axis=1)])[:, None]
        new, gammas = np.full_like(model, 1 / k), []
        for doc in docs:
            gamma = np.ones(k)
            for _ in range(300):
                theta = np.exp(G._expected_log(gamma))
                share = {i: theta * beta[:, i] / (theta @ beta[:, i]) * v for i, v in doc.items()}
                gamma = 1 / k + sum(share.values(), np.zeros(k))
            theta = np.exp(G._expected_log(gamma))
            for i, v in doc.items():
                new[:, i] += theta * beta[:, i] / (theta @ beta[:, i]) * v
            gammas.append(gamma / gamma.sum() if doc else None)
        model = new if step < rounds else model
    return terms, model, gammas


def planted(rng, n, topics=3):
    return [" ".join(f"t{i % topics}w{rng.randrange(12)}" for _ in range(rng.randrange(4, 15))) for i in range(n)]


def frame(spark, groups):
    rows = [(name, i, t, 7, "clash", "clash") for name, texts in groups.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "group_name string, seq int, cleaned_message string, topic_id int, term string, model string")


@pytest.mark.parametrize("chunk", [G.CHUNK, 30])
def test_models_of_groups(spark, chunk):
    rng = random.Random(1)
    groups = {"a": planted(rng, 40), "b \"quoted\"": planted(rng, 25, 2), "one": ["alpha beta alpha"], "none": [None, "", "x y"]}
    placed, table, bounds = G.topics_lda_per_group(frame(spark, groups), ["seq"], 3, max_features=20, max_iter=4, chunk=chunk, precision=1e-9)
    assert placed.columns == ["group_name", "seq", "cleaned_message", "term", "model", "topic_id", "topic_score"]
    got = {(r.group_name, r.seq): (r.topic_id, r.topic_score) for r in placed.collect()}
    labels = {(r.group_name, r.topic_id): (r.topic_label, r.weight) for r in table.collect()}
    assert len(got) == sum(map(len, groups.values())) and len(labels) == 12
    for name, texts in groups.items():
        if name == "none":
            assert all(got[name, i] == (0, pytest.approx(1 / 3)) for i in range(3))
            assert labels[name, 0] == ("word0 / word1 / word2 / word3 / word4", 1.0)
            continue
        terms, model, shares = by_hand(texts, name, 3, 20, 4)
        for i, share in enumerate(shares):
            want = (0, 1 / 3) if share is None else (int(share.argmax()), share.max())
            assert got[name, i][1] == pytest.approx(want[1], abs=2e-4)
            assert got[name, i][0] == want[0] or (share is not None and share[got[name, i][0]] == pytest.approx(want[1], abs=1e-3))
        for k in range(3):
            heaviest = sorted(model[k], reverse=True)[: G.LABEL_WORDS]
            chosen = [model[k][terms.index(w)] for w in labels[name, k][0].split(" / ") if w in terms]
            assert chosen == pytest.approx(heaviest, rel=1e-3)
            assert labels[name, k][1] == pytest.approx(sum(got[name, i][0] == k for i in range(len(texts))) / len(texts))
    steps = {}
    for r in bounds.orderBy("round").collect():
        steps.setdefault(r.group_name, []).append(r.bound)
    assert set(steps) == set(groups) - {"none"}
    for values in steps.values():
        assert len(values) == 4 and all(y >= x - 1e-6 for x, y in zip(values, values[1:], strict=False))


def test_planted_topics_of_many_groups(spark):
    rng = random.Random(2)
    groups = {f"g{i}": planted(rng, 30) for i in range(60)}
    placed, _, _ = G.topics_lda_per_group(frame(spark, groups), ["seq"], 6, max_iter=8)
    counts = Counter((r.group_name, r.topic_id, r.seq % 3) for r in placed.collect())
    most = Counter()
    for (name, topic, _), n in counts.items():
        most[name, topic] = max(most[name, topic], n)
    assert sum(most.values()) >= 0.95 * 60 * 30


def test_no_messages(spark):
    placed, table, bounds = G.topics_lda_per_group(frame(spark, {"a": ["x"]}).limit(0), ["seq"], 3, max_iter=2)
    assert placed.collect() == table.collect() == bounds.collect() == []


def test_chunks_of_one_group_are_worked_on_in_many_tasks(spark, tmp_path, monkeypatch):
    whole = G._round

    def told(*options):
        run = whole(*options)

        def inner(batches):
            from pyspark import TaskContext

            for batch in batches:
                if batch.num_rows:
                    (tmp_path / str(TaskContext.get().partitionId())).touch()
                yield from run([batch])

        return inner

    monkeypatch.setattr(G, "_round", told)
    G.topics_lda_per_group(frame(spark, {"a": [f"one two three{i % 7}" for i in range(60)]}), ["seq"], 2, max_iter=1, chunk=5)
    assert len(list(tmp_path.iterdir())) > 1
