import random

import numpy as np
import pyarrow as pa
import pytest
from cases import corpus, frame, links_by_brute_force, removed_by_brute_force, sentence

from parley.llm import jaccard, substrings
from parley.llm.common import components
from parley.llm.words import Words, parts


def test_words_agree_with_bytes_split():
    texts = ["a bb  c", None, "", " \t\n", "é\x0bü\x0cz", "last", "x" * 3_000_000 + " y", "a bb"]
    found = Words(pa.array(texts))
    assert found.counts().tolist() == [len((t or "").encode().split()) for t in texts]
    assert found.hash[:2].tolist() == found.hash[-2:].tolist()
    assert found.text(0, 3) == b"a bb c"
    assert len(set(found.hash.tolist())) == 9
    assert Words(pa.array(["ÀB"]), lower=True).hash[0] == Words(pa.array(["Àb"])).hash[0]
    assert len(Words(pa.array([], pa.string())).hash) == 0


def test_parts_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["aa", None, "b" * 100, "c", ""])], names=["text"])
    assert [p.num_rows for p in parts(batch, "text", 10)] == [2, 1, 2]


@pytest.mark.parametrize("heavy", [0, 3, 50_000])
@pytest.mark.parametrize("size,seed", [(50, 10), (12, 4)])
def test_repeated_windows(spark, heavy, size, seed):
    rows = corpus()
    got = substrings.kept_digest(substrings.remove_repeats(frame(spark, rows), size, seed, heavy)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == removed_by_brute_force(rows, size)
    assert sum(r.n_removed for r in got) > 500


def test_rows_that_repeat_a_doc_id(spark):
    w = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join(w), "a"), (2, " ".join(["x", *w]), "a"), (2, "short text", "a"), (2, " ".join([*w, "y"]), "a"), (2, "short text", "b"), (3, " ".join(["x", *w[:8]]), "a")]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, [*rows, (None, "no id", "a")]), 9, 3).collect())
    assert got == [(1, 12, 0, " ".join(w)), (2, 2, 0, "short text"), (2, 2, 0, "short text"), (2, 13, 12, "x"), (2, 13, 12, "y"), (3, 9, 9, "")]


def test_repeats_in_empty_tables(spark):
    empty = frame(spark, [])
    assert substrings.remove_repeats(empty).collect() == []
    assert jaccard.jaccard_links(empty).collect() == []
    assert jaccard.one_of_each(empty).columns == empty.columns


@pytest.mark.parametrize("limit,block", [(1024, 512), (3, 2)])
def test_links_and_classes(spark, limit, block):
    rows = corpus(2)
    got = jaccard.jaccard_links(frame(spark, rows), limit=limit, block=block).collect()
    want = links_by_brute_force(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert max(n for _, n in want.values()) >= 7


def test_one_of_each_keeps_rows_and_columns(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    kept = jaccard.one_of_each(docs)
    want = links_by_brute_force(rows)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.9, 1) == 3
    assert jaccard.runs_for(0.999) > jaccard.runs_for(0.9)


def test_recall_holds_in_nodes_split_to_the_end(spark):
    rng = random.Random(5)
    rows = []
    for k in range(600):  # pairs of similarity 0.8: 80 of 100 shingles
        w = sentence(rng, 94, 100_000).split()
        rows += [(2 * k, " ".join(w), "a"), (2 * k + 1, " ".join("new" if i in (30, 60) else x for i, x in enumerate(w)), "a")]
    got = jaccard.jaccard_links(frame(spark, rows), limit=1).collect()
    assert sum(r.n_links == 0 for r in got) // 2 <= 3  # 0.6 on average


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 40, 40, 1)]
    counts = jaccard.shared_counts(sets[:3], sets[3:], width=7)
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[:3]]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101), (7, 7)]
    got = components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 105: 100}


def near_copies(spark, groups, seed=5):
    """Representatives whose sketches agree in about 95% of the values within a group."""
    rng = np.random.default_rng(seed)
    rows = []
    for n in groups:
        base = rng.integers(0, 1 << 32, jaccard.SKETCH, dtype=np.uint64).astype(np.uint32)
        for _ in range(n):
            own = base.copy()
            other = rng.random(jaccard.SKETCH) < 0.03
            own[other] = rng.integers(0, 1 << 32, int(other.sum()), dtype=np.uint64).astype(np.uint32)
            rows.append((len(rows), own.tobytes()))
    return spark.createDataFrame(rows, "rep bigint, sketch binary").repartition(4)


def test_dense_nodes_are_not_split(spark, monkeypatch):
    def never(*_):
        raise AssertionError("near copies were split")

    monkeypatch.setattr(jaccard, "_deeper", never)
    reps = near_copies(spark, [300, 40, 1, 1, 1])
    links = jaccard._candidates(reps, 0.8, 0.999, 64).collect()
    assert len(links) < 40 * 400  # a few for each set and run, not each pair
    classes = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert classes == {i: 0 if i < 300 else 300 for i in range(340)}


def test_two_dense_groups_in_one_node(spark):
    """Half of the sketch is common to both groups: not alike, but often in one node."""
    rows = near_copies(spark, [200, 200]).collect()
    common = rows[0].sketch[:80]
    reps = spark.createDataFrame([(r.rep, common + r.sketch[80:]) for r in rows], "rep bigint, sketch binary")
    links = jaccard._candidates(reps, 0.8, 0.999, 50)
    classes = {r.node: r.root for r in components(links).collect()}
    assert classes == {i: 0 if i < 200 else 200 for i in range(400)}
