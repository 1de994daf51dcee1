"""Counting the most frequent phrases."""

import random
from collections import Counter

import pytest

from parley.operators import sentiment as S
from parley.plans.queries import modelling


def commonest(texts, n, top):
    counts = Counter(" ".join(words[i : i + n]) for words in texts if words for i in range(len(words) - n + 1))
    return sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top]


def shuffle_files(spark):
    """Spark's files on the local disk and their bytes."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size()))}


@pytest.mark.parametrize("buckets", [1, 16, 1 << 16])
def test_frequent_phrases_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(S, "BUCKETS", buckets)
    rng = random.Random(buckets)
    texts = [[rng.choice("aa bb cc dd été".split()) for _ in range(rng.randrange(12))] for _ in range(80)]
    texts += [None, [], ["aa"], ["zz", "zz"], ["zz", "zz"], ["aa", "bb", "cc", "dd"] * 30]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    # many ties; of four words fewer than asked for
    top = {2: 7, 3: 30, 4: 10_000}
    got = S.frequent_phrases(rows, top).collect()
    for n in top:
        assert sorted(((r["phrase"], r["count"]) for r in got if r["n"] == n), key=lambda x: (-x[1], x[0].encode())) == commonest(texts, n, top[n])


@pytest.mark.parametrize("buckets", [16, 128])
def test_frequent_phrases_outside_the_heaviest_buckets(spark, monkeypatch, buckets):
    """Buckets that reach the count of the last are counted too, whole or in parts."""
    monkeypatch.setattr(S, "BUCKETS", buckets)
    rounds = []
    monkeypatch.setattr(S, "_phrase_counts", lambda *a, count=S._phrase_counts: rounds.append(a[-1]) or count(*a))
    rng = random.Random(buckets)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [[words[int(100 * rng.random() ** 2)] for _ in range(60)] for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    top = {2: 2, 3: 1}
    got = S.frequent_phrases(rows, top).collect()
    for n in top:
        assert sorted(((r["phrase"], r["count"]) for r in got if r["n"] == n), key=lambda x: (-x[1], x[0].encode())) == commonest(texts, n, top[n])
    assert rounds == [buckets, buckets * S.FINER]


def test_no_phrases(spark):
    rows = spark.createDataFrame([(None,), ([],), (["aa"],)], "tokens array<string>")
    assert S.frequent_phrases(rows, {2: 3, 3: 2}).collect() == []


def test_rare_phrases_stay_off_the_disk(spark, monkeypatch):
    """The table of phrases is found without a row on the disk for each run of words."""
    monkeypatch.setattr(S, "BUCKETS", 1 << 10, raising=False)
    monkeypatch.setattr(modelling, "PHRASES", {2: 3, 3: 2, 4: 1})
    rng = random.Random(3)
    line = "one very common line here".split()
    texts = [[w for _ in range(5) for w in [*line, *("".join(rng.choices("abcdefghij", k=6)) for _ in range(80))]] for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    before = shuffle_files(spark)
    table = modelling.phrase_table(rows)
    assert sorted(r["phrase"] for r in table.collect()) == sorted(p for n, top in modelling.PHRASES.items() for p, _ in commonest(texts, n, top))
    written = sum(size for name, size in shuffle_files(spark).items() if name not in before)
    assert 0 < written < sum(len(" ".join(t)) for t in texts)


def test_phrases_are_built_only_where_their_words_are(spark):
    rows = spark.createDataFrame([("a b c a b".split(),), (["a"],), ([],)], "tokens array<string>")
    table = spark.createDataFrame([("a b", 2), ("b a", 2), ("c a b", 3)], "word string, n int")
    roles = S._roles(table, [3, 2])
    out = rows.withColumn("_roles", S.F.transform("tokens", roles))
    second = S.consecutive("tokens", 2, lambda i: S.F.get("_roles", i + 1).bitwiseAND(S._role(2, 1)) != 0)
    got = [tuple(r) for r in out.select("_roles", second.alias("g")).collect()]
    a, b, c = S._role(2, 0) | S._role(2, 1) | S._role(3, 1), S._role(2, 0) | S._role(2, 1) | S._role(3, 2), S._role(3, 0)
    assert got == [([a, b, c, a, b], ["a b", "", "c a", "a b"]), ([a], []), ([], [])]


@pytest.mark.parametrize("inline", [50_000, 0])
def test_odd_phrases_hold_nothing(spark, monkeypatch, inline):
    """The result with and without the lookup of a phrase's words."""
    monkeypatch.setattr(S, "INLINE_WORDS", inline)
    odd = [("", 9.0), (" ", 9.0), ("aa  bb", 9.0), (" aa", 9.0), ("bb cc", None), ("aa bb", 1.0), ("cc", 2.0), ("aa bb cc dd", -3.0)]
    phrases = spark.createDataFrame(odd, "phrase string, value double")
    texts = ["aa bb", "bb cc", "aa bb cc dd", "aa", "aa bb cc aa bb cc dd cc", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "seq int, cleaned_message string")
    lexicon = spark.createDataFrame([("dd", 4.0)], "word string, value double")
    got = {r.seq: r.sentiment_score for r in S.sentiment_lexicon(rows, lexicon, ["seq"], phrases).collect()}
    total = [1.0, 2.0, -3.0, 0.0, 1.0 + 2.0 - 3.0 + 2.0, 0.0, 0.0]
    assert got == {i: round(t / (t * t + S.ALPHA) ** 0.5, 4) for i, t in enumerate(total)}
