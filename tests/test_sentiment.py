import math

import pytest
from pyspark.sql import functions as F

from parley.operators import sentiment as S
from tests.conftest import ts

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "sure": 1.3}


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, value double")


def table(spark, texts, **columns):
    rows = [(i, "AM"[i % 2], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq int, author string, cleaned_message string").withColumn("group_name", F.lit("g"))


def by_hand(words):
    """The published rules, word by word."""
    boosts = {w: S.BOOST for w in S.INTENSIFIERS} | {w: -S.BOOST for w in S.DAMPENERS}
    scores = []
    for i, w in enumerate(words):
        v = LEXICON.get(w)
        if v is None or w in boosts:
            scores.append(0.0)
            continue
        back = lambda n: words[i - n] if i >= n else None  # noqa: E731, B023
        raw = v
        if w == "no" and i + 1 < len(words) and words[i + 1] in LEXICON:
            v = 0.0
        if "no" in (back(1), back(2)) or (back(3) == "no" and back(1) in ("or", "nor")):
            v = raw * S.NEGATE
        for n in (1, 2, 3):
            b = back(n)
            if b is None or b in LEXICON:
                continue
            s = boosts.get(b, 0.0) * S.DISTANCE_DAMPING[n - 1]
            v += -s if v < 0 else s
            near = {2: back(1) in ("so", "this"), 3: back(1) in ("so", "this") or back(2) in ("so", "this")}.get(n)
            sure = {2: back(1) == "doubt", 3: "doubt" in (back(1), back(2))}.get(n)
            if b == "never" and near:
                v *= S.NEVER_SO
            elif b == "without" and sure:
                pass
            elif b in S.NEGATIONS:
                v *= S.NEGATE
        if back(1) == "least" and back(2) not in ("at", "very"):
            v *= S.NEGATE
        scores.append(v)
    if "but" in words:
        at = words.index("but")
        scores = [s * (0.5 if i < at else 1.5 if i > at else 1) for i, s in enumerate(scores)]
    total = sum(scores)
    return round(max(-1, min(1, total / math.sqrt(total * total + S.ALPHA))), 4)


TEXTS = [
    "good", "very good", "not good", "not very good", "never so good", "never good", "good but bad",
    "the least good", "at least good", "no good", "bad no good", "without doubt good", "without any doubt good",
    "kinda bad", "extremely very bad", "x y good", "", "nothing here", "no no no", "never this very great but bad",
    "hardly good nor great", "good good good good good good good good good great great great",
]


def test_lexicon_scores_follow_the_rules(spark):
    got = S.sentiment_lexicon(table(spark, TEXTS), lexicon(spark)).orderBy("seq").collect()
    for row, text in zip(got, TEXTS):
        assert row["sentiment_score"] == pytest.approx(by_hand(text.split()), abs=1e-9), text
    assert all(-1 <= r["sentiment_score"] <= 1 for r in got)


def test_lexicon_scores_on_random_texts(spark):
    import random

    rng = random.Random(3)
    words = list(LEXICON) + ["but", "very", "never", "so", "this", "without", "doubt", "least", "at", "or", "nor", "not", "slightly", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 12))) for _ in range(400)]
    got = S.sentiment_lexicon(table(spark, texts), lexicon(spark)).orderBy("seq").collect()
    for row, text in zip(got, texts):
        assert row["sentiment_score"] == pytest.approx(by_hand(text.split()), abs=1.1e-4), text


def test_large_lexicon_goes_through_a_join(spark, monkeypatch):
    rows = table(spark, TEXTS)
    inline = S.sentiment_lexicon(rows, lexicon(spark)).orderBy("seq").select("sentiment_score").collect()
    original = S.values_for_tokens
    monkeypatch.setattr(
        S, "values_for_tokens", lambda *a, **k: original(*a, **k, inline_words=0)
    )
    joined = S.sentiment_lexicon(rows, lexicon(spark), ["seq"]).orderBy("seq").select("sentiment_score").collect()
    assert joined == inline
    without_key = S.sentiment_lexicon(rows, lexicon(spark)).orderBy("seq").select("sentiment_score").collect()
    assert without_key == inline


@pytest.mark.parametrize(
    "score,label", [(0.06, "positive"), (-0.06, "negative"), (0.02, "neutral"), (0.05, "neutral"), (-0.05, "neutral"), (0.0, "neutral")]
)
def test_label(spark, score, label):
    assert spark.range(1).select(S.sentiment_label(F.lit(score))).first()[0] == label


SCORES = [0.8, -0.8, 0.0, 0.6, -0.7, 0.02]


@pytest.fixture()
def scored(spark):
    rows = [("g", "AM"[i % 2], ts(f"2024-01-0{i + 1} 10:00"), s) for i, s in enumerate(SCORES)]
    df = spark.createDataFrame(rows, "group_name string, author string, timestamp timestamp_ntz, sentiment_score double")
    return df.withColumn("sentiment_label", S.sentiment_label(F.col("sentiment_score")))


def test_summaries(scored):
    row = S.sentiment_global(scored).first()
    assert row["mean"] == pytest.approx(-0.08 / 6)
    assert row["pos_pct"] == pytest.approx(2 / 6) and row["neg_pct"] == pytest.approx(2 / 6)
    by_user = {r["author"]: r["mean_score"] for r in S.sentiment_by_user(scored).collect()}
    assert by_user == {"A": pytest.approx(0.1 / 3), "M": pytest.approx(-0.18 / 3)}
    assert [r["author"] for r in S.sentiment_rank(scored).collect()] == ["M", "A"]
    empty = S.sentiment_global(scored.filter("false"), []).first()
    assert (empty["pos_pct"], empty["neg_pct"]) == (0.0, 0.0)


def test_daily_series_has_gaps(scored):
    got = S.user_sentiment_daily(scored.filter("author = 'A'")).orderBy("day").collect()
    assert [r["mean_score"] for r in got] == [0.8, None, 0.0, None, -0.7]


def test_histogram_counts_everything(scored):
    got = S.sentiment_histogram(scored).collect()
    assert sum(r["messages"] for r in got) == 6 and max(r["bin"] for r in got) == 20 and min(r["bin"] for r in got) == 1
    one = S.sentiment_histogram(scored.filter("sentiment_score = 0.6")).collect()
    assert len(one) == 1 and one[0]["messages"] == 1


def load_stub():
    def classify(texts):
        if "boom" in texts:
            raise RuntimeError
        return [("LABEL_1", 0.9) if "bien" in text else ("LABEL_0", 0.85) for text in texts]

    return classify


def broken_stub():
    raise ImportError("no model here")


def test_model(spark):
    got = S.sentiment_model(table(spark, ["tres bien", "mal", "boom"]), load_stub).orderBy("seq").collect()
    assert [r["sentiment_score"] for r in got] == [0.9, -0.85, 0.0]
    assert [r["sentiment_label"] for r in got] == ["positive", "negative", "neutral"]


def test_routing(spark):
    rows = table(spark, ["bien good", "mal good"]).withColumn("language", F.when(F.col("seq") == 0, "fr").otherwise("en"))
    score = lambda df: [r["sentiment_score"] for r in df.orderBy("seq").collect()]
    words = lexicon(spark)
    assert score(S.analyze_sentiment(rows, words, "fr", load_stub)) == [0.9, -0.85]
    assert score(S.analyze_sentiment(rows, words, "en", load_stub)) == [0.4404, 0.4404]
    assert score(S.analyze_sentiment(rows, words, None, load_stub)) == [0.9, 0.4404]
    assert score(S.analyze_sentiment(rows, words, "fr", broken_stub)) == [0.4404, 0.4404]
    with pytest.raises(ValueError):
        S.analyze_sentiment(rows, None, "en")
    with pytest.raises(ValueError):
        S.analyze_sentiment(rows.drop("author"), words)


PHRASES = {"kiss of death": -1.5, "of death": -4.0, "bad ass": 1.5, "ass kiss": 3.0, "good good": 4.0, "bus stop": 0.0, "very good idea": 2.0}


def valences_with_phrases(words):
    """Each word's valence where phrases hold it: (value, whether it counts), else None."""
    out = []
    for i in range(len(words)):
        best = None
        for phrase, value in PHRASES.items():
            p = phrase.split(" ")
            for start in range(max(0, i - len(p) + 1), i + 1):
                if words[start : start + len(p)] == p:
                    best = min(filter(None, [best, (-len(p), start, value, start + len(p) - 1 == i)]))
        out.append(best and (best[2], best[3]))
    return out


@pytest.mark.parametrize("inline", [50_000, 0])
def test_phrases_override_words(spark, monkeypatch, inline):
    import random

    monkeypatch.setattr(S.values_for_tokens, "__kwdefaults__", None)
    monkeypatch.setattr(S.values_for_tokens, "__defaults__", ("tokens", inline))
    rng = random.Random(2)
    pieces = [*PHRASES, "kiss", "of", "ass", "stop", "very", "but", "x", "not", "bad"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(8))) for _ in range(150)]
    texts += ["the kiss of death", "bad ass kiss of death", "good good good", "good good good good", "bus stop", "not good", None, ""]
    phrases = spark.createDataFrame([*PHRASES.items(), (None, 1.0)], "phrase string, value double")
    plain = {r.seq: r.sentiment_score for r in S.sentiment_lexicon(table(spark, texts), lexicon(spark), ["seq"]).collect()}
    out = S.sentiment_lexicon(table(spark, texts), lexicon(spark), ["seq"], phrases)
    assert out.columns == ["seq", "author", "cleaned_message", "group_name", "sentiment_score", "sentiment_label"]
    got = {r.seq: r.sentiment_score for r in out.collect()}
    changed = 0
    for i, text in enumerate(texts):
        words = (text or "").split()
        held = valences_with_phrases(words)
        if not any(held):
            assert got[i] == plain[i]
        elif all(h or (w not in LEXICON) for h, w in zip(held, words, strict=True)):
            but = words.index("but") if "but" in words else None
            weight = lambda k: 1 if but is None or k == but else S.BEFORE_BUT if k < but else S.AFTER_BUT  # noqa: E731, B023
            total = sum(h[0] * weight(k) for k, h in enumerate(held) if h and h[1])
            assert got[i] == pytest.approx(round(total / math.sqrt(total * total + S.ALPHA), 4), abs=1e-9), text
            changed += 1
    assert changed > 30
    assert S.sentiment_lexicon(table(spark, texts), lexicon(spark), ["seq"], phrases.limit(0)).filter("seq = 3").first().sentiment_score == plain[3]


def test_long_phrases_are_refused(spark):
    long = spark.createDataFrame([("a b c d e f", 1.0)], "phrase string, value double")
    with pytest.raises(ValueError, match="up to 5 words"):
        S.sentiment_lexicon(table(spark, ["a"]), lexicon(spark), ["seq"], long)


def test_words_far_from_modifiers_keep_their_values(spark):
    """Looking at the neighbours of every word gives the same as of those beside modifiers."""
    odd = ["good", "bad", "no", "least", "at", "very", "never", "so", "this", "without", "doubt", "or", "nor", "but", "hardly", "x", "y", "dont"]
    texts = [" ".join(odd[(i * 7 + j * j * (i % 5 + 1) + j) % len(odd)] for j in range(12)) for i in range(200)]
    values = {"good": 1.9, "bad": -2.5, "no": -1.2, "doubt": -1.5, "so": 0.5}
    rows = spark.createDataFrame([(t.split(), [values.get(w) for w in t.split()]) for t in texts], "w array<string>, v array<double>")
    rows = rows.withColumns({"at": F.array_position("w", "but") - 1, "marks": S.modifies(F.col("w")), "all": F.transform("w", lambda _: F.lit(True))})
    total = lambda marks: S.total_valence(F.col("w"), F.col("v"), F.col("at"), F.col(marks))
    got = rows.select(total("marks").alias("a"), total("all").alias("b"), F.exists("marks", lambda m: ~m).alias("some")).collect()
    assert all(r.a == r.b for r in got) and any(r.some for r in got) and len({r.a for r in got}) > 20
