import glob

import pytest
from pyspark.sql import functions as F

from parley.operators import language as L

DATA = "/root/testdata/sf0.01"
TEXTS = {
    "en": ["the weather is nice today", "we went through the woods", "nothing rhymes with orange"],
    "fr": ["le temps est beau aujourd'hui", "nous avons marché dans la forêt", "rien ne rime avec quatorze"],
    "de": ["das Wetter ist heute schön", "wir gingen durch den Wald", "nichts reimt sich auf Mensch"],
}


def rows(spark, pairs):
    return spark.createDataFrame([(i, "g", "text", t, k) for i, (k, t) in enumerate(pairs)], "seq int, group_name string, msg_type string, message string, language string")


@pytest.fixture(scope="module")
def model(spark):
    known = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    return L.language_model(rows(spark, [*known, (None, "left out"), ("xx", None)]))


def test_trigrams(spark):
    got = spark.range(1).select(L.letter_trigrams(F.lit("Été a, b2")), L.letter_trigrams(F.lit(None).cast("string"))).first()
    assert got[0] == [" ét", "été", "té ", " a ", " b2", "b2 "] and got[1] == []


def test_model_counts(spark, model):
    assert model.languages == ("de", "en", "fr")
    grams = {r.word: r.value for r in model.grams.collect()}
    counts = {lang: {} for lang in TEXTS}
    for lang, texts in TEXTS.items():
        for word in " ".join(texts).lower().replace("'", " ").split():
            for i in range(len(word)):
                gram = f" {word} "[i : i + 3]
                counts[lang][gram] = counts[lang].get(gram, 0) + 1
    assert set(grams) == set().union(*counts.values())
    import math

    for gram, values in grams.items():
        for lang, value in zip(model.languages, values, strict=True):
            n, total = counts[lang].get(gram, 0), sum(counts[lang].values())
            assert value == round(1000 * math.log((n + 0.5) / (total + 0.5 * len(grams))))
    small = L.language_model(rows(spark, [("en", "aaa aaa b")]), max_grams=2)
    assert [r.word for r in small.grams.collect()] == [" aa", "aa "]


def test_messages(spark, model):
    given = [("x", "Wald und Wetter"), ("x", "forêt"), ("x", "woods"), ("x", "123 456"), ("x", ""), ("x", None)]
    out = L.message_language(rows(spark, given), model=model)
    assert out.columns == ["seq", "group_name", "msg_type", "message", "language"]
    assert [r.language for r in out.orderBy("seq").collect()] == ["de", "fr", "en", None, None, None]
    shares = L.language_distribution(rows(spark, given), model=model).collect()
    assert {r.language: r.messages for r in shares} == {"de": 1, "fr": 1, "en": 1, "unknown": 3}


def test_groups(spark, model):
    given = rows(spark, [("x", t) for t in TEXTS["fr"]] + [("x", "woods")] * 2)
    assert [tuple(r) for r in L.detect_language(given, order=["seq"], model=model).collect()] == [("g", "fr")]
    empty = rows(spark, [("x", "1"), ("x", "")])
    assert L.detect_language(empty, order=["seq"], model=model).first().language == L.FALLBACK_LANGUAGE
    told = L.with_language(given, order=["seq"], model=model)
    assert told.select("language").distinct().count() == 1 and told.count() == 5


def test_nothing_to_learn(spark):
    with pytest.raises(ValueError, match="known language"):
        L.language_model(rows(spark, [(None, "text")]))


@pytest.mark.skipif(not glob.glob(f"{DATA}/*.parquet"), reason="needs the given tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) > 20 and lang is not null")
    docs = docs.select("doc_id", F.col("lang").alias("true_lang"), F.col("text").alias("message"))
    model = L.language_model(docs.filter("doc_id % 5 <> 0"), label="true_lang")
    held = docs.filter("doc_id % 5 = 0")
    # stop words and all short words taken out: nothing that a list could know
    bare = held.withColumn("message", F.array_join(F.filter(F.split("message", "[^a-zA-ZÀ-ÿ]+"), lambda w: F.length(w) > 6), " "))
    for texts in (held, bare.filter("length(message) > 20")):
        right = L.message_language(texts, model=model).agg(F.avg((F.col("language") == F.col("true_lang")).cast("double"))).first()[0]
        assert right >= 0.95


def test_sums_by_word_equal_those_by_trigram(spark, model, monkeypatch):
    from parley.operators import clean

    texts = ["Wald und Wetter und Wald", "", None, "zzz", "Forêt 😀 l'été", "a", "😀😀", "nothing_at all, woods"]
    given = rows(spark, [("x", t) for t in texts]).repartition(2)
    names = [f"_v_{lang}" for lang in model.languages]
    quick = L.language_scores(given, model)
    assert "ArrowEvalPython" in quick._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in quick.orderBy("seq").select(*names).collect()]
    monkeypatch.setattr(clean, "INLINE_WORDS", 0)
    assert got == [tuple(r) for r in L.language_scores(given, model).orderBy("seq").select(*names).collect()]
    assert got[1] == got[2] == (None,) * 3 and got[0][0] is not None
