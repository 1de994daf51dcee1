import pytest
from pyspark.sql import functions as F

from parley.operators import clean, language
from parley.session import attach
from tests.conftest import ts


def messages(spark, *texts, kind="text", group="g"):
    rows = [(group, ts("2024-01-01"), i, "A", t, kind) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "group_name string, timestamp timestamp_ntz, seq int, author string, message string, msg_type string"
    )


def test_punctuation_and_case(spark):
    row = clean.clean_messages(messages(spark, "Bonjour, tout le monde! C'est SUPER."), "fr", stopword_lists={}).first()
    assert row["cleaned_message"] == "bonjour tout le monde est super"
    assert row["tokens"] == row["cleaned_message"].split()
    assert row["language"] == "fr"


def test_stopwords_keep_repeated_words(spark):
    rows = messages(spark, "le chat est le chat du voisin")
    row = clean.clean_messages(rows, "fr", min_words=0).first()
    assert row["tokens"] == ["chat", "chat", "voisin"]


def test_language_fallback_is_english(spark):
    assert language.stopwords("wo") == language.stopwords("en")
    row = clean.clean_messages(messages(spark, "the house le jardin"), "wo", min_words=0).first()
    assert row["tokens"] == ["house", "le", "jardin"]


def test_artefacts_and_emoji(spark):
    rows = messages(spark, "MÉDIA OMIS quelque chose 😀 de_plus 42 x")
    row = clean.clean_messages(rows, "fr", stopword_lists={}).first()
    assert row["tokens"] == ["quelque", "chose", "de_plus", "42"]
    kept = clean.clean_messages(messages(spark, "salut😀ça va bien"), "fr", stopword_lists={}, remove_emoji=False).first()
    gone = clean.clean_messages(messages(spark, "salut😀ça va bien"), "fr", stopword_lists={}).first()
    assert kept["tokens"][:2] == ["salut", "ça"] and gone["tokens"][0] == "salutça"


@pytest.mark.parametrize("min_words,n", [(3, 0), (1, 1), (0, 1)])
def test_min_words(spark, min_words, n):
    assert clean.clean_messages(messages(spark, "ok"), "fr", min_words=min_words).count() == n


def test_only_text_is_kept(spark):
    assert clean.clean_messages(messages(spark, "un deux trois", kind="media"), "fr").count() == 0


def test_lemmas_inline_and_joined_agree(spark):
    rows = messages(spark, "les chats mangent du poisson frais", "chats chats chats", "rien du tout ici")
    lemmas = spark.createDataFrame([("chats", "chat"), ("mangent", "manger vite")], "word string, value string")
    prepared = clean.clean_messages(rows, "fr", stopword_lists={})
    inline = clean.lemmatize(prepared, lemmas).orderBy("seq").select("tokens").collect()
    joined = clean.lemmatize(prepared, lemmas, ["group_name", "seq"], inline_words=0)
    assert joined.orderBy("seq").select("tokens").collect() == inline
    composed = clean.clean_messages(rows, "fr", stopword_lists={}, lemmas=lemmas).orderBy("seq").first()
    assert composed["tokens"] == ["les", "chat", "manger", "vite", "du", "poisson", "frais"]


def test_model_lemmatizer_hook(spark):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def upper(tokens: pd.Series, lang: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: [t.upper() for t in ts])

    row = clean.clean_messages(messages(spark, "un chat noir passe"), "fr", stopword_lists={}, lemmatizer=upper).first()
    assert row["cleaned_message"] == "UN CHAT NOIR PASSE"


def test_stopword_table(spark):
    rows = spark.createDataFrame([(1, ["a", "le", "le", "b", "b"])], "id int, tokens array<string>")
    stop = spark.createDataFrame([("le",), ("le",)], "word string")
    got = clean.stopword_anti(rows, stop, ["id"]).collect()
    assert {(r["pos"], r["word"]) for r in got} == {(0, "a"), (3, "b"), (4, "b")}


def test_corpus_language(spark):
    french = messages(spark, "je ne sais pas où il est", "nous sommes avec eux", group="f")
    english = messages(spark, "this is not what you were doing", group="e")
    none = messages(spark, "xyz qwerty", group="n")
    rows = french.union(english).union(none)
    got = {r["group_name"]: r["language"] for r in language.detect_language(rows).collect()}
    assert got == {"f": "fr", "e": "en", "n": "fr"}


def test_only_the_first_ten_messages_vote(spark):
    texts = ["this is the house"] * 10 + ["je ne sais pas où il est avec nous"] * 50
    assert language.detect_language(messages(spark, *texts)).first()["language"] == "en"


def test_group_limit_runs_before_the_shuffle(spark):
    plan = language.detect_language(messages(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_per_message_language_and_shares(spark):
    rows = messages(spark, "je ne sais pas", "this is not the one", "xyz", "nous sommes avec vous")
    got = [r["language"] for r in language.message_language(rows).orderBy("seq").collect()]
    assert got == ["fr", "en", None, "fr"]
    shares = {r["language"]: r["share"] for r in language.language_distribution(rows).collect()}
    assert shares == {"fr": 0.5, "en": 0.25, "unknown": 0.25}


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast(spark, how):
    large = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(0, "zero"), (3, "three")], "k bigint, name string")
    a = attach(large, small, ["k"], how)
    b = attach(large, small, ["k"], how, max_rows=0)
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, a.select("id", "k", "name").collect()), key=str) == sorted(
        map(tuple, b.select("id", "k", "name").collect()), key=str
    )


def test_text_is_cleaned_once_per_message(spark):
    rows = clean.clean_messages(messages(spark, "un deux trois quatre"), "fr")
    plan = rows.filter(F.size("tokens") > 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(lower(") == 1


@pytest.mark.parametrize("inline_words", [0, 50_000])
def test_word_tables_give_one_value_per_token(spark, inline_words):
    table = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", None), ("c", 5.0), (None, 9.0)], "word string, value double")
    rows = spark.createDataFrame([(1, ["a", "b", "z", "a"]), (2, []), (3, None), (4, ["c"]), (5, ["c"])], "seq int, tokens array<string>")
    got = clean.values_for_tokens(rows, table, None, "values", "double", inline_words=inline_words)
    assert {r["seq"]: r["values"] for r in got.collect()} == {1: [1.0, None, None, 1.0], 2: [], 3: None, 4: [5.0], 5: [5.0]}
