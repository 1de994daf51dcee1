from parley.operators.clean import clean_messages
from parley.operators.lemma_rules import extended_lemmas, lemma_rules, ruled_lemmas
from tests.conftest import ts

STEMS = ["parl", "chant", "dans", "mont", "trouv", "jou", "port", "ferm", "gagn", "pass"]
ENDINGS = ["ons", "ez", "ent", "ais", "er"]
TABLE = "word string, value string"


def forms(stems):
    return [(s + e, s + "er") for s in stems for e in ENDINGS]


def test_held_out_forms(spark):
    rules = lemma_rules(spark.createDataFrame(forms(STEMS[:7]), TABLE))
    held_out = forms(STEMS[7:])
    got = {r["word"]: r["value"] for r in ruled_lemmas(spark.createDataFrame(held_out, TABLE), rules).collect()}
    assert got == {w: v for w, v in held_out if w != v}


def test_longest_ending_decides_and_doubt_changes_nothing(spark):
    table = [(f"mot{a}s", f"mot{a}") for a in "abcdefgh"] + [(f"b{a}ras", f"b{a}ras") for a in "abcd"]
    table += [("x1nt", "x1er"), ("y1nt", "y1"), ("z1nt", "zzzz"), (None, "a"), ("b", None), ("", ""), ("motas", "zz")]
    rules = {r["ending"]: (r["cut"], r["added"], r["words"], r["of"]) for r in lemma_rules(spark.createDataFrame(table, TABLE), least_share=0.6).collect()}
    assert rules["s"] == (1, "", 8, 12) and rules["ras"] == (0, "", 4, 4)
    assert "nt" not in rules and "t" not in rules
    words = spark.createDataFrame([(w,) for w in ["chats", "embarras", "as", "s", "", None, "a2bs", "chats"]], "word string")
    table = spark.createDataFrame(table, TABLE)
    got = ruled_lemmas(words, lemma_rules(table, least_share=0.6)).collect()
    assert [tuple(r) for r in got] == [("chats", "chat")]
    assert lemma_rules(table.limit(0)).count() == 0 and ruled_lemmas(words, lemma_rules(table.limit(0))).count() == 0


def test_cleaning_with_rules(spark):
    lemmas = spark.createDataFrame(forms(STEMS), TABLE)
    rows = [("g", ts("2024-01-01 10:00"), 1, "text", "marchons regardez chantent village")]
    messages = spark.createDataFrame(rows, "group_name string, timestamp timestamp_ntz, seq int, msg_type string, message string")
    plain = clean_messages(messages, lang="fr", lemmas=lemmas).first()
    ruled = clean_messages(messages, lang="fr", lemmas=lemmas, lemma_rules=True).first()
    assert plain["cleaned_message"] == "marchons regardez chanter village"
    assert ruled["cleaned_message"] == "marcher regarder chanter village"
    table = extended_lemmas(spark.createDataFrame([(["chantent", "restons"],), (None,)], "tokens array<string>"), lemmas)
    assert sorted(set(map(tuple, table.collect())) - set(forms(STEMS))) == [("restons", "rester")]


def test_the_word_table_is_computed_once(spark):
    from pyspark.sql import functions as F

    from parley.operators.lemma_rules import extended_lemmas

    seen = spark.sparkContext.accumulator(0)

    def told(word):
        seen.add(1)
        return word

    table = spark.createDataFrame([("walking", "walk"), ("talking", "talk"), ("baking", "bak")], "word string, value string")
    lemmas = table.withColumn("word", F.udf(told, "string").asNondeterministic()("word"))
    rows = spark.createDataFrame([(["joking", "walking"],)], "tokens array<string>")
    got = {tuple(r) for r in extended_lemmas(rows, lemmas).collect()}
    assert got == {("walking", "walk"), ("talking", "talk"), ("baking", "bak"), ("joking", "jok")}
    assert seen.value == 3
