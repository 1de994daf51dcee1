"""Cleaning and language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions import text as T
from parley.functions.once import computed_once, unnest
from parley.operators import clean, language, lemma_rules
from parley.operators.parse import classify_messages
from parley.plans.queries.registry import bundled_list, query, sql_list, sql_string
from parley.plans.queries.views import (
    CHAT,
    CHAT_TYPED,
    DOCS,
    chat_messages,
    document_messages,
    load,
    query_languages,
    stop_sql,
    vote_sql,
    winner_sql,
    words_sql,
)
from parley.session import saved

W = "WITH " + CHAT
WD = "WITH " + DOCS


@query(
    "strip_artefacts",
    W + f"SELECT seq, regexp_replace(message, {sql_string('(?i)' + P.ARTEFACTS)}, '', 'g') AS text FROM cm0",
)
def strip_artefacts(spark, d):
    return chat_messages(spark, d).select("seq", T.strip_artefacts(F.col("message")).alias("text"))


@query("strip_emoji", W + f"SELECT seq, regexp_replace(message, {sql_string(P.EMOJI)}, '', 'g') AS text FROM cm0")
def strip_emoji(spark, d):
    return chat_messages(spark, d).select("seq", T.strip_emoji(F.col("message")).alias("text"))


@query(
    "lower_strip_punct",
    W + f"SELECT seq, array_to_string({words_sql('message', emoji=False)}, ' ') AS text FROM cm0",
)
def lower_strip_punct(spark, d):
    words = clean.words_of(F.col("message"), remove_emoji=False)
    return chat_messages(spark, d).select("seq", F.array_join(words, " ").alias("text"))


@query(
    "tokenize",
    WD
    + f", t AS (SELECT seq, {words_sql('message')} AS ws FROM dm) "
    + "SELECT seq, CAST(len(ws) AS INTEGER) AS n_tokens, md5(array_to_string(ws, ' ')) AS tokens_md5 FROM t",
)
def tokenize(spark, d):
    words = clean.words_of(F.col("message"))
    rows = computed_once(document_messages(spark, d).select("seq", "message"), "ws", words)
    return rows.select("seq", F.size("ws").alias("n_tokens"), F.md5(F.array_join("ws", " ")).alias("tokens_md5"))


def _stopped(spark, d, lang):
    words = clean.words_of(F.col("message"))
    kept = clean.remove_stopwords(words, lang)
    return document_messages(spark, d).select("seq", F.array_join(kept, " ").alias("text"))


@query(
    "remove_stopwords",
    lambda: WD
    + f", t AS (SELECT seq, true_lang, {words_sql('message')} AS ws FROM dm) "
    + f"SELECT seq, array_to_string({stop_sql('ws', 'true_lang')}, ' ') AS text FROM t",
)
def remove_stopwords(spark, d):
    return _stopped(spark, d, F.col("true_lang"))


@query(
    "stopword_language_fallback",
    lambda: WD
    + f", t AS (SELECT seq, {words_sql('message')} AS ws FROM dm) "
    + f"SELECT seq, array_to_string({stop_sql('ws', chr(39) + 'wo' + chr(39))}, ' ') AS text FROM t",
)
def stopword_language_fallback(spark, d):
    return _stopped(spark, d, F.lit("wo"))


@query(
    "stopword_anti",
    lambda: WD
    + f""", t AS (SELECT seq, unnest({words_sql('message')}) AS word FROM dm)
SELECT seq, word, count(*) AS n FROM t WHERE NOT list_contains({sql_list(bundled_list('english'))}, word) GROUP BY ALL""",
)
def stopword_anti(spark, d):
    words = clean.words_of(F.col("message"))
    rows = computed_once(document_messages(spark, d).select("seq", "message"), "tokens", words)
    stop = spark.createDataFrame([(w,) for w in language.stopwords("en")], "word string")
    kept = clean.stopword_anti(rows, stop, ["seq"])
    return kept.groupBy("seq", "word").agg(F.count(F.lit(1)).alias("n"))


# lemmas: the hundred most frequent words lose their last letter
_LEMMAS = """lm AS (SELECT word, word[1:length(word)-1] AS lemma FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) WHERE length(word) > 2
  GROUP BY word ORDER BY n DESC, word LIMIT 100))"""


@query(
    "lemmatize",
    lambda: WD
    + f", t AS (SELECT seq, {stop_sql(words_sql('message'))} AS ws FROM dm), "
    + _LEMMAS
    + """, u AS (SELECT seq, ws[i] AS word, i FROM (SELECT seq, ws, unnest(range(1, len(ws) + 1)) AS i FROM t))
SELECT t.seq, coalesce(string_agg(coalesce(lemma, u.word), ' ' ORDER BY i), '') AS text
FROM t LEFT JOIN u USING (seq) LEFT JOIN lm ON lm.word = u.word GROUP BY t.seq""",
)
def lemmatize(spark, d):
    words = clean.drop_stopwords(clean.words_of(F.col("message")), ())
    rows = computed_once(document_messages(spark, d).select("seq", "message"), "tokens", words)
    rows = rows.drop("message")
    from parley.operators.topics import word_frequency

    top = word_frequency(
        rows.select(F.filter("tokens", lambda w: F.length(w) > 2).alias("tokens")), 100
    )
    lemmas = top.select("word", F.expr("substring(word, 1, length(word) - 1)").alias("value"))
    out = clean.lemmatize(rows, lemmas, ["seq"])
    return out.select("seq", F.array_join("tokens", " ").alias("text"))


@query(
    "min_words_filter",
    WD
    + f", t AS (SELECT seq, len({words_sql('message')}) AS n FROM dm) "
    + "SELECT seq, CAST(n AS INTEGER) AS n FROM t WHERE n >= 50",
)
def min_words_filter(spark, d):
    words = clean.words_of(F.col("message"))
    rows = computed_once(document_messages(spark, d).select("seq", "message"), "tokens", words)
    return clean.min_words_filter(rows, 50).select("seq", F.size("tokens").alias("n"))


_VOTES = lambda: ", ".join(f"{v} AS v_{lang}" for lang, v in vote_sql("ws").items())
_SUMS = ", ".join(f"sum(v_{lang}) AS v_{lang}" for lang in ("de", "en", "es", "fr"))


def _group_language(view: str, order: str) -> str:
    return f"""firsts AS (SELECT * FROM (SELECT group_name, message,
    row_number() OVER (PARTITION BY group_name ORDER BY {order}) AS rn FROM {view} WHERE msg_type = 'text') WHERE rn <= 10),
fw AS (SELECT group_name, {words_sql('message', emoji=False)} AS ws FROM firsts),
fv AS (SELECT group_name, {_VOTES()} FROM fw),
fs AS (SELECT group_name, {_SUMS} FROM fv GROUP BY group_name),
gl AS (SELECT group_name, coalesce({winner_sql()}, 'fr') AS language FROM fs)"""


@query(
    "detect_language_corpus",
    lambda: WD + ", " + _group_language("dm", '"timestamp", seq') + "SELECT * FROM gl",
)
def detect_language_corpus(spark, d):
    return language.detect_language(document_messages(spark, d), lists=query_languages())


@query("force_language", WD + "SELECT seq, 'en' AS language FROM dm")
def force_language(spark, d):
    return language.with_language(document_messages(spark, d), "en").select("seq", "language")


@query(
    "message_language",
    lambda: WD
    + f""", w AS (SELECT seq, {words_sql('message', emoji=False)} AS ws FROM dm), v AS (SELECT seq, {_VOTES()} FROM w)
SELECT seq, {winner_sql()} AS language FROM v""",
)
def message_language(spark, d):
    return language.message_language(document_messages(spark, d), query_languages()).select(
        "seq", "language"
    )


@query(
    "language_distribution",
    lambda: WD
    + f""", w AS (SELECT group_name, {words_sql('message', emoji=False)} AS ws FROM dm),
v AS (SELECT group_name, {_VOTES()} FROM w),
l AS (SELECT group_name, coalesce({winner_sql()}, 'unknown') AS language FROM v)
SELECT group_name, language, count(*) AS messages,
round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY group_name) AS DOUBLE), 6) AS share FROM l GROUP BY group_name, language""",
)
def language_distribution(spark, d):
    out = language.language_distribution(document_messages(spark, d), lists=query_languages())
    return out.withColumn("share", F.round("share", 6))


# A trigram model learned from four fifths of the documents.
_TRIGRAMS = f""", t AS (SELECT seq, group_name, true_lang, "timestamp", msg_type,
  list_filter(string_split_regex(lower(message), {sql_string(P.NON_WORD)}), lambda w: w <> '') AS ws FROM dm),
g AS (SELECT seq, true_lang, substr(' ' || w || ' ', i, 3) AS gram FROM (
  SELECT seq, true_lang, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT seq, true_lang, unnest(ws) AS w FROM t))),
c AS (SELECT gram, true_lang AS lang, count(*) AS n FROM g WHERE seq % 5 <> 0 AND true_lang IS NOT NULL GROUP BY ALL),
kept AS (SELECT gram FROM c GROUP BY gram ORDER BY sum(n) DESC, gram LIMIT {language.MODEL_GRAMS}),
ls AS (SELECT lang, sum(n) AS total FROM c SEMI JOIN kept USING (gram) GROUP BY lang),
m AS (SELECT gram, lang, CAST(round(1000 * ln((coalesce(n, 0) + CAST(0.5 AS DOUBLE)) / (total + 0.5 * (SELECT count(*) FROM kept)))) AS BIGINT) AS v
  FROM (SELECT * FROM kept, ls) LEFT JOIN c USING (gram, lang)),
sc AS (SELECT seq, m.lang, sum(v) AS score FROM g JOIN m USING (gram) GROUP BY ALL)"""


def trigram_model(spark, d):
    known = document_messages(spark, d).filter(F.col("seq") % 5 != 0)
    return language.language_model(known, label="true_lang")


@query(
    "message_language_model",
    WD + _TRIGRAMS + """, best AS (SELECT seq, lang FROM sc QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, lang) = 1)
SELECT t.seq, best.lang AS language FROM t LEFT JOIN best USING (seq)""",
)
def message_language_model(spark, d):
    """Language of every document by trigrams, stop words or not."""
    out = language.message_language(document_messages(spark, d), model=trigram_model(spark, d))
    return out.select("seq", "language")


@query(
    "detect_language_model",
    WD + _TRIGRAMS + """, firsts AS (SELECT group_name, seq FROM t WHERE msg_type = 'text'
  QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY "timestamp", seq) <= 10),
gs AS (SELECT group_name, lang, sum(score) AS score FROM firsts JOIN sc USING (seq) GROUP BY ALL),
best AS (SELECT group_name, lang FROM gs QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY score DESC, lang) = 1)
SELECT group_name, coalesce(lang, 'fr') AS language FROM (SELECT DISTINCT group_name FROM firsts) LEFT JOIN best USING (group_name)""",
)
def detect_language_model(spark, d):
    """Language of every group by the trigrams of its first ten messages."""
    return language.detect_language(document_messages(spark, d), model=trigram_model(spark, d))


_CLEANED = lambda: (
    "WITH "
    + CHAT_TYPED
    + ", "
    + _group_language("cm", '"timestamp", seq')
    + f""", w AS (SELECT cm.*, {words_sql('message')} AS ws FROM cm WHERE msg_type = 'text'),
k AS (SELECT seq, group_name, author, language, {stop_sql('ws', 'language')} AS tokens FROM w JOIN gl USING (group_name)),
cl AS (SELECT * FROM k WHERE len(tokens) >= 3)"""
)


@query(
    "clean_messages",
    lambda: _CLEANED()
    + "SELECT seq, group_name, author, language, array_to_string(tokens, ' ') AS cleaned_message, CAST(len(tokens) AS INTEGER) AS n_tokens FROM cl",
)
def clean_messages(spark, d):
    messages = classify_messages(chat_messages(spark, d))
    out = clean.clean_messages(messages, language_lists=query_languages())
    return out.select(
        "seq", "group_name", "author", "language", "cleaned_message", F.size("tokens").alias("n_tokens")
    )


@query(
    "avg_message_length",
    lambda: _CLEANED()
    + "SELECT group_name, author, round(avg(len(tokens)), 6) AS avg_message_length FROM cl GROUP BY ALL",
)
def avg_message_length(spark, d):
    from parley.operators.users import avg_message_length as average

    messages = classify_messages(chat_messages(spark, d))
    out = average(clean.clean_messages(messages, language_lists=query_languages()))
    return out.withColumn("avg_message_length", F.round("avg_message_length", 6))


@query(
    "word_frequency",
    lambda: WD
    + f""", t AS (SELECT {stop_sql(words_sql('message'), 'true_lang')} AS ws FROM dm)
SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word ORDER BY n DESC, word LIMIT 80""",
)
def word_frequency(spark, d):
    from parley.operators.topics import word_frequency as frequency

    words = clean.remove_stopwords(clean.words_of(F.col("message")), F.col("true_lang"))
    return frequency(computed_once(document_messages(spark, d), "tokens", words), 80)


@query(
    "word_frequency_by_group",
    lambda: WD
    + f""", t AS (SELECT group_name, {stop_sql(words_sql('message'), 'true_lang')} AS ws FROM dm),
c AS (SELECT group_name, word, count(*) AS n FROM (SELECT group_name, unnest(ws) AS word FROM t) GROUP BY ALL)
SELECT group_name, word, n FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY n DESC, word) AS rn FROM c) WHERE rn <= 15""",
)
def word_frequency_by_group(spark, d):
    from parley.operators.topics import word_frequency as frequency

    words = clean.remove_stopwords(clean.words_of(F.col("message")), F.col("true_lang"))
    tokens = computed_once(document_messages(spark, d), "tokens", words)
    return frequency(tokens, 15, keys=["group_name"])


# A word table with every word of even length, and what it teaches about the others.
_STEMS = "(?:tions|tion|ings|ing|ed|es|s)$"
_TAUGHT = f""", t AS (SELECT DISTINCT unnest({words_sql('message')}) AS word FROM dm),
known AS (SELECT word, regexp_replace(word, '{_STEMS}', '') AS value FROM t WHERE length(word) % 2 = 0),
same AS (SELECT *, len(list_filter(range(1, least(length(word), length(value)) + 1), lambda n: word[1:n] = value[1:n])) AS kept FROM known),
changes AS (SELECT word, length(word) - kept AS cut, substr(value, kept + 1) AS added FROM same WHERE kept >= 2),
ends AS (SELECT *, right(word, size) AS ending FROM (SELECT *, unnest(range(1, least(length(word) - 2, 6) + 1)) AS size FROM changes)),
votes AS (SELECT ending, cut, added, count(*) AS words FROM ends GROUP BY ALL),
best AS (SELECT * FROM votes WHERE cut <= length(ending) QUALIFY row_number() OVER (PARTITION BY ending ORDER BY words DESC, cut, added) = 1),
rules AS (SELECT best.*, total FROM best JOIN (SELECT ending, sum(words) AS total FROM votes GROUP BY 1) USING (ending)
  WHERE words >= 3 AND words >= CAST(0.7 AS DOUBLE) * total),
others AS (SELECT word, unnest(range(1, least(length(word) - 2, 6) + 1)) AS size FROM t
  WHERE length(word) % 2 = 1 AND regexp_matches(word, '^\\p{{L}}+$')),
ruled AS (SELECT word, left(word, length(word) - cut) || added AS value FROM others JOIN rules ON ending = right(word, size)
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY size DESC) = 1)"""


def _taught(spark, d):
    tokens = clean.words_of(F.col("message"))
    rows = computed_once(document_messages(spark, d).select("message"), "tokens", tokens)
    # read once for the word table and once for the other words
    rows = saved(rows.select("tokens"), "tokens")
    known = unnest(rows, [], "tokens", "word").distinct().filter(F.length("word") % 2 == 0)
    return rows, known.withColumn("value", F.regexp_replace("word", _STEMS, ""))


@query(
    "lemma_rules",
    WD + _TAUGHT + "SELECT ending, CAST(cut AS INTEGER) AS cut, added, words, CAST(total AS BIGINT) AS \"of\" FROM rules",
)
def rules_of_lemmas(spark, d):
    return lemma_rules.lemma_rules(_taught(spark, d)[1])


@query(
    "lemmas_by_rule",
    WD + _TAUGHT + "SELECT word, value FROM known UNION ALL SELECT word, value FROM ruled WHERE value <> word",
)
def lemmas_by_rule(spark, d):
    return lemma_rules.extended_lemmas(*_taught(spark, d))
