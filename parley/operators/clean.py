"""Message text -> cleaned text and tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.lookup import word_lookup
from parley.functions.once import computed_once
from parley.operators import language as L
from parley.operators.lemma_rules import extended_lemmas
from parley.session import attach, checkpointed, measure

# A word table up to this size is looked up inside the expression.
INLINE_WORDS = 50_000


def filter_text(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("msg_type") == "text")


def filter_author(messages: DataFrame, author: str) -> DataFrame:
    return messages.filter(F.col("author") == author)


def words_of(message: Column, remove_emoji: bool = True) -> Column:
    """Control characters, artefacts, emoji, case, punctuation, then split."""
    text = T.strip_artefacts(T.normalize_encoding(message))
    if remove_emoji:
        text = T.strip_emoji(text)
    # one look over a text saves most of them two replacements
    return T.split_words(F.when(T.is_plain(message), T.strip_artefacts(message)).otherwise(text))


def drop_stopwords(words: Column, stop: Sequence[str]) -> Column:
    """Keep words of two or more characters that are not in ``stop``."""
    listed = list(stop)

    def keep(word: Column) -> Column:
        long_enough = F.length(word) > 1
        return long_enough & ~word.isin(listed) if listed else long_enough

    return F.filter(words, keep)


def remove_stopwords(
    words: Column, language: Column, lists: Mapping[str, Sequence[str]] | None = None
) -> Column:
    """Stop words by language: French has its own list, the rest uses English."""
    if lists is None:
        lists = {"fr": L.stopwords("fr"), "en": L.stopwords("en")}
    lists = dict(lists)
    default = lists.pop("en", ())
    result = None
    for lang, stop in lists.items():
        branch = drop_stopwords(words, stop)
        result = (
            F.when(language == lang, branch)
            if result is None
            else result.when(language == lang, branch)
        )
    rest = drop_stopwords(words, default)
    return rest if result is None else result.otherwise(rest)


def stopword_anti(
    messages: DataFrame, stop: DataFrame, row_key: Sequence[str], tokens: str = "tokens"
) -> DataFrame:
    """Token rows (row_key, pos, word) not in a stop-word *table* of any size.

    With a small table this is a broadcast join and nothing is shuffled.
    """
    exploded = messages.select(*row_key, F.posexplode_outer(tokens).alias("pos", "word"))
    exploded = exploded.filter(F.col("word").isNotNull())
    marked = attach(exploded, stop.select("word").distinct().withColumn("_stop", F.lit(True)), ["word"])
    return marked.filter(F.col("_stop").isNull()).drop("_stop")


def values_for_tokens(
    messages: DataFrame,
    table: DataFrame,
    row_key: Sequence[str] | None,
    output: str,
    value_type: str,
    tokens: str = "tokens",
    inline_words: int = INLINE_WORDS,
) -> DataFrame:
    """Add an array aligned with ``tokens``: the table's value of each, or null.

    ``table`` has columns ``word`` and ``value``; of several values of a word the
    least counts, and rows without a word are ignored.  Up to ``inline_words``
    words it becomes a lookup inside the projection: no shuffle.  A larger table
    is joined to the tokens with a salted key, once for each different token
    array, and the arrays are found again by their content (``row_key`` is not
    needed any more).  Both ways give the same result.  Eager: the table is
    checkpointed and measured.
    """
    table = checkpointed(table.filter("word is not null").groupBy("word").agg(F.min("value").alias("value")))
    rows, size = measure(table)
    if rows <= inline_words and size <= 16 * 1024 * 1024:
        find = word_lookup({r["word"]: r["value"] for r in table.collect()}, value_type)
        return messages.withColumn(output, F.transform(tokens, find))
    keys = [F.xxhash64(tokens).alias("_one"), F.xxhash64(F.lit(1), tokens).alias("_two")]
    different = messages.select(*keys, F.col(tokens).alias("_tokens")).groupBy("_one", "_two").agg(F.first("_tokens").alias("_tokens"))
    exploded = different.select("_one", "_two", F.posexplode("_tokens").alias("_pos", "word"))
    valued = attach(exploded, table, ["word"])
    arrays = valued.groupBy("_one", "_two").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "value"))), lambda x: x["value"]).alias(output)
    )
    empty = F.when(F.col(tokens).isNotNull(), F.array().cast(f"array<{value_type}>"))
    joined = messages.withColumns({"_one": keys[0], "_two": keys[1]}).join(arrays, ["_one", "_two"], "left")
    return joined.withColumn(output, F.coalesce(F.col(output), empty)).drop("_one", "_two")


def lemmatize(
    messages: DataFrame,
    lemmas: DataFrame,
    row_key: Sequence[str] | None = None,
    inline_words: int = INLINE_WORDS,
) -> DataFrame:
    """Replace tokens by their lemma where the table (word, value) has one."""
    looked = values_for_tokens(
        messages, lemmas, row_key, "_lemma", "string", inline_words=inline_words
    )
    merged = F.zip_with("tokens", "_lemma", lambda token, lemma: F.coalesce(lemma, token))
    return looked.withColumn("tokens", merged).drop("_lemma")


def min_words_filter(messages: DataFrame, min_words: int = 3, tokens: str = "tokens") -> DataFrame:
    return messages.filter(F.size(tokens) >= min_words) if min_words > 0 else messages


def clean_messages(
    messages: DataFrame,
    lang: str | None = None,
    remove_emoji: bool = True,
    min_words: int = 3,
    lemmas: DataFrame | None = None,
    lemmatizer=None,
    stopword_lists: Mapping[str, Sequence[str]] | None = None,
    language_lists: Mapping[str, Sequence[str]] | None = None,
    per_message_language: bool = False,
    keys: Sequence[str] = ("group_name",),
    order: Sequence[str] = ("timestamp", "seq"),
    row_key: Sequence[str] | None = None,
    language_model: L.LanguageModel | None = None,
    given_language: bool = False,
    lemma_rules: bool = False,
) -> DataFrame:
    """Text messages + ``cleaned_message``, ``language``, ``tokens``.

    With ``given_language`` the messages have their ``language`` already.

    ``lemmas`` is a word table, with ``lemma_rules`` extended to the other words
    by the endings it teaches (one more pass over the texts); ``lemmatizer`` is a pandas UDF on the token
    array for a model-based lemmatiser.
    """
    texts = filter_text(messages)
    if not given_language:
        texts = L.with_language(texts, lang, per_message_language, keys, order, language_lists, language_model)
    words = words_of(F.col("message"), remove_emoji)
    cleaned = computed_once(
        texts, "tokens", remove_stopwords(words, F.col("language"), stopword_lists)
    )
    if lemmas is not None:
        if lemma_rules:
            lemmas = extended_lemmas(cleaned, lemmas)
        cleaned = lemmatize(cleaned, lemmas, row_key)
    elif lemmatizer is not None:
        cleaned = cleaned.withColumn("tokens", lemmatizer(F.col("tokens"), F.col("language")))
    cleaned = cleaned.withColumn("cleaned_message", F.array_join("tokens", " "))
    if lemmas is not None or lemmatizer is not None:
        # a lemma may hold more than one word
        cleaned = computed_once(cleaned, "tokens", T.split_on_space(F.col("cleaned_message")))
    first = [c for c in messages.columns if c not in ("cleaned_message", "language", "tokens")]
    return min_words_filter(cleaned, min_words).select(
        *first, "cleaned_message", "language", "tokens"
    )
