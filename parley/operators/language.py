"""Language identification by stop-word votes, or by a model of letter trigrams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.once import computed_once, unnest
from parley.session import attach, checkpointed

# Language code -> name of the stop-word list bundled with Spark ML.
LISTS = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish",
    "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian",
    "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish",
}

DEFAULT_LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pt")
FALLBACK_LANGUAGE = "fr"
SAMPLE_MESSAGES = 10


@lru_cache(maxsize=None)
def stopwords(lang: str) -> tuple[str, ...]:
    """The bundled list; any language but French uses the English one."""
    name = LISTS["fr"] if lang == "fr" else LISTS["en"]
    return tuple(StopWordsRemover.loadDefaultStopWords(name))


@lru_cache(maxsize=None)
def bundled_words(lang: str) -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords(LISTS[lang]))


def vocabularies(languages: Sequence[str] = DEFAULT_LANGUAGES) -> dict[str, tuple[str, ...]]:
    return {lang: bundled_words(lang) for lang in languages}


def vote_counts(words: Column, lists: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    def votes(listed: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(listed)))

    return {lang: votes(list(lists[lang])) for lang in sorted(lists)}


def winning_language(votes: Mapping[str, Column]) -> Column:
    """Most votes; ties go to the smaller code; null without any vote."""
    best = F.greatest(*votes.values()) if len(votes) > 1 else next(iter(votes.values()))
    pick = F.when(best == 0, F.lit(None).cast("string"))
    for lang in sorted(votes):
        pick = pick.when(votes[lang] == best, F.lit(lang))
    return pick


MODEL_GRAMS = 20_000


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of letter trigrams: a table (word, value) with one
    value per language, in thousandths, in the order of ``languages``."""

    languages: tuple[str, ...]
    grams: DataFrame


def letter_trigrams(text: Column) -> Column:
    """Every three letters in a row of every word, with a space on either side of it."""

    def of_word(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))

    return F.flatten(F.transform(T.split_words(F.coalesce(text, F.lit(""))), of_word))


def language_model(labelled: DataFrame, text: str = "message", label: str = "language", max_grams: int = MODEL_GRAMS) -> LanguageModel:
    """Learn a model from texts whose language is known; rows without one are left out.

    The ``max_grams`` commonest trigrams of all languages are kept (of equally
    common ones the first), each with ln((n + 0.5) / (all + 0.5 * trigrams)) per
    language.  The texts are read once; counts alone are shuffled.
    """
    known = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull())
    words = unnest(known, [F.col(label).alias("lang")], T.split_words(F.col(text)), "word").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # the trigrams of each different word, as often as the word occurs
    counts = checkpointed(unnest(words, ["lang", "n"], letter_trigrams(F.col("word")), "word").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = tuple(sorted(r["lang"] for r in counts.select("lang").distinct().collect()))
    if not languages:
        raise ValueError("no text with a known language")
    kept = counts.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, lang in enumerate(languages)), F.sum("n").alias("n"))
    kept = checkpointed(kept.orderBy(F.desc("n"), "word").limit(max_grams))
    sums = kept.agg(F.count(F.lit(1)), *(F.sum(f"n{i}") for i in range(len(languages)))).first()
    value = [F.round(1000 * F.log((F.col(f"n{i}") + 0.5) / F.lit(sums[i + 1] + 0.5 * sums[0]))).cast("bigint") for i in range(len(languages))]
    return LanguageModel(languages, kept.select("word", F.array(*value).alias("value")))


def _inline_values(model: LanguageModel) -> dict[str, list[int]] | None:
    """The least value of each trigram, for a table small enough to travel with
    the tasks; None for a larger one or one with gaps."""
    from parley.operators.clean import INLINE_WORDS  # that module imports this one

    table = model.grams.filter("word is not null").groupBy("word").agg(F.min("value").alias("value"))
    rows = table.limit(INLINE_WORDS + 1).collect()
    whole = all(r["value"] is not None and len(r["value"]) == len(model.languages) and None not in r["value"] for r in rows)
    return {r["word"]: list(r["value"]) for r in rows} if whole and len(rows) <= INLINE_WORDS else None


def _word_sums(values: dict[str, list[int]], n_languages: int):
    """A UDF: the words of a text -> the sums of their known trigrams' values, null
    without any.  A batch looks every different word up once."""

    @F.arrow_udf("array<bigint>")
    def sums(words: pa.Array) -> pa.Array:
        sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        table = np.zeros((len(coded.dictionary), n_languages + 1), dtype=np.int64)  # last: known trigrams
        for row, word in enumerate(coded.dictionary.to_pylist()):
            padded = f" {word} "
            found = [v for i in range(len(word)) if (v := values.get(padded[i : i + 3])) is not None]
            if found:
                table[row, :-1], table[row, -1] = np.sum(found, axis=0), len(found)
        at = coded.indices.to_numpy(zero_copy_only=False)
        some, starts = sizes > 0, np.cumsum(sizes) - sizes
        out = np.zeros((len(sizes), n_languages + 1), dtype=np.int64)
        for k in range(n_languages + 1):
            if len(at):
                out[some, k] = np.add.reduceat(table[at, k], starts[some])
        return pa.array([row[:-1] if row[-1] else None for row in out.tolist()], pa.list_(pa.int64()))

    return sums


def language_scores(messages: DataFrame, model: LanguageModel, text: str = "message", prefix: str = "_v_") -> DataFrame:
    """Add a column per language with the log probability of the message's known
    trigrams, null without any."""
    from parley.operators.clean import values_for_tokens  # that module imports this one

    kept = messages.columns
    values = _inline_values(model)
    if values is not None:
        words = computed_once(messages, "_words", T.split_words(F.coalesce(F.col(text), F.lit(""))))
        rows = computed_once(words, "_sums", _word_sums(values, len(model.languages))("_words"))
        return rows.select(*kept, *(F.get("_sums", i).alias(f"{prefix}{lang}") for i, lang in enumerate(model.languages)))
    rows = computed_once(messages, "_grams", letter_trigrams(F.col(text)))
    rows = values_for_tokens(rows, model.grams, None, "_found", "array<bigint>", tokens="_grams")
    rows = computed_once(rows, "_found", F.filter("_found", lambda v: v.isNotNull()))

    def total(i: int) -> Column:
        return F.when(F.size("_found") > 0, F.aggregate("_found", F.lit(0).cast("bigint"), lambda acc, v: acc + F.get(v, i)))

    return rows.select(*kept, *(total(i).alias(f"{prefix}{lang}") for i, lang in enumerate(model.languages)))


def likeliest_language(scores: Mapping[str, Column]) -> Column:
    """Greatest score; ties go to the smaller code; null without a score."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.coalesce(*(F.when(scores[lang] == best, F.lit(lang)) for lang in sorted(scores)))


def message_language(
    messages: DataFrame,
    lists: Mapping[str, Sequence[str]] | None = None,
    text: str = "message",
    output: str = "language",
    model: LanguageModel | None = None,
) -> DataFrame:
    """Language of each single message; null when no list word (with a model: no
    known trigram) occurs."""
    if model is not None:
        scored = language_scores(messages, model, text)
        best = likeliest_language({lang: F.col(f"_v_{lang}") for lang in model.languages})
        return scored.select(*[c for c in messages.columns if c != output], best.alias(output))
    lists = lists or vocabularies()
    kept = messages.columns
    voted = messages.withColumn("_words", T.split_words(F.col(text)))
    for lang, votes in vote_counts(F.col("_words"), lists).items():
        voted = voted.withColumn(f"_v_{lang}", votes)
    named = {lang: F.col(f"_v_{lang}") for lang in lists}
    return voted.withColumn(output, winning_language(named)).select(
        *[c for c in kept if c != output], output
    )


def detect_language(
    messages: DataFrame,
    keys: Sequence[str] = ("group_name",),
    order: Sequence[str] = ("timestamp", "seq"),
    lists: Mapping[str, Sequence[str]] | None = None,
    model: LanguageModel | None = None,
) -> DataFrame:
    """One language per group, voted by its first ten text messages, or likeliest
    for them by a model.

    The top-10 filter runs before the shuffle (partial group limit), so even
    the largest group sends ten rows per task.
    """
    lists = lists or vocabularies()
    first = Window.partitionBy(*keys).orderBy(*order)
    sample = (
        messages.filter((F.col("msg_type") == "text") & F.col("message").isNotNull())
        .select(*dict.fromkeys([*keys, *order, "message"]))
        .withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= SAMPLE_MESSAGES)
    )
    if model is not None:
        columns = [f"_v_{lang}" for lang in model.languages]
        summed = language_scores(sample, model).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))
        winner = likeliest_language({lang: F.col(f"_v_{lang}") for lang in model.languages})
        return summed.select(*keys, F.coalesce(winner, F.lit(FALLBACK_LANGUAGE)).alias("language"))
    sample = sample.withColumn("_words", T.split_words(F.col("message")))
    counted = sample.select(
        *keys, *(v.alias(f"_v_{lang}") for lang, v in vote_counts(F.col("_words"), lists).items())
    )
    summed = counted.groupBy(*keys).agg(
        *(F.sum(f"_v_{lang}").alias(f"_v_{lang}") for lang in sorted(lists))
    )
    winner = winning_language({lang: F.col(f"_v_{lang}") for lang in lists})
    return summed.select(*keys, F.coalesce(winner, F.lit(FALLBACK_LANGUAGE)).alias("language"))


def with_language(
    messages: DataFrame,
    lang: str | None = None,
    per_message: bool = False,
    keys: Sequence[str] = ("group_name",),
    order: Sequence[str] = ("timestamp", "seq"),
    lists: Mapping[str, Sequence[str]] | None = None,
    model: LanguageModel | None = None,
) -> DataFrame:
    """Add ``language``: forced, per message, or detected per group."""
    if lang is not None:
        return messages.withColumn("language", F.lit(lang))
    if per_message:
        voted = message_language(messages, lists, model=model)
        return voted.withColumn("language", F.coalesce("language", F.lit(FALLBACK_LANGUAGE)))
    detected = detect_language(messages, keys, order, lists, model)
    return attach(messages.drop("language"), detected, list(keys))


def language_distribution(
    messages: DataFrame,
    keys: Sequence[str] = ("group_name",),
    lists: Mapping[str, Sequence[str]] | None = None,
    model: LanguageModel | None = None,
) -> DataFrame:
    """Share of messages per language; messages without a vote are 'unknown'."""
    voted = message_language(messages, lists, model=model).withColumn(
        "language", F.coalesce("language", F.lit("unknown"))
    )
    counts = voted.groupBy(*keys, "language").agg(F.count(F.lit(1)).alias("messages"))
    # at most one row per language and group from here on
    total = F.sum("messages").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.col("messages") / total)
