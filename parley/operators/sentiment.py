"""Sentiment: lexicon scores, labels, summaries and a hook for a model."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions import text as T
from parley.functions.lookup import word_lookup
from parley.functions.once import computed_once, unnest
from parley.operators.clean import INLINE_WORDS, values_for_tokens
from parley.operators.temporal import timed
from parley.session import attach, checkpointed, measure

log = logging.getLogger(__name__)

# --- fixed values: the rule-based scorer of Hutto & Gilbert (2014) -----------
BOOST = 0.293
NEGATE = -0.74
NEVER_SO = 1.25
DISTANCE_DAMPING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
ALPHA = 15
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply "
    "effing enormous enormously entirely especially exceptional exceptionally extreme "
    "extremely fabulously flipping flippin frackin fracking fricking frickin frigging "
    "friggin fully fuckin fucking fuggin fugging greatly hella highly hugely incredible "
    "incredibly intensely major majorly more most particularly purely quite really "
    "remarkably so substantially thoroughly total totally tremendous tremendously uber "
    "unbelievably unusually utter utterly very"
).split()
DAMPENERS = (
    "almost barely hardly kinda kindof less little marginal marginally occasional "
    "occasionally partly scarce scarcely slight slightly somewhat sorta sortof"
).split()
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt "
    "mightnt mustnt neither neednt never none nope nor not nothing nowhere oughtnt shant "
    "shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite"
).split()
# --- end of fixed values ------------------------------------------------------
# Words that change others or do not count as they are; next to none of them a value stays as it is.
MODIFIERS = [*INTENSIFIERS, *DAMPENERS, *NEGATIONS, "no", "least"]


def sentiment_label(score: Column) -> Column:
    return (
        F.when(score > P.POSITIVE_ABOVE, "positive")
        .when(score < P.NEGATIVE_BELOW, "negative")
        .otherwise("neutral")
    )


def _one_of(word: Column, *names: str) -> Column:
    return F.coalesce(word.isin(*names), F.lit(False))


def _look_back(words: Column, values: Column, i: Column, v: Column, n: Column, boost: Callable) -> Column:
    """Valence ``v`` of word i after looking at the n-th word before it."""
    word = F.get(words, i - n)
    damping = F.get(F.array(*map(F.lit, DISTANCE_DAMPING)), n - 1)
    push = F.coalesce(boost(word), F.lit(0.0)) * damping
    boosted = v + F.when(v < 0, -push).otherwise(push)
    b1, b2 = F.get(words, i - 1), F.get(words, i - 2)
    near = ((n >= 2) & _one_of(b1, "so", "this")) | ((n == 3) & _one_of(b2, "so", "this"))
    sure = ((n >= 2) & _one_of(b1, "doubt")) | ((n == 3) & _one_of(b2, "doubt"))
    turned = (
        F.when(_one_of(word, "never") & near, boosted * NEVER_SO)
        .when(_one_of(word, "without") & sure, boosted)
        .when(_one_of(word, *NEGATIONS), boosted * NEGATE)
        .otherwise(boosted)
    )
    # only words outside the lexicon modify
    modifies = word.isNotNull() & F.get(values, i - n).isNull()
    return F.when(modifies, turned).otherwise(v)


def _adjusted(words: Column, values: Column, i: Column, boost: Callable) -> Column:
    """Valence of word i after looking at the three words before it."""
    value = F.get(values, i)
    b1, b2, b3 = (F.get(words, i - n) for n in (1, 2, 3))
    # "no": a mere determiner before another lexicon word, else a negation
    no_before = _one_of(b1, "no") | _one_of(b2, "no") | (_one_of(b3, "no") & _one_of(b1, "or", "nor"))
    determiner = (F.get(words, i) == "no") & F.get(values, i + 1).isNotNull()
    start = F.when(no_before, value * NEGATE).when(determiner, F.lit(0.0)).otherwise(value)
    # "least" negates, but not in "at least" / "very least"
    least = _one_of(b1, "least") & F.get(values, i - 1).isNull() & ~_one_of(b2, "at", "very")
    # aggregate() binds the running value, so that each step computes it once
    return F.aggregate(
        F.array(F.lit(1), F.lit(2), F.lit(3)),
        start,
        lambda v, n: _look_back(words, values, i, v, n, boost),
        lambda v: F.when(least, v * NEGATE).otherwise(v),
    )


def modifies(words: Column) -> Column:
    """For each token whether it is one of ``MODIFIERS``."""
    return F.transform(words, lambda word: word.isin(MODIFIERS))


def total_valence(words: Column, values: Column, but_at: Column, marks: Column, fixed: Column | None = None) -> Column:
    """Sum of the adjusted valences of a token array, not yet normalised.

    ``but_at`` is the index of the first "but" or -1; ``marks`` is ``modifies``
    of the words; ``fixed`` has the valences
    that no neighbouring word changes.  All arguments must be plain columns:
    they are read for every token.
    """
    boosters = {w: BOOST for w in INTENSIFIERS} | {w: -BOOST for w in DAMPENERS}
    boost = word_lookup(boosters, "double")

    def valence(value: Column, i: Column) -> Column:
        contrast = (
            F.when((but_at >= 0) & (i < but_at), BEFORE_BUT)
            .when((but_at >= 0) & (i > but_at), AFTER_BUT)
            .otherwise(1.0)
        )
        near = reduce(Column.__or__, (F.coalesce(F.get(marks, i - n), F.lit(False)) for n in range(4)))
        own = (
            F.when(value.isNull(), 0.0)
            .when(~near, value * contrast)
            .when(boost(F.get(words, i)).isNull(), _adjusted(words, values, i, boost) * contrast)
            .otherwise(0.0)
        )
        return own if fixed is None else F.coalesce(F.get(fixed, i) * contrast, own)

    return F.aggregate(F.transform(values, valence), F.lit(0.0), lambda acc, v: acc + v)


def normalise_score(total: Column) -> Column:
    score = total / F.sqrt(total * total + F.lit(float(ALPHA)))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 4)


LONGEST_PHRASE = 5  # words


def consecutive(tokens: str, n: int, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Every n consecutive tokens, joined by a space, in order.

    Where the first of them is at an index that is not ``wanted`` the text is empty.
    """

    def phrase(i: Column) -> Column:
        joined = F.array_join(F.slice(tokens, i, n), " ")
        return joined if wanted is None else F.when(wanted(i - 1), joined).otherwise("")

    at = F.sequence(F.lit(1), F.size(tokens) - n + 1)
    return F.when(F.size(tokens) >= n, F.transform(at, phrase)).otherwise(F.array().cast("array<string>"))


def _role(n: int, k: int) -> int:
    """The bit of the k-th word (from 0) of a phrase of n words."""
    return 1 << (n * (n - 1) // 2 + k)


def _roles(phrases: DataFrame, lengths: Sequence[int]) -> Callable[[Column], Column] | None:
    """A function word -> bits of the places that it has in phrases, 0 for other
    words; None where the phrases have too many words for a lookup."""
    places = reduce(
        DataFrame.union,
        (phrases.filter(F.col("n") == n).select(F.get(F.split("word", " "), k).alias("word"), F.lit(_role(n, k)).alias("role")) for n in lengths for k in range(n)),
    )
    table = checkpointed(places.groupBy("word").agg(F.bit_or("role").alias("role")))
    rows, size = measure(table)
    if rows > INLINE_WORDS or size > 16 * 1024 * 1024:
        return None
    find = word_lookup({r["word"]: r["role"] for r in table.collect()}, "int")
    return lambda word: F.coalesce(find(word), F.lit(0))


# Of phrases of one length; those of three lengths fit the 65,536 keys of Spark's fast map.
BUCKETS = 1 << 14
FINER = 16  # parts of a bucket


def _bucketed(messages: DataFrame, lengths: Sequence[int], tokens: str, buckets: int) -> DataFrame:
    """One row for each run of n tokens, for each n: the row's tokens, the index of
    the first of them, n and the phrase's bucket, numbered from n * ``buckets``."""
    hashed = computed_once(messages.select(tokens), "_hashes", F.transform(tokens, lambda word: F.xxhash64(word)))
    placed = hashed.select(tokens, "_hashes", F.posexplode("_hashes").alias("_at", "_hash"))
    numbers = [
        F.when(F.col("_at") + n <= F.size("_hashes"), F.pmod(F.xxhash64(*[F.get("_hashes", F.col("_at") + k) for k in range(n)]), F.lit(buckets)) + n * buckets)
        for n in lengths
    ]
    return placed.select(tokens, "_at", F.explode(F.array(*numbers)).alias("_bucket")).filter("_bucket is not null")


def _length_of(bucket: str, buckets: int) -> Column:
    return F.shiftright(bucket, buckets.bit_length() - 1).cast("int")


def _sums(grams: DataFrame, buckets: int) -> DataFrame:
    """How many rows each bucket has, and of phrases of how many words."""
    sums = grams.groupBy("_bucket").agg(F.count(F.lit(1)).alias("count"))
    return checkpointed(sums.withColumn("n", _length_of("_bucket", buckets)))


def _phrase_counts(grams: DataFrame, chosen: DataFrame, lengths: Sequence[int], tokens: str, buckets: int) -> DataFrame:
    """How often each phrase of the chosen buckets occurs: n words, phrase, count."""
    found = grams.join(F.broadcast(chosen.select("_bucket")), "_bucket", "left_semi").withColumn("n", _length_of("_bucket", buckets))
    found = found.select("n", F.slice(tokens, F.col("_at") + 1, F.col("n")).alias("_words"))
    phrase = F.coalesce(*(F.when(F.col("n") == n, consecutive("_words", n)) for n in lengths))
    return checkpointed(unnest(found, ["n"], phrase, "phrase").groupBy("n", "phrase").agg(F.count(F.lit(1)).alias("count")))


def frequent_phrases(messages: DataFrame, top: Mapping[int, int], tokens: str = "tokens") -> DataFrame:
    """The ``top[n]`` most frequent phrases of n words for each n: phrase, n, count.

    Of equally frequent ones the first in the order of the phrase.  Tokens are
    words: not null, without spaces.  Eager.

    Nearly all runs of words are rare, so counting each would shuffle the texts
    several times over.  They are counted by bucket of their hash first: no phrase
    is more frequent than its bucket.  The phrases of the heaviest buckets are
    counted one by one, which shows how frequent the last of the top is at least;
    then those of all other buckets that reach this count, or where these hold
    much, of their parts that reach it.  Hence the result is exact; it costs more
    if the top is hardly more frequent than the other phrases.
    """
    lengths = sorted(top)
    grams = _bucketed(messages, lengths, tokens, BUCKETS)
    sums = _sums(grams, BUCKETS)
    heaviest = checkpointed(reduce(DataFrame.union, (sums.filter(F.col("n") == n).orderBy(F.desc("count"), "_bucket").limit(4 * top[n]) for n in lengths)))
    counts = _phrase_counts(grams, heaviest, lengths, tokens, BUCKETS)

    def best(n: int) -> DataFrame:
        return counts.filter(F.col("n") == n).orderBy(F.desc("count"), "phrase").limit(top[n])

    least = {n: best(n).agg(F.min("count")).first()[0] or 0 for n in lengths}

    def reaching(buckets: DataFrame) -> DataFrame:
        return buckets.filter(reduce(Column.__or__, ((F.col("n") == n) & (F.col("count") >= least[n]) for n in lengths)))

    others, buckets = checkpointed(reaching(sums).join(heaviest, "_bucket", "left_anti")), BUCKETS
    held = others.agg(F.sum("count")).first()[0] or 0
    if held * 8 > (sums.agg(F.sum("count")).first()[0] or 0):
        buckets = BUCKETS * FINER
        grams = _bucketed(messages, lengths, tokens, buckets)
        whole = _length_of("_bucket", buckets) * F.lit(BUCKETS) + F.pmod("_bucket", F.lit(BUCKETS))
        parts = grams.withColumn("_whole", whole.cast("bigint")).join(F.broadcast(others.select(F.col("_bucket").alias("_whole"))), "_whole", "left_semi")
        others = checkpointed(reaching(_sums(parts, buckets)))
    if held:
        counts = counts.union(_phrase_counts(grams, others, lengths, tokens, buckets))
    return reduce(DataFrame.union, map(best, lengths)).select("phrase", "n", "count")


def with_phrases(
    messages: DataFrame, phrases: DataFrame, row_key: Sequence[str] | None, tokens: str, values: str, output: str
) -> DataFrame:
    """Let phrases of a table (phrase, value) override the values of their words.

    Of the phrases that cover a word the longest holds it, of equally long ones
    the first.  A phrase counts, at its last word, if it holds that word; the
    other words that phrases cover are worth 0.  ``output`` gets the value of each
    token that a phrase covers, ``values`` is changed.
    Phrases have up to ``LONGEST_PHRASE`` words, separated by single spaces.
    """
    phrases = checkpointed(phrases.filter("phrase is not null").select(F.col("phrase").alias("word"), "value", F.size(F.split("phrase", " ")).alias("n")))
    lengths = [r["n"] for r in phrases.select("n").distinct().orderBy(F.desc("n")).limit(LONGEST_PHRASE + 1).collect()]
    if lengths and lengths[0] > LONGEST_PHRASE:
        raise ValueError(f"phrases have up to {LONGEST_PHRASE} words, not {lengths[0]}")
    kept = messages.columns
    roles = _roles(phrases, lengths) if lengths else None
    if roles is not None:
        messages = computed_once(messages, "_roles", F.transform(tokens, roles))

    def fits(n: int) -> Callable[[Column], Column] | None:
        """Whether the n tokens from index i on have the places of a phrase's words."""
        if roles is None or n == 1:
            return None
        return lambda i: reduce(Column.__and__, (F.get("_roles", i + k).bitwiseAND(_role(n, k)) != 0 for k in range(n)))

    for n in lengths:
        messages = computed_once(messages, f"_grams{n}", consecutive(tokens, n, fits(n)))
        messages = values_for_tokens(messages, phrases.filter(F.col("n") == n).select("word", "value"), row_key, f"_phrase{n}", "double", tokens=f"_grams{n}")
        messages = computed_once(messages, f"_phrase{n}", F.col(f"_phrase{n}"))

    def holder(i: Column) -> Column:
        """Value of the phrase that holds token i, 0 unless the token is its last."""
        held = [
            value if back == 0 else F.when(value.isNotNull(), 0.0)
            for n in lengths
            for back in range(n)
            for value in [F.get(f"_phrase{n}", i - (n - 1 - back))]
        ]
        found = F.coalesce(*held)
        return found if roles is None else F.when(F.get("_roles", i) != 0, found)

    if not lengths:
        return messages.withColumn(output, F.transform(values, lambda _: F.lit(None).cast("double")))
    messages = computed_once(messages, output, F.transform(tokens, lambda _, i: holder(i)))
    messages = computed_once(messages, values, F.zip_with(values, output, lambda v, held: F.coalesce(held, v)))
    return messages.select(*kept, *([] if output in kept else [output]))


MODEL_BATCH = 64  # texts a model is given at once


def _with_labels(scored: DataFrame) -> DataFrame:
    return scored.withColumn("sentiment_label", sentiment_label(F.col("sentiment_score")))


def sentiment_lexicon(
    messages: DataFrame, lexicon: DataFrame, row_key: Sequence[str] | None = None, phrases: DataFrame | None = None
) -> DataFrame:
    """Add score and label from a lexicon table (word, value).

    The score reads ``cleaned_message``; a missing text counts as empty.
    ``phrases`` (phrase, value) are idioms that override the values of their
    words, see ``with_phrases``; boosters and negations leave them alone.
    """
    words = T.split_on_space(F.coalesce(F.col("cleaned_message"), F.lit("")))
    prepared = computed_once(messages, "_tokens", words)
    valued = values_for_tokens(prepared, lexicon, row_key, "_values", "double", tokens="_tokens")
    valued = computed_once(valued, "_values", F.col("_values"))
    valued = computed_once(valued, "_but_at", F.array_position("_tokens", "but") - 1)
    valued = computed_once(valued, "_marks", modifies(F.col("_tokens")))
    fixed = None
    if phrases is not None:
        valued, fixed = with_phrases(valued, phrases, row_key, "_tokens", "_values", "_fixed"), F.col("_fixed")
    total = total_valence(F.col("_tokens"), F.col("_values"), F.col("_but_at"), F.col("_marks"), fixed)
    scored = computed_once(valued, "_total", total)
    scored = scored.withColumn("sentiment_score", normalise_score(F.col("_total")))
    return _with_labels(scored.drop("_tokens", "_values", "_but_at", "_marks", "_total", "_fixed"))


def sentiment_model(
    messages: DataFrame,
    load_model: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
    positive_label: str = "LABEL_1",
    text: str = "cleaned_message",
) -> DataFrame:
    """Add score and label from a classifier.

    ``load_model`` runs once per Python worker and returns a function from a list
    of texts to a list of (label, probability).  Where a whole list fails its
    texts are tried alone, and one that still fails scores 0.0.
    """
    score = _model_score(load_model, positive_label)
    return _with_labels(messages.withColumn("sentiment_score", score(F.coalesce(F.col(text), F.lit("")))))


def _model_score(load_model: Callable, positive_label: str = "LABEL_1"):
    """The signed probability of each text; null for a null text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()

        def signed(texts: list[str]) -> list[float]:
            try:
                found = model(texts)
                return [float(p) if label == positive_label else -float(p) for label, p in found]
            except Exception:  # one bad text must not fail the job
                if len(texts) == 1:
                    return [0.0]
                return [s for value in texts for s in signed([value])]

        for batch in batches:
            given = batch.dropna()
            out = pd.Series(float("nan"), index=batch.index, dtype="float64")
            if len(given):
                texts = given.tolist()
                out[given.index] = [s for i in range(0, len(texts), MODEL_BATCH) for s in signed(texts[i : i + MODEL_BATCH])]
            yield out.astype("Float64")

    return score


def _loads(load_model: Callable, spark) -> str | None:
    """Why a model does not load, tried in one task; null if it does."""

    def probe(batches):
        try:
            load_model()
            error = None
        except Exception as problem:
            error = str(problem) or type(problem).__name__
        for batch in batches:
            yield pd.DataFrame({"error": [error] * len(batch)})

    return spark.range(1, numPartitions=1).mapInPandas(probe, "error string").first()["error"]


def analyze_sentiment(
    messages: DataFrame,
    lexicon: DataFrame | None = None,
    lang: str | None = None,
    load_model: Callable | None = None,
    row_key: Sequence[str] | None = None,
    phrases: DataFrame | None = None,
) -> DataFrame:
    """French messages go to the model when one is given and loads, all others
    to the lexicon.  ``lang=None`` decides by each row's ``language``."""
    for column in ("cleaned_message", "author"):
        if column not in messages.columns:
            raise ValueError(f"messages must have a {column!r} column")
    if load_model is not None and lang in (None, "fr"):
        error = _loads(load_model, messages.sparkSession)
        if error is not None:
            log.warning("sentiment model not available (%s): using the lexicon", error)
            load_model = None
    if load_model is None or lang not in (None, "fr"):
        if lexicon is None:
            raise ValueError("no lexicon given and no model available")
        return sentiment_lexicon(messages, lexicon, row_key, phrases)
    if lang == "fr" or lexicon is None:
        return sentiment_model(messages, load_model)
    french = F.coalesce(F.col("language") == "fr", F.lit(False))
    # one pass: the model sees nothing of the other languages
    scored = sentiment_lexicon(messages, lexicon, row_key, phrases)
    model = _model_score(load_model)(F.when(french, F.coalesce(F.col("cleaned_message"), F.lit(""))))
    return _with_labels(scored.withColumn("sentiment_score", F.coalesce(model, F.col("sentiment_score"))))


def sentiment_by_user(
    messages: DataFrame, keys: Sequence[str] = ("group_name", "author")
) -> DataFrame:
    return messages.groupBy(*keys).agg(F.avg("sentiment_score").alias("mean_score"))


def sentiment_global(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    """Mean score and shares of positive and negative messages (0 if empty)."""
    is_label = lambda name: F.when(F.col("sentiment_label") == name, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    return messages.groupBy(*keys).agg(
        F.avg("sentiment_score").alias("mean"),
        F.coalesce(F.avg(is_label("positive")), zero).alias("pos_pct"),
        F.coalesce(F.avg(is_label("negative")), zero).alias("neg_pct"),
    )


def sentiment_daily(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    return timed(messages).groupBy(*keys, F.to_date("timestamp").alias("day")).agg(
        F.avg("sentiment_score").alias("mean_score")
    )


def user_sentiment_daily(
    messages: DataFrame, keys: Sequence[str] = ("group_name", "author")
) -> DataFrame:
    """Daily means per author from first to last day; days without messages are null.

    The gap after each day is filled from that day's own row (it knows the next
    day), so no calendar join is needed.
    """
    daily = sentiment_daily(messages, keys)
    following = F.lead("day").over(Window.partitionBy(*keys).orderBy("day"))
    last = F.coalesce(F.date_sub(F.col("_next"), 1), F.col("day"))
    days = daily.withColumn("_next", following).withColumn(
        "_day", F.explode(F.sequence(F.col("day"), last))
    )
    score = F.when(F.col("_day") == F.col("day"), F.col("mean_score"))
    return days.select(*keys, F.col("_day").alias("day"), score.alias("mean_score"))


def sentiment_rank(messages: DataFrame, keys: Sequence[str] = ("group_name", "author")) -> DataFrame:
    """Authors by mean score, lowest first, with a flag for negative means."""
    return (
        sentiment_by_user(messages, keys)
        .withColumn("negative", F.col("mean_score") < 0)
        .orderBy("mean_score", *keys)
    )


def sentiment_histogram(
    messages: DataFrame, bins: int = 20, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    """Counts in equal-width bins over each group's own score range.

    The maximum belongs to the last bin.  A group with a single value uses the
    range value +- 0.5.
    """
    scored = messages.filter(F.col("sentiment_score").isNotNull())
    ranges = scored.groupBy(*keys).agg(
        F.min("sentiment_score").alias("_lo"), F.max("sentiment_score").alias("_hi")
    )
    flat = F.col("_lo") == F.col("_hi")
    ranges = ranges.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("hi"),
    )
    # equal scores are counted before they meet the ranges
    values = scored.groupBy(*keys, "sentiment_score").agg(F.count(F.lit(1)).alias("n"))
    place = (F.col("sentiment_score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    binned = attach(values, ranges, list(keys), how="inner").withColumn(
        "bin", F.least(F.floor(place * bins) + 1, F.lit(bins)).cast("int")
    )
    return binned.groupBy(*keys, "bin").agg(
        F.sum("n").alias("messages"),
        F.min(F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
    )
