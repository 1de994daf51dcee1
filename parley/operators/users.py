"""Per-author results.  ``messages`` is the cleaned table, optionally widened
with topic_id / topic_score and sentiment_score / sentiment_label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.dates import weekday_name
from parley.operators.temporal import busiest_slot, slot_total, timed
from parley.session import attach

AUTHOR = ("group_name", "author")


def distinct_authors(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    return messages.select(*keys).distinct()


def author_message_count(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("message_count"))


def token_count(messages: DataFrame) -> Column:
    if "tokens" in messages.columns:
        return F.when(F.col("tokens").isNull(), 0).otherwise(F.size("tokens"))
    text = F.coalesce(F.col("cleaned_message"), F.lit(""))
    return F.size(T.split_on_space(text))


def avg_message_length(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    return messages.groupBy(*keys).agg(F.avg(token_count(messages)).alias("avg_message_length"))


def _slots(messages: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    """At most 168 rows per author: counts by weekday and hour."""
    return messages.groupBy(
        *keys, F.weekday("timestamp").alias("_day"), F.hour("timestamp").alias("hour")
    ).agg(F.count(F.lit(1)).alias("messages"), *extra)


def _hours_map() -> Column:
    """Sum of messages per hour as a map with ascending keys."""
    entries = F.array_sort(F.collect_list(F.struct("hour", "messages")))
    return F.map_from_entries(entries)


def activity_hours(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    counts = timed(messages).groupBy(*keys, F.hour("timestamp").alias("hour")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    return counts.groupBy(*keys).agg(_hours_map().alias("activity_hours"))


def most_active_day(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    counts = timed(messages).groupBy(*keys, F.weekday("timestamp").alias("_day")).agg(
        F.count(F.lit(1)).alias("messages")
    )
    best = F.max_by("_day", F.struct(F.col("messages"), -F.col("_day")))
    return counts.groupBy(*keys).agg(weekday_name(best).alias("most_active_day"))


def topic_totals(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    return messages.groupBy(*keys, "topic_id").agg(
        F.avg("topic_score").alias("score"), F.count("topic_score").alias("messages")
    )


def top_topics(
    messages: DataFrame,
    group_topics: DataFrame,
    keys: Sequence[str] = AUTHOR,
    topic_keys: Sequence[str] = ("group_name", "topic_id"),
) -> DataFrame:
    """Array of (label, score) per author, most frequent topic first."""
    labels = group_topics.select(*topic_keys, "topic_label")
    named = attach(topic_totals(messages, keys), labels, list(topic_keys))
    entry = F.struct(
        (-F.col("messages")).alias("_order"),
        "topic_id",
        F.col("topic_label").alias("label"),
        "score",
    )
    return named.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["label"], e["score"])
        ).alias("top_topics")
    )


def user_topics(
    messages: DataFrame,
    group_topics: DataFrame,
    author: str | None = None,
    topic_keys: Sequence[str] = ("group_name", "topic_id"),
) -> DataFrame:
    """Topic of every message of an author, with its label."""
    rows = messages if author is None else messages.filter(F.col("author") == author)
    named = attach(rows, group_topics.select(*topic_keys, "topic_label"), list(topic_keys))
    extra = [c for c in ("group_name", "author") if c in messages.columns]
    return named.select(*extra, "topic_id", "topic_label", "topic_score")


def user_sentiment_mean(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    return messages.groupBy(*keys).agg(F.avg("sentiment_score").alias("sentiment_mean"))


def author_sentiment_series(
    messages: DataFrame, author: str, order: Sequence[str] = ("timestamp", "seq")
) -> DataFrame:
    return (
        messages.filter(F.col("author") == author)
        .orderBy(*order)
        .select("timestamp", "sentiment_score", "sentiment_label")
    )


def user_profiles(
    messages: DataFrame,
    group_topics: DataFrame | None = None,
    keys: Sequence[str] = AUTHOR,
    topic_keys: Sequence[str] = ("group_name", "topic_id"),
) -> DataFrame:
    """One row per author with all profile fields.

    Counts, lengths and sentiment come from one aggregation to (author, weekday,
    hour), which bounds what reaches the final step at 168 rows per author
    however many messages they wrote.
    """
    with_sentiment = "sentiment_score" in messages.columns
    extra = [F.sum(token_count(messages)).alias("_words")]
    if with_sentiment:
        extra += [
            F.sum("sentiment_score").alias("_score"),
            F.count("sentiment_score").alias("_scored"),
        ]
    slots = _slots(messages, keys, extra)
    packed = slots.groupBy(*keys).agg(
        F.sum("messages").alias("message_count"),
        F.sum("_words").alias("_words"),
        # messages without a time count, but belong to no slot
        F.collect_list(F.when(F.col("hour").isNotNull(), F.struct("_day", "hour", "messages"))).alias("_slots"),
        *([F.sum("_score").alias("_score"), F.sum("_scored").alias("_scored")] if with_sentiment else []),
    )

    hours = F.array_sort(F.array_distinct(F.transform("_slots", lambda s: s["hour"])))
    by_hour = F.map_from_entries(F.transform(hours, lambda h: F.struct(h, slot_total("_slots", "hour", h))))
    sentiment = (
        F.when(F.col("_scored") > 0, F.col("_score") / F.col("_scored"))
        if with_sentiment
        else F.lit(None).cast("double")
    )
    profiles = packed.select(
        *keys,
        "message_count",
        (F.col("_words") / F.col("message_count")).alias("avg_message_length"),
        by_hour.alias("activity_hours"),
        F.when(F.size("_slots") > 0, weekday_name(busiest_slot("_slots", "_day", 7))).alias("most_active_day"),
        sentiment.alias("sentiment_mean"),
    )
    empty = F.array().cast("array<struct<label:string,score:double>>")
    if group_topics is None or "topic_id" not in messages.columns:
        return profiles.withColumn("top_topics", empty)
    topics = top_topics(messages, group_topics, keys, topic_keys)
    return profiles.join(topics, list(keys), "left").withColumn(
        "top_topics", F.coalesce(F.col("top_topics"), empty)
    )


def profile_for(
    messages: DataFrame,
    author: str,
    group_topics: DataFrame | None = None,
    keys: Sequence[str] = AUTHOR,
    topic_keys: Sequence[str] = ("group_name", "topic_id"),
) -> DataFrame:
    """One author's profile: the filter comes first, nobody else is computed."""
    return user_profiles(messages.filter(F.col("author") == author), group_topics, keys, topic_keys)


def media_and_days(messages: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Media messages and active days per author, over the raw messages."""
    per_day = messages.groupBy(*keys, F.to_date("timestamp").alias("_day")).agg(
        F.count_if(F.col("msg_type") == "media").alias("_media")
    )
    return per_day.groupBy(*keys).agg(
        F.sum("_media").alias("media_count"), F.count("_day").alias("active_days")
    )


def user_activity_topn(
    messages: DataFrame, top_n: int = 50, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    """The most active authors of each group, in ascending order, with the
    number of participants and whether the list was cut."""
    counts = author_message_count(messages, [*keys, "author"])
    people = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_participants"))
    order = Window.partitionBy(*keys).orderBy(F.desc("message_count"), "author")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    joined = top.join(people, list(keys))
    return (
        joined.withColumn("author", T.clean_label(F.col("author")))
        .withColumn("truncated", F.col("total_participants") > top_n)
        .orderBy(*keys, "message_count", F.desc("author"))
    )
