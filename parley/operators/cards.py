"""The numbers and formatted rows a report shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.functions.dates import one_decimal, short_date, thousands, weekday_name, whole_days
from parley.operators.temporal import busiest_slot
from parley.operators.users import author_message_count


def _totals(messages: DataFrame, keys: Sequence[str]) -> DataFrame:
    return messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        F.countDistinct("author").alias("participants"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def corpus_stats(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    return _totals(messages, keys)


def stat_cards(raw_messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return _totals(raw_messages, keys).select(
        *keys,
        thousands(F.col("messages")).alias("total_messages"),
        F.col("participants").cast("string").alias("participants"),
        short_date(F.col("first_ts")).alias("first_message"),
        thousands(whole_days(F.col("first_ts"), F.col("last_ts"))).alias("days_of_history"),
    )


def overview_cards(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    """Cards over the cleaned messages, with busiest hour and weekday.

    One aggregation by (weekday, hour) gives everything but the participants.
    """
    slots = messages.groupBy(
        *keys, F.weekday("timestamp").alias("day"), F.hour("timestamp").alias("hour")
    ).agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    packed = slots.groupBy(*keys).agg(
        F.sum("messages").alias("messages"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.collect_list(F.struct("day", "hour", "messages")).alias("_slots"),
    )
    people = messages.groupBy(*keys).agg(F.countDistinct("author").alias("participants"))
    days = whole_days(F.col("first_ts"), F.col("last_ts"))
    hour = busiest_slot("_slots", "hour", 24).cast("string")
    # one row per group on each side
    return packed.join(people, list(keys)).select(
        *keys,
        thousands(F.col("messages")).alias("messages"),
        one_decimal(F.col("messages") / days).alias("avg_per_day"),
        F.col("participants").cast("string").alias("participants"),
        short_date(F.col("first_ts")).alias("period_start"),
        short_date(F.col("last_ts")).alias("period_end"),
        F.concat(F.lpad(hour, 2, "0"), F.lit(":00")).alias("peak_hour"),
        weekday_name(busiest_slot("_slots", "day", 7)).alias("peak_day"),
    )


def top_authors(
    raw_messages: DataFrame, top_n: int = 10, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    """Most active authors; percentages refer to the listed rows only."""
    counts = author_message_count(raw_messages, [*keys, "author"])
    order = Window.partitionBy(*keys).orderBy(F.desc("message_count"), "author")
    shown = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    total = F.sum("message_count").over(Window.partitionBy(*keys))
    return shown.select(
        *keys,
        "rank",
        T.clean_label(F.col("author")).alias("author"),
        thousands(F.col("message_count")).alias("count"),
        one_decimal(100 * F.col("message_count") / total).alias("pct"),
    )


def comparison_cards(activity: DataFrame) -> DataFrame:
    return activity.agg(
        F.count(F.lit(1)).cast("string").alias("groups_compared"),
        thousands(F.sum("nb_messages")).alias("total_messages"),
        thousands(F.sum("nb_participants")).alias("participants"),
        short_date(F.min("period_start")).alias("earliest_message"),
    )


def activity_table(activity: DataFrame, key: str = "group_name") -> DataFrame:
    return activity.select(
        key,
        thousands(F.col("nb_messages")).alias("nb_messages"),
        F.col("nb_participants").cast("string").alias("nb_participants"),
        one_decimal(F.col("msgs_per_day")).alias("msgs_per_day"),
        short_date(F.col("period_start")).alias("period_start"),
        short_date(F.col("period_end")).alias("period_end"),
        thousands(whole_days(F.col("period_start"), F.col("period_end"))).alias("duration_days"),
    )


def group_detail_cards(messages: DataFrame, key: str = "group_name") -> DataFrame:
    return _totals(messages, [key]).select(
        key,
        thousands(F.col("messages")).alias("nb_messages"),
        F.col("participants").cast("string").alias("nb_participants"),
        F.concat(short_date(F.col("first_ts")), F.lit(" → "), short_date(F.col("last_ts"))).alias("period"),
    )


def sentiment_split(sentiment: DataFrame, key: str = "group_name") -> DataFrame:
    """Percentages from ``compare_sentiment``; neutral is what remains."""
    pos, neg = F.col("pos_pct") * 100, F.col("neg_pct") * 100
    return sentiment.select(
        key, pos.alias("positive"), (F.lit(100.0) - pos - neg).alias("neutral"), neg.alias("negative")
    )


def msg_type_distribution(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    counts = messages.groupBy(*keys, "msg_type").agg(F.count(F.lit(1)).alias("messages"))
    # three rows per group at most
    total = F.sum("messages").over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.col("messages") / total)


def run_summary(
    raw_messages: DataFrame, messages: DataFrame, keys: Sequence[str] = ("group_name",)
) -> DataFrame:
    """Raw and kept rows, authors, topics and positive scores per group."""
    raw = raw_messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("raw_messages"))
    kept = messages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clean_messages"),
        F.countDistinct("author").alias("authors"),
        F.count_if(F.col("sentiment_score") > 0).alias("positive_scores"),
        # as few values as topics were fitted
        F.size(F.collect_set("topic_id")).cast("bigint").alias("topics"),
    )
    numbers = ["clean_messages", "authors", "positive_scores", "topics"]
    return raw.join(kept, list(keys), "left").fillna(0, numbers)
