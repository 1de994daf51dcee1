"""Windowed and keyed aggregates over a stream of messages.

Exports are history: a chat that lands today may hold messages that are older
than all that was seen before.  Nothing here drops rows by the time of the
message; state ends with the time of arrival, if at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_timeline(messages: DataFrame, keys: Sequence[str] = ("group_name",)) -> DataFrame:
    """Messages per day; update or complete mode.

    State is one row per key and day that has messages, however many messages
    arrive and in whatever order.  Messages without a time are left out.
    """
    timed = messages.filter(F.col("timestamp").isNotNull())
    return timed.groupBy(*keys, F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("messages"))


def stream_user_counts(
    messages: DataFrame, keys: Sequence[str] = ("group_name", "author")
) -> DataFrame:
    """Running message count (and mean score) per author; update or complete mode."""
    scores = (
        [F.avg("sentiment_score").alias("mean_score")]
        if "sentiment_score" in messages.columns
        else []
    )
    return messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("message_count"), *scores)


def stream_dedup(
    messages: DataFrame,
    keep_for: str = "30 days",
    keys: Sequence[str] = ("group_name", "timestamp", "author", "message"),
) -> DataFrame:
    """Drop messages seen before, e.g. in an earlier export of the same chat.

    A message is forgotten ``keep_for`` after its arrival.  The watermark is on
    the time of arrival, so that messages of any age come through.
    """
    return (
        messages.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", keep_for)
        .dropDuplicatesWithinWatermark(list(keys))
        .drop("_arrived")
    )
