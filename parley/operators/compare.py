"""Comparison across groups: one keyed table in, one small table out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.dates import whole_days
from parley.functions.text import clean_label
from parley.operators.sentiment import sentiment_global
from parley.operators.temporal import timeline_daily

def union_groups(*tables: DataFrame) -> DataFrame:
    """Separately built message tables as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def compare_activity(messages: DataFrame, key: str = "group_name") -> DataFrame:
    summary = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("nb_messages"),
        F.countDistinct("author").alias("nb_participants"),
        F.min("timestamp").alias("period_start"),
        F.max("timestamp").alias("period_end"),
    )
    days = whole_days(F.col("period_start"), F.col("period_end"))
    return summary.select(
        key,
        "nb_messages",
        "nb_participants",
        F.bround(F.col("nb_messages") / days, 2).alias("msgs_per_day"),
        "period_start",
        "period_end",
    )


def compare_sentiment(messages: DataFrame, key: str = "group_name") -> DataFrame:
    zero = F.lit(0.0)
    return sentiment_global(messages, [key]).select(
        key, F.coalesce("mean", zero).alias("sentiment_mean"), "pos_pct", "neg_pct"
    )


def compare_topics_long(group_topics: DataFrame, key: str = "group_name") -> DataFrame:
    """One row per group and label; a repeated label keeps its last topic."""
    return group_topics.groupBy(key, "topic_label").agg(
        F.max_by("weight", "topic_id").alias("weight")
    )


def _columns_of(df: DataFrame, column: str) -> list:
    """The columns of a wide table: as many as the table itself will have."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def compare_topics(
    group_topics: DataFrame, key: str = "group_name", labels: Sequence[str] | None = None
) -> DataFrame:
    """Groups x labels with 0.0 for a label a group does not have.

    One column per label: give ``labels`` to choose them; with very many use
    ``compare_topics_long``, which has the same content as rows.
    """
    long = compare_topics_long(group_topics, key)
    labels = list(labels or _columns_of(long, "topic_label"))
    wide = long.groupBy(key).pivot("topic_label", labels).agg(F.first("weight"))
    return wide.fillna(0.0)


def compare_timelines(
    messages: DataFrame, key: str = "group_name", groups: Sequence[str] | None = None
) -> DataFrame:
    """Days x groups with 0 for a day without messages.

    One column per group: give ``groups`` to choose them; with very many use
    ``timeline_daily``, which has the same content as rows.
    """
    daily = timeline_daily(messages, [key])
    groups = list(groups or _columns_of(daily, key))
    wide = daily.groupBy("day").pivot(key, groups).agg(F.sum("messages"))
    return wide.fillna(0)


def _authors(messages: DataFrame, key: str) -> DataFrame:
    return messages.select(key, "author").distinct()


def common_users_long(messages: DataFrame, key: str = "group_name") -> DataFrame:
    """(author, group, n_groups) of authors in two groups or more, one row per pair."""
    pairs = _authors(messages, key)
    counted = pairs.withColumn("n_groups", F.count(F.lit(1)).over(Window.partitionBy("author")))
    return counted.filter("n_groups > 1").select("author", key, "n_groups")


def common_users(messages: DataFrame, key: str = "group_name") -> DataFrame:
    """Authors in two groups or more with the sorted list of their groups."""
    # pairs are unique, so a list is a set; one row per author is the result itself
    listed = _authors(messages, key).groupBy("author").agg(F.collect_list(key).alias("groups"))
    return listed.filter(F.size("groups") > 1).withColumn("groups", F.array_sort("groups"))


def common_users_ranked(messages: DataFrame, key: str = "group_name") -> DataFrame:
    return (
        common_users(messages, key)
        .select(
            clean_label(F.col("author")).alias("author"),
            F.array_join("groups", ", ").alias("groups"),
            F.size("groups").alias("n_groups"),
        )
        .orderBy(F.desc("n_groups"), "author")
    )


def intersect_authors(messages: DataFrame, a: str, b: str, key: str = "group_name") -> DataFrame:
    """Authors present in both groups."""
    of = lambda name: messages.filter(F.col(key) == name).select("author")
    return of(a).intersect(of(b))
