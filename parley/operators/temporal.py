"""Activity over time.  Input: a table with ``timestamp`` and the key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.dates import weekday_name

GROUP = ("group_name",)


def timed(messages: DataFrame) -> DataFrame:
    """Messages without a time belong to no slot of a calendar."""
    return messages.filter(F.col("timestamp").isNotNull())


def _count() -> Column:
    return F.count(F.lit(1)).alias("messages")


def fill_slots(
    counts: DataFrame, keys: Sequence[str], slot: str, n_slots: int, value: str = "messages"
) -> DataFrame:
    """Every slot 0..n-1 for every key, zero where nothing was counted.

    The few counts of a key are packed into a map and unpacked along the full
    range, so no calendar table has to be joined.  Without keys an empty input
    gives all zeros.
    """
    packed = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(slot, value))).alias("_counts")
    )
    spread = packed.select(
        *keys, "_counts", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias(slot)
    )
    filled = F.coalesce(F.try_element_at("_counts", F.col(slot)), F.lit(0).cast("bigint"))
    return spread.select(*keys, slot, filled.alias(value))


def slot_total(slots: str, field: str, value: Column) -> Column:
    """Messages of the packed slots (array of structs) whose field has the value."""
    hit = F.filter(slots, lambda s: s[field] == value)
    return F.aggregate(hit, F.lit(0).cast("bigint"), lambda acc, s: acc + s["messages"])


def busiest_slot(slots: str, field: str, n_slots: int) -> Column:
    """The value 0..n-1 with most messages; ties go to the smallest."""
    ranked = F.transform(
        F.sequence(F.lit(0), F.lit(n_slots - 1)),
        lambda i: F.struct(-slot_total(slots, field, i), i.alias("slot")),
    )
    return F.array_min(ranked)["slot"]


def timeline_daily(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Messages per calendar day that has any."""
    return timed(messages).groupBy(*keys, F.to_date("timestamp").alias("day")).agg(_count())


def hourly_heatmap(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """Long form of the 7 x 24 table: weekday_no (0 = Monday), weekday, hour."""
    slot = (F.weekday("timestamp") * 24 + F.hour("timestamp")).cast("int").alias("slot")
    counts = timed(messages).groupBy(*keys, slot).agg(_count())
    day = F.floor(F.col("slot") / 24).cast("int")
    return fill_slots(counts, keys, "slot", 168).select(
        *keys,
        day.alias("weekday_no"),
        weekday_name(day).alias("weekday"),
        (F.col("slot") % 24).alias("hour"),
        "messages",
    )


def hourly_heatmap_wide(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """One row per weekday with 24 hour columns h00..h23."""
    long = hourly_heatmap(messages, keys)
    return long.groupBy(*keys, "weekday_no", "weekday").agg(
        *(F.sum(F.when(F.col("hour") == h, F.col("messages"))).alias(f"h{h:02d}") for h in range(24))
    )


def weekly_activity(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    day = F.weekday("timestamp").cast("int").alias("weekday_no")
    counts = timed(messages).groupBy(*keys, day).agg(_count())
    return fill_slots(counts, keys, "weekday_no", 7).select(
        *keys, "weekday_no", weekday_name(F.col("weekday_no")).alias("weekday"), "messages"
    )


def monthly_activity(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    return timed(messages).groupBy(*keys, F.date_format("timestamp", "yyyy-MM").alias("month")).agg(_count())


def _busiest(counts: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Largest count; ties go to the smallest slot.  Aggregated map-side."""
    best = F.max_by(slot, F.struct(F.col("messages"), -F.col(slot)))
    return counts.groupBy(*keys).agg(best.alias(slot))


def peak_hour(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    counts = timed(messages).groupBy(*keys, F.hour("timestamp").alias("peak_hour")).agg(_count())
    return _busiest(counts, keys, "peak_hour")


def peak_day(messages: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    counts = timed(messages).groupBy(*keys, F.weekday("timestamp").alias("_day")).agg(_count())
    return _busiest(counts, keys, "_day").select(*keys, weekday_name(F.col("_day")).alias("peak_day"))


def user_heatmap(messages: DataFrame, author: str, keys: Sequence[str] = ()) -> DataFrame:
    """The heatmap of one author; an unknown author gives zeros."""
    return hourly_heatmap(messages.filter(F.col("author") == author), keys)
