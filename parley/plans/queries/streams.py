"""Structured Streaming over the tables, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.queries.cleaning import _group_language
from parley.plans.queries.files import write_text_exports
from parley.plans.queries.parsing import _PARSED
from parley.plans.queries.registry import query
from parley.plans.queries.views import (
    CHAT,
    DOCS,
    EVENTS,
    day_text,
    document_messages,
    event_columns,
    load,
    query_languages,
    stop_sql,
    time_text,
    words_sql,
)
from parley.session import scratch_path
from parley.streaming import aggregates, tables
from parley.streaming.ingest import stream_messages

W = "WITH " + EVENTS


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = load(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return event_columns(source.parquet(d))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to a parquet table until its input is used up."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", scratch_path(spark, name + "-state"))
        .trigger(availableNow=True)
        .start(target)
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_complete(stream: DataFrame, name: str) -> DataFrame:
    """Keep the full result of an aggregation: each batch replaces the table."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    running = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", scratch_path(spark, name + "-state"))
        .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query(
    "stream_timeline",
    W + """SELECT group_name, strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS messages FROM em GROUP BY ALL""",
)
def stream_timeline(spark, d):
    out = run_complete(aggregates.stream_timeline(event_stream(spark, d)), "timeline")
    return out.select("group_name", day_text(), "messages")


@query(
    "stream_user_counts",
    W
    + """SELECT group_name, author, count(*) AS message_count, round(avg(sentiment_score), 6) AS mean_score
FROM em GROUP BY ALL""",
)
def stream_user_counts(spark, d):
    out = run_complete(aggregates.stream_user_counts(event_stream(spark, d)), "counts")
    return out.withColumn("mean_score", F.round("mean_score", 6))


@query("stream_dedup", W + "SELECT group_name, author, message FROM em")
def stream_dedup(spark, d):
    # the same export twice: every message must come out once
    twice = event_stream(spark, d).union(event_stream(spark, d))
    out = run_to_table(aggregates.stream_dedup(twice), "dedup")
    return out.select("group_name", "author", "message")


@query(
    "stream_ingest",
    lambda: "WITH "
    + CHAT
    + _PARSED
    + f""", w AS (SELECT *, {words_sql('message')} AS ws FROM parsed WHERE msg_type = 'text'),
k AS (SELECT *, {stop_sql('ws', chr(39) + 'fr' + chr(39))} AS tokens FROM w)
SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", author, array_to_string(tokens, ' ') AS cleaned_message
FROM k WHERE len(tokens) >= 3""",
)
def stream_ingest(spark, d):
    folder = write_text_exports(spark, d)
    out = run_to_table(stream_messages(spark, [folder], lang="fr"), "ingest")
    return out.select(time_text("timestamp"), "author", "cleaned_message")


def landed(rows: DataFrame, name: str, files: int) -> DataFrame:
    """The rows as a stream of that many files, the latest messages first, two a batch."""
    spark = rows.sparkSession
    folder = scratch_path(spark, name)
    rows.repartitionByRange(files, F.col("timestamp").desc(), "seq").write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "2").parquet(folder)


@query(
    "stream_timeline_table",
    W + """SELECT group_name, strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS messages FROM em GROUP BY ALL""",
)
def stream_timeline_table(spark, d):
    events = event_columns(load(spark, d, "events")).select("group_name", "timestamp", "seq")
    target = scratch_path(spark, "timeline-table")
    writer = tables.write_timeline(landed(events, "events", 6), target, merge_every=2)
    writer.trigger(availableNow=True).start().awaitTermination()
    return tables.read_timeline(spark, target).select("group_name", day_text(), "messages")


@query(
    "stream_cleaned_table",
    lambda: "WITH "
    + DOCS
    + ", "
    + _group_language("dm", '"timestamp", seq')
    + f""", w AS (SELECT seq, group_name, language, {words_sql('message')} AS ws FROM dm JOIN gl USING (group_name)),
k AS (SELECT seq, group_name, language, {stop_sql('ws', 'language')} AS tokens FROM w)
SELECT seq, group_name, language, md5(array_to_string(tokens, ' ')) AS cleaned_md5 FROM k WHERE len(tokens) >= 3""",
)
def stream_cleaned_table(spark, d):
    target = scratch_path(spark, "cleaned-table")
    stream = landed(document_messages(spark, d), "documents", 6)
    writer = tables.write_cleaned(stream, target, order=("timestamp", "seq"), language_lists=query_languages())
    writer.trigger(availableNow=True).start().awaitTermination()
    out = tables.read_cleaned(spark, target)
    return out.select("seq", "group_name", "language", F.md5("cleaned_message").alias("cleaned_md5"))
