"""Sources and sinks, on files that Spark writes from the tables first."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.operators import media
from parley.operators.parse import parse_exports
from parley.plans.queries.parsing import _PARSED, _SELECT, _shown, export_lines
from parley.plans.queries.registry import query, sql_string
from parley.plans.queries.views import (
    CHAT,
    EVENT_TOPICS,
    chat_messages,
    document_messages,
    event_messages,
    event_topics,
    load,
)
from parley.session import scratch_path, ship_package
from parley.sources import exports, sinks
from parley.sources.listing import open_filesystem

W = "WITH " + CHAT
# the group comes from the file or folder, so it is not part of these results
_ROUND_TRIP = W + _PARSED + 'SELECT strftime("timestamp", \'%Y-%m-%d %H:%M:%S\') AS "timestamp", author, message, msg_type FROM parsed'


def _ordered_lines(spark: SparkSession, d: str) -> DataFrame:
    # a range split keeps order without putting a whole group into one task
    lines = export_lines(chat_messages(spark, d)).select("group_name", "seq", "line")
    return lines.repartitionByRange("group_name", "seq").sortWithinPartitions("group_name", "seq")


def write_text_exports(spark: SparkSession, d: str) -> str:
    """Every written part file is one export text."""
    folder = scratch_path(spark, "exports")
    _ordered_lines(spark, d).select("line").write.text(folder)
    return folder


def _folder_partition(folder: str):
    """Each group of a partition becomes a folder: the chat beside other texts."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, now = None, None
        for batch in batches:
            for name, rows in batch.groupby("group_name", sort=False):
                if name != now:
                    if out is not None:
                        out.close()
                    filesystem, local = open_filesystem(f"{folder}/{name}")
                    filesystem.create_dir(local, recursive=True)
                    for other in ("a chat.txt", "notes.txt"):
                        with filesystem.open_output_stream(f"{local}/{other}") as decoy:
                            decoy.write(b"01/01/2024, 10:00 - Nobody: not the chat\n")
                    out, now = filesystem.open_output_stream(f"{local}/my _Chat.txt"), name
                out.write(("\n".join(rows["line"]) + "\n").encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})
        if out is not None:
            out.close()

    return write


def write_folder_exports(spark: SparkSession, d: str) -> str:
    """One folder per group; a chat is one file, so one task writes it as a stream."""
    ship_package(spark)
    folder = scratch_path(spark, "folders")
    filesystem, local = open_filesystem(folder)
    filesystem.create_dir(local, recursive=True)
    lines = export_lines(chat_messages(spark, d)).select("group_name", "seq", "line")
    sorted_ = lines.repartition("group_name").sortWithinPartitions("group_name", "seq")
    sorted_.mapInPandas(_folder_partition(folder), "n bigint").write.format("noop").mode("overwrite").save()
    return folder


def _zip_partition(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        batch = next(batches, None)
        if batch is None:
            return
        # a repeated task writes the same file again
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.zip"
        filesystem, local = open_filesystem(path)
        count = 0
        with (
            filesystem.open_output_stream(local) as out,
            zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive,
        ):
            with archive.open("_chat.txt", "w") as member:
                while batch is not None:
                    for line in batch["line"]:
                        member.write((line + "\n").encode("utf-8"))
                    count += len(batch)
                    batch = next(batches, None)
            archive.writestr("photo.jpg", b"0" * 100)
        yield pd.DataFrame({"path": [path], "lines": [count]})

    return write


def write_zip_exports(spark: SparkSession, d: str) -> str:
    ship_package(spark)
    folder = scratch_path(spark, "archives")
    filesystem, local = open_filesystem(folder)
    filesystem.create_dir(local, recursive=True)
    written = _ordered_lines(spark, d).select("line").mapInPandas(_zip_partition(folder), "path string, lines bigint")
    written.write.format("noop").mode("overwrite").save()
    return folder


def _messages(parsed: DataFrame) -> DataFrame:
    return _shown(parsed).drop("group_name")


@query("read_export_txt", _ROUND_TRIP)
def read_export_txt(spark, d):
    blocks = exports.read_exports(spark, landing=[write_text_exports(spark, d)], block_bytes=64 * 1024)
    return _messages(parse_exports(blocks))


@query("read_export_zip", _ROUND_TRIP)
def read_export_zip(spark, d):
    blocks = exports.read_exports(spark, landing=[write_zip_exports(spark, d)])
    return _messages(parse_exports(blocks))


@query(
    "read_export_dir",
    W + _PARSED + _SELECT,
)
def read_export_dir(spark, d):
    # each folder is an export; the chat file is chosen among its text files
    listing = exports.list_exports(spark, landing=[write_folder_exports(spark, d)])
    chosen = exports.choose_chat_files(listing.filter(F.col("kind") == "dir"))
    return _shown(parse_exports(exports.read_chat_files(chosen)))


@query(
    "read_many_exports",
    W
    + _PARSED
    + """SELECT strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", author, message, msg_type, count(*) AS copies
FROM (SELECT * FROM parsed UNION ALL SELECT * FROM parsed) GROUP BY ALL""",
)
def read_many_exports(spark, d):
    # texts and archives together, with one missing input that is skipped
    landing = [write_text_exports(spark, d), write_zip_exports(spark, d)]
    listing = exports.list_exports(spark, [f"{landing[0]}/missing.txt"], landing)
    blocks = exports.read_chat_files(exports.require_any(exports.choose_chat_files(listing)))
    rows = _messages(parse_exports(blocks))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))


# -- media -----------------------------------------------------------------------

_SUFFIXES = [".jpg", ".JPEG", ".opus", ".mp4", ".pdf", ".png", ".txt", ".mp3"]


def _media_path(folder: str):
    suffix = F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat(F.lit(folder + "/FILE-"), "doc_id", suffix)


_MEDIA_SQL = f"""WITH f AS (SELECT doc_id, source, octet_length(encode(text)) AS length,
  lower({"[" + ", ".join(sql_string(s) for s in _SUFFIXES) + "]"}[doc_id % 8 + 1]) AS file_type FROM documents),
m AS (SELECT * FROM f WHERE list_contains({"[" + ", ".join(sql_string(s) for s in P.MEDIA_SUFFIXES) + "]"}, file_type))"""


@query(
    "media_stats",
    _MEDIA_SQL
    + """SELECT source, file_type, count(*) AS count, round_even(sum(length) / CAST(1048576 AS DOUBLE), 6) AS total_size_mb
FROM m GROUP BY source, file_type""",
)
def media_stats(spark, d):
    files = load(spark, d, "documents").select(
        "source", _media_path("/media").alias("path"), F.octet_length("text").cast("bigint").alias("length")
    )
    return media.media_stats(files, ["source"])


def _write_files(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                filesystem, local = open_filesystem(path)
                with filesystem.open_output_stream(local) as out:
                    out.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(batch)]})

    return write


def write_media(spark: SparkSession, d: str) -> str:
    """One file per document below a folder of media files."""
    ship_package(spark)
    root = scratch_path(spark, "media")
    filesystem, local = open_filesystem(f"{root}/media")
    filesystem.create_dir(local, recursive=True)
    rows = load(spark, d, "documents").select(_media_path(f"{root}/media").alias("path"), "text")
    rows.mapInPandas(_write_files(f"{root}/media"), "n bigint").write.format("noop").mode("overwrite").save()
    return root


def _name(column: str = "path"):
    return F.regexp_extract(column, r"([^/]*)$", 1)


@query(
    "list_media",
    _MEDIA_SQL
    + f"""SELECT 'FILE-' || doc_id || {"[" + ", ".join(sql_string(s) for s in _SUFFIXES) + "]"}[doc_id % 8 + 1] AS name, length FROM m""",
)
def list_media(spark, d):
    files = exports.list_media(spark, [write_media(spark, d) + "/media"])
    return files.select(_name().alias("name"), "length")


@query("find_media_dir", _MEDIA_SQL + "SELECT 'media' AS media_dir, count(*) AS files, sum(length) AS bytes FROM m")
def find_media_dir(spark, d):
    listing = exports.list_exports(spark, [write_media(spark, d)])
    folders = media.find_media_dir(listing)
    files = exports.media_files(listing).groupBy("root").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").cast("decimal(38,0)").alias("bytes")
    )
    return folders.join(files, "root").select(_name("media_dir").alias("media_dir"), "files", "bytes")


def stub_transcriber():
    """Stands in for speech-to-text: the size of the file; fails on some."""

    def transcribe(path: str) -> str:
        with exports.open_media(path) as stream:
            size = len(stream.read())
        if size % 7 == 0:
            raise ValueError("no speech found")
        return f"  {size} bytes "

    return transcribe


@query(
    "transcribe_media",
    _MEDIA_SQL
    + """SELECT 'FILE-' || doc_id || file_type AS name, length || ' bytes' AS text FROM m
WHERE file_type IN ('.opus', '.mp4', '.mp3') AND length % 7 <> 0""",
)
def transcribe_media(spark, d):
    files = exports.list_media(spark, [write_media(spark, d) + "/media"])
    texts = media.transcribe_media(files, stub_transcriber)
    return texts.select(_name("file_path").alias("name"), "text")


# -- sinks ------------------------------------------------------------------------


@query(
    "write_messages_csv",
    """SELECT source AS _group, doc_id AS seq, md5(text) AS message_md5, 'a' || (doc_id % 20) AS author FROM documents""",
)
def write_messages_csv(spark, d):
    folder = scratch_path(spark, "csv")
    messages = document_messages(spark, d).withColumn("tokens", F.split("true_lang", ""))
    sinks.write_messages_csv(messages, folder)
    schema = (
        "timestamp timestamp_ntz, author string, message string, msg_type string, group_name string, "
        "seq bigint, true_lang string, tokens string, _group string"
    )
    back = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(folder)
    )
    return back.select("_group", "seq", F.md5("message").alias("message_md5"), "author")


@query(
    "write_group_csv",
    """SELECT source || '.csv' AS file, doc_id AS seq, md5(text) AS message_md5, 'a' || (doc_id % 20) AS author FROM documents""",
)
def write_group_csv(spark, d):
    messages = document_messages(spark, d).select("timestamp", "author", "message", "group_name", "seq")
    written = sinks.write_group_csv(messages, scratch_path(spark, "group-csv"))
    schema = "timestamp timestamp_ntz, author string, message string, group_name string, seq bigint"
    folder = written.agg(F.min("path")).first()[0].rpartition("/")[0]
    options = {"header": True, "multiLine": True, "escape": '"'}
    back = spark.read.schema(schema).options(**options).csv(folder).withColumn("file", F.col("_metadata.file_name"))
    return back.select("file", "seq", F.md5("message").alias("message_md5"), "author")


@query(
    "report_tables",
    "WITH "
    + EVENT_TOPICS
    + """, g AS (SELECT count(DISTINCT group_name) AS n FROM em), a AS (SELECT DISTINCT group_name, author FROM em),
pg AS (SELECT group_name, count(*) AS n FROM a GROUP BY 1),
days AS (SELECT DISTINCT group_name, CAST("timestamp" AS DATE) AS day FROM em)
SELECT unnest(['stat_cards', 'overview_cards', 'activity_table', 'group_details', 'peak_hour', 'peak_day', 'sentiment_global', 'sentiment_split']) AS "table", (SELECT n FROM g) AS "rows"
UNION ALL SELECT 'top_authors', (SELECT sum(least(n, 10)) FROM pg) UNION ALL SELECT 'user_activity', (SELECT sum(least(n, 50)) FROM pg)
UNION ALL SELECT 'comparison_cards', 1 UNION ALL SELECT 'common_users', (SELECT count(*) FROM (SELECT author FROM a GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT unnest(['timeline', 'sentiment_daily']), (SELECT count(*) FROM days)
UNION ALL SELECT 'hourly_heatmap', (SELECT n * 168 FROM g) UNION ALL SELECT 'weekly_activity', (SELECT n * 7 FROM g)
UNION ALL SELECT 'monthly_activity', (SELECT count(*) FROM (SELECT DISTINCT group_name, date_trunc('month', day) FROM days))
UNION ALL SELECT 'topic_distribution', (SELECT count(*) FROM gt)
UNION ALL SELECT 'topic_words', (SELECT sum(len(string_split(topic_label, ' / '))) FROM gt)
UNION ALL SELECT 'compare_topics', (SELECT count(*) FROM (SELECT DISTINCT group_name, topic_label FROM gt))
UNION ALL SELECT unnest(['sentiment_by_user', 'user_profiles']), (SELECT count(*) FROM a)""",
)
def report_tables(spark, d):
    from parley.plans.analysis import ChatAnalysis, _temporal, _users

    run = ChatAnalysis(spark, [])
    rows = event_messages(spark, d).withColumn("tokens", F.split("message", " "))
    r = run.results
    r.raw = r.clean = r.scored = rows
    r.group_topics, r.sentiment = event_topics(rows), {}
    _temporal(run)
    _users(run)
    written = run.write_reports(scratch_path(spark, "reports"))
    counts = [
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, path in written.items()
    ]
    return reduce(DataFrame.union, counts)
