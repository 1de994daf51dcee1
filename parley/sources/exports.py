"""Read chat exports: listing -> chat file of each export -> text blocks."""

from __future__ import annotations

import json
import logging
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions.text import file_stem, file_suffix
from parley.operators.media import find_media_dir, keep_media
from parley.session import attach, ship_package
from parley.sources.blocks import message_blocks
from parley.sources.listing import ChatFiles, open_filesystem

BLOCK_BYTES = 8 * 1024 * 1024
TASK_BYTES = 128 * 1024 * 1024

log = logging.getLogger(__name__)
BLOCK_SCHEMA = "path string, group_name string, block bigint, text string, error string"


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(ChatFiles)


def input_type(path: Column, is_folder: Column | None = None) -> Column:
    """'dir', 'zip' or 'txt'; null for an unsupported suffix."""
    suffix = file_suffix(path)
    kind = F.when(suffix == ".zip", "zip").when(suffix == ".txt", "txt")
    return kind if is_folder is None else F.when(is_folder, "dir").otherwise(kind)


def open_input(path: str):
    """A seekable binary stream of a file anywhere Arrow can reach."""
    filesystem, local = open_filesystem(path)
    return filesystem.open_input_file(local)


def open_media(path: str):
    """A binary stream of a media file, also of 'archive.zip!/member'."""
    archive, _, member = path.partition("!/")
    if not member:
        return open_input(path)
    return zipfile.ZipFile(open_input(archive)).open(member)


def list_exports(
    spark: SparkSession, paths: Sequence[str] = (), landing: Sequence[str] = ()
) -> DataFrame:
    """Files of the given exports, or of every export inside landing folders."""
    register(spark)
    return (
        spark.read.format("chat_files")
        .option("paths", json.dumps([str(p) for p in paths]))
        .option("landing", json.dumps([str(p) for p in landing]))
        .load()
    )


def _archive_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of each archive as listing rows; only its directory is read.

    A file that is no archive becomes a row with ``error``.  Any other failure,
    such as a lost connection, fails the task, and Spark repeats it.
    """
    columns = ["root", "path", "member", "depth", "length", "error"]
    for batch in batches:
        rows = []
        for root, path in zip(batch["root"], batch["path"]):
            try:
                with open_input(path) as raw, zipfile.ZipFile(raw) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            depth = info.filename.count("/") + 1
                            rows.append((root, path, info.filename, depth, info.file_size, None))
                    rows.append((root, path, "", 0, 0, None))  # an empty archive stays visible
            except (zipfile.BadZipFile, ValueError) as error:  # ValueError: shorter than any archive
                rows.append((root, path, None, 0, None, f"{path} is not a readable archive: {error}"))
        yield pd.DataFrame(rows, columns=columns)


def export_files(listing: DataFrame) -> DataFrame:
    """The listing with archives replaced by their members.

    Columns: root, kind, path, member (archives only), parent, name, depth,
    length, error.
    """
    archives = listing.filter(F.col("kind") == "zip").select("root", "path").repartition("path")
    members = archives.mapInPandas(
        _archive_members,
        "root string, path string, member string, depth int, length bigint, error string",
    )
    folder = F.regexp_extract("member", r"^(.*)/[^/]*$", 1)
    inside = members.select(
        "root", F.lit("zip").alias("kind"), "path", "member",
        F.concat_ws("!/", "path", F.when(folder != "", folder)).alias("parent"),
        F.regexp_extract("member", r"([^/]*)$", 1).alias("name"), "depth", "length", "error",
    )
    plain = listing.filter(F.coalesce(F.col("kind"), F.lit("")) != "zip").select(
        "root", "kind", "path", F.lit(None).cast("string").alias("member"), "parent",
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "depth", "length", "error",
    )
    return plain.unionByName(inside)


def _chat_order(name: str) -> tuple:
    """Order in which text files are tried: ``_chat`` first, then ``chat``, then by name."""
    return "_chat" not in name.lower(), "chat" not in name, name


def _damage(path: str, member: str) -> str | None:
    """Why a member cannot be read, after reading all of it against its check sum."""
    with open_input(path) as raw:
        try:
            with zipfile.ZipFile(raw) as archive, archive.open(member) as data:
                while data.read(BLOCK_BYTES):
                    pass
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, ValueError) as error:
            return f"{path}: {member} is damaged or locked: {error}"
    return None


def _choose_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chat text of each archive, or the reason there is none.

    The chosen member is read through once, so that a damaged one never gives
    half a chat.
    """
    columns = ["root", "path", "member", "length", "error"]
    for members in _archive_members(batches):
        rows = []
        for (root, path), inside in members.groupby(["root", "path"], sort=False):
            broken = inside["error"].dropna()
            if len(broken):
                rows.append((root, path, None, None, broken.iloc[0]))
                continue
            top = inside[(inside["depth"] == 1) & inside["member"].str.endswith(".txt")]
            best = min(top["member"], key=_chat_order, default=None)
            if best is None:
                rows.append((root, path, None, None, f"{root} holds no chat text"))
            else:
                damage = _damage(path, best)
                length = int(top.loc[top["member"] == best, "length"].iloc[0])
                rows.append((root, path, None if damage else best, None if damage else length, damage))
        yield pd.DataFrame(rows, columns=columns).astype({"length": "Int64"})


CHOSEN = ["root", "kind", "group_name", "path", "member", "length", "error"]


def chat_of_archives(listing: DataFrame) -> DataFrame:
    """One row per archive.  Works on a batch and on a stream."""
    # spread before they are opened: a landing folder is listed by one task
    archives = listing.filter(F.col("kind") == "zip").select("root", "path").repartition("path")
    schema = "root string, path string, member string, length bigint, error string"
    found = archives.mapInPandas(_choose_members, schema)
    return found.withColumns(
        {"kind": F.lit("zip"), "group_name": file_stem(F.col("root"))}
    ).select(*CHOSEN)


def chat_of_texts(listing: DataFrame) -> DataFrame:
    """One row per text file given as an export, and per unusable input."""
    single = (F.col("kind") == "txt") | F.col("kind").isNull()
    return (
        listing.filter(single)
        .withColumns({"group_name": file_stem(F.col("root")), "member": F.lit(None).cast("string")})
        .select(*CHOSEN)
    )


def chat_of_folders(listing: DataFrame) -> DataFrame:
    """One row per folder."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    order = F.struct(~F.lower(name).contains("_chat"), ~name.contains("chat"), name)
    usable = (F.col("depth") == 1) & name.endswith(".txt")
    chosen = (
        listing.filter(F.col("kind") == "dir")
        .groupBy("root", "kind")
        .agg(F.min_by(F.struct("path", "length"), F.when(usable, order)).alias("f"))
    )
    return chosen.select(
        "root",
        "kind",
        F.regexp_extract("root", r"([^/]*)/*$", 1).alias("group_name"),
        "f.path",
        F.lit(None).cast("string").alias("member"),
        "f.length",
        F.when(F.col("f").isNull(), F.concat("root", F.lit(" holds no chat text"))).alias("error"),
    )


def choose_chat_files(listing: DataFrame) -> DataFrame:
    """One row per export: its chat file, or the reason there is none."""
    return distinct_groups(
        chat_of_texts(listing)
        .unionByName(chat_of_archives(listing))
        .unionByName(chat_of_folders(listing))
    )


def distinct_groups(chosen: DataFrame) -> DataFrame:
    """Exports of the same name, such as two ``_chat.txt``, stay separate groups:
    each of them is named by its whole path."""
    same = F.count(F.lit(1)).over(Window.partitionBy("group_name"))
    name = F.when(same > 1, F.regexp_replace("root", r"/+$", "")).otherwise(F.col("group_name"))
    return chosen.withColumn("group_name", name)


def input_errors(chosen: DataFrame) -> DataFrame:
    """(path, error) of the exports that cannot be used."""
    return chosen.filter(F.col("error").isNotNull()).select(F.col("root").alias("path"), "error")


def _read_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "group_name", "block", "text", "error"]
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.error is not None:
                yield pd.DataFrame([(row.root, row.group_name, 0, None, row.error)], columns=columns)
                continue
            # a failure here fails the task; Spark repeats it
            with open_input(row.path) as raw:
                if row.member is not None:
                    with zipfile.ZipFile(raw) as archive, archive.open(row.member) as member:
                        found = message_blocks(member, 0, 0, None, BLOCK_BYTES)
                        for offset, data in found:
                            yield _block(row, offset, data, columns)
                else:
                    origin = max(int(row.start) - 1, 0)
                    raw.seek(origin)
                    last = int(row.start) + int(row.span)
                    for offset, data in message_blocks(raw, origin, int(row.start), last, BLOCK_BYTES):
                        yield _block(row, offset, data, columns)


def _block(row, offset: int, data: bytes, columns: list[str]) -> pd.DataFrame:
    # bytes that are not UTF-8 are dropped
    text = data.decode("utf-8", errors="ignore")
    return pd.DataFrame([(row.path, row.group_name, offset, text, None)], columns=columns)


def read_chat_files(
    chosen: DataFrame, block_bytes: int = BLOCK_BYTES, n_partitions: int | None = None
) -> DataFrame:
    """Text blocks (path, group_name, block, text, error) of the chosen files.

    A text file is cut into byte ranges which are spread over the cluster; a
    block holds whole messages, and (block, position) gives their order.  An
    archive member is inflated as a stream.  Without ``n_partitions`` the ranges
    go to as many tasks as a shuffle has.
    """
    length = F.coalesce(F.col("length"), F.lit(0))
    last = F.when(F.col("member").isNull(), F.greatest(length - 1, F.lit(0))).otherwise(0)
    ranges = chosen.select(
        "root", "group_name", "path", "member", "error",
        F.lit(block_bytes).cast("bigint").alias("span"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(block_bytes).cast("bigint"))).alias("start"),
    )
    n = n_partitions or int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "root", "start").mapInPandas(_read_ranges, BLOCK_SCHEMA)


def read_exports(
    spark: SparkSession,
    paths: Sequence[str] = (),
    landing: Sequence[str] = (),
    group_name: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    n_partitions: int | None = None,
) -> DataFrame:
    """Any mix of text files, archives and folders as text blocks.

    An input that cannot be read becomes a row with ``error`` and no text.
    """
    chosen = choose_chat_files(list_exports(spark, paths, landing))
    if group_name is not None:
        chosen = chosen.withColumn("group_name", F.lit(group_name))
    return read_chat_files(chosen, block_bytes, n_partitions)


def tasks_for(chosen: DataFrame) -> int:
    """Reading tasks for the chosen files: one per ``TASK_BYTES``, and at least one per core."""
    total = chosen.agg(F.sum("length")).first()[0] or 0
    return max(chosen.sparkSession.sparkContext.defaultParallelism, -(-int(total) // TASK_BYTES))


def require_any(chosen: DataFrame) -> DataFrame:
    """Fail when not one export is usable; log how many of the others are not."""
    usable = F.count(F.when(F.col("error").isNull(), 1))
    good, bad, sample = chosen.agg(usable, F.count("error"), F.min("error")).first()
    if not good:
        raise RuntimeError(f"None of the {bad} exports is usable, for example: {sample}")
    if bad:
        log.warning("%d of %d exports are not usable, for example: %s", bad, good + bad, sample)
    return chosen


def list_media(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Media files directly inside the folders as (root, path, length).

    A missing folder gives no rows.
    """
    files = list_exports(spark, folders).filter((F.col("kind") == "dir") & (F.col("depth") == 1))
    return keep_media(files).select("root", "path", "length")


def media_files(listing: DataFrame) -> DataFrame:
    """Media files of each export's media folder as (root, path, length).

    Members of archives have the path 'archive.zip!/member', see ``open_media``.
    """
    located = export_files(listing).withColumn(
        "path", F.concat_ws("!/", "path", F.when(F.col("member") != "", F.col("member")))
    )
    folders = find_media_dir(located).select("root", F.col("media_dir").alias("parent"))
    inside = attach(keep_media(located), folders, ["root", "parent"], "inner")
    return inside.select("root", "path", "length")
