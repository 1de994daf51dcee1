"""Writers."""

from __future__ import annotations

import csv
import io
import logging
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import checkpointed, scratch_path, ship_package
from parley.sources.listing import open_filesystem

COPY_BYTES = 8 * 1024 * 1024
MESSAGE_ORDER = ("timestamp", "path", "block", "seq")

log = logging.getLogger(__name__)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """CSV has no arrays: join string arrays, write other nested values as JSON."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            columns.append(F.array_join(field.name, " ").alias(field.name))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            columns.append(F.to_json(field.name).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


def write_messages_csv(messages: DataFrame, output: str, key: str = "group_name") -> str:
    """One folder per group with header and quoted fields.

    Rebalancing on the key gives each group few files while a very large group
    is still split over several tasks.
    """
    flat = flatten_for_csv(messages).withColumn("_group", F.col(key))
    (
        flat.hint("rebalance", "_group")
        .write.mode("overwrite")
        .partitionBy("_group")
        .option("header", True)
        .option("escape", '"')
        .option("quoteAll", False)
        .option("encoding", "UTF-8")
        .csv(output)
    )
    return output


def csv_name(group: Column, default: str = "export") -> Column:
    """A file name without suffix for each group, different for different groups.

    A name that a file system could refuse (separators, control characters, a
    leading dot, over 150 bytes) is made safe and marked by a hash of the whole
    name.  Null and empty names are ``default``.
    """
    name = F.when(F.coalesce(group, F.lit("")) == "", F.lit(default)).otherwise(group)
    safe = F.regexp_replace(name, r"""[\x00-\x1f\x7f"#%'*/:=?\\{}\[\]^<>|~]|^\.|[ .]$""", "_")
    marked = F.concat(F.substring(safe, 1, 30), F.lit("~"), F.md5(F.encode(name, "UTF-8")))
    return F.when((safe == name) & (F.octet_length(name) <= 150), name).otherwise(marked)


def _header(columns: Sequence[str]) -> bytes:
    line = io.StringIO()
    csv.writer(line, lineterminator="\n").writerow(columns)
    return line.getvalue().encode("utf-8")


def _join_parts(work: str, header: bytes):
    """(name, parts) -> the parts one after the other in a file of the work folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, parts in zip(batch["name"], batch["parts"], strict=True):
                system, folder = open_filesystem(work)
                # opened for writing, so a task that is run again starts afresh
                with system.open_output_stream(f"{folder}/{name}.csv") as out:
                    out.write(header)
                    for part in parts:
                        source, path = open_filesystem(part)
                        with source.open_input_stream(path) as data:
                            while chunk := data.read(COPY_BYTES):
                                out.write(chunk)
                yield pd.DataFrame({"name": [name]})

    return run


def _publish(output: str, work: str):
    """Move finished files to their place; a file that is there already was moved by an earlier try."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            system, source = open_filesystem(work)
            _, target = open_filesystem(output)
            for name in batch["name"]:
                if system.get_file_info(f"{source}/{name}.csv").type == fs.FileType.File:
                    if system.get_file_info(f"{target}/{name}.csv").type == fs.FileType.File:
                        system.delete_file(f"{target}/{name}.csv")
                    system.move(f"{source}/{name}.csv", f"{target}/{name}.csv")
                yield pd.DataFrame({"name": [name], "path": [f"{output}/{name}.csv"]})

    return run


def write_group_csv(
    messages: DataFrame,
    output: str,
    key: str = "group_name",
    order: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One file ``<group>.csv`` per group, with header, in the order of the messages.

    Returns (name, path) of the files; ``columns`` says what they show.  Rows are sorted by group and ``order``
    (by default the ``MESSAGE_ORDER`` columns there are) in ranges, so a very
    large group is sorted and written by many tasks; their parts are then copied one
    after the other, as streams.  Files appear under their names only when all
    are complete: a failure before that leaves nothing in ``output`` but what was there.
    Existing files of the same groups are replaced, others are left alone.
    """
    spark = messages.sparkSession
    ship_package(spark)
    output = output.rstrip("/")
    order = [c for c in MESSAGE_ORDER if c in messages.columns] if order is None else list(order)
    flat = flatten_for_csv(messages).withColumn("_file", csv_name(F.col(key)))
    shown = messages.columns if columns is None else list(columns)
    staged, work = scratch_path(spark, "csv-parts"), scratch_path_beside(spark, output)
    (
        flat.repartitionByRange("_file", *order)
        .sortWithinPartitions("_file", *order)
        .select("_file", *shown)
        .write.partitionBy("_file")
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(staged)
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    # names of parts only: as many as there are writing tasks for a group
    parts = (
        files.load(staged)
        .select("path", F.regexp_extract("path", r"/_file=([^/]*)/[^/]*$", 1).alias("name"))
        .groupBy("name")
        .agg(F.array_sort(F.collect_list("path")).alias("parts"))
    )
    system, folder = open_filesystem(work)
    system.create_dir(folder, recursive=True)
    try:
        joined = checkpointed(parts.mapInPandas(_join_parts(work, _header(shown)), "name string"))
        written = checkpointed(joined.mapInPandas(_publish(output, work), "name string, path string"))
    finally:
        system.delete_dir(folder)
    return written


def scratch_path_beside(spark: SparkSession, output: str) -> str:
    """A work folder inside ``output``, so that files can be moved; hidden from readers."""
    return f"{output}/_work-{scratch_path(spark, 'x')[-32:]}"


def write_report_tables(
    tables: Mapping[str, DataFrame], output: str, format: str = "parquet"
) -> dict[str, str | None]:
    """Write every table under its name; one that fails is logged as None."""
    written: dict[str, str | None] = {}
    for name, table in tables.items():
        target = f"{output.rstrip('/')}/{name}"
        try:
            table.write.mode("overwrite").format(format).save(target)
            written[name] = target
        except Exception as error:
            log.warning("table %r failed: %s", name, error)
            written[name] = None
    return written
