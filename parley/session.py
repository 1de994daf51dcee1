"""Session defaults, the shared scratch folder and size-checked joins."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and stays below both bounds.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32
# Compressed bytes of a table that a task reads: to aim at, and where a split is too large.
PART_BYTES = 4 * 1024 * 1024
LARGE_BYTES = 16 * 1024 * 1024


def get_session(app_name: str = "parley", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_parley_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="parley-py-")) / "parley.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._parley_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        # with its scheme, so that Spark and Python mean the same place
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine, one process, e.g. tests: gone when the process ends
        folder = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/parley/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that an action on the
    result does not run the plan behind it again and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: its lineage ends there.

    For loops: a checkpoint keeps what the optimizer has inferred about its
    columns, and joins of a table with itself multiply that round by round.
    ``codec`` compresses it, by default the session's setting.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def _file_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from; each folder is listed once."""
    spark, files = df.sparkSession, [unquote(f) for f in df.inputFiles()]
    names, total = set(files), 0
    for folder in {f.rpartition("/")[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            if f"{folder}/{status.getPath().getName()}" in names:
                total += status.getLen()
    return total


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input with few or large splits one part per core and ``PART_BYTES``.

    A table with far more splits than cores, none of them large, is left alone: no
    shuffle.  A single file with one row group would otherwise do all text work in
    one task, and a table of a few large splits would hold a part in memory that
    grows with the table.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    size = _file_bytes(df)
    if splits >= 2 * cores and size <= splits * LARGE_BYTES:
        return df
    return df.repartition(max(cores, math.ceil(size / PART_BYTES)), *keys)


def _width(column: str, kind: str):
    """Rough bytes of a value; only what can vary is looked at."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if kind.startswith(("array", "map", "struct", "variant")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return F.lit(8)


def measure(df: DataFrame) -> tuple[int, int]:
    """Row count and rough size in bytes of an already materialised result.  Eager."""
    width = sum((_width(c, t) for c, t in df.dtypes), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(n), int(size)


def attach(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join a large table to one that is usually, but not surely, small.

    Eager: ``small`` is checkpointed and measured.  Below the bounds
    it is broadcast.  Above them, both sides are shuffled on the key plus a
    salt, so that a key holding a third of ``large`` spreads over many tasks.
    """
    if how not in ("left", "inner"):
        raise ValueError("attach() supports left and inner joins")
    small = checkpointed(small)
    rows, size = measure(small)
    if rows <= max_rows and size <= max_bytes:
        return large.join(F.broadcast(small), on, how)
    # the salt depends on row content only: a re-run task gives the same value
    hashable = [c for c, t in large.dtypes if "map<" not in t and "variant" not in t]
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    )
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
