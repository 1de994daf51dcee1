"""Media statistics and transcription."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import patterns as P
from parley.functions.text import file_suffix



def keep_media(files: DataFrame) -> DataFrame:
    return files.filter(file_suffix(F.col("path")).isin(P.MEDIA_SUFFIXES))


def media_stats(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """files(path, length) -> count and size per lower-case suffix."""
    return (
        keep_media(files)
        .groupBy(*keys, file_suffix(F.col("path")).alias("file_type"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.bround(F.sum("length") / F.lit(1024.0 * 1024.0), 6).alias("total_size_mb"),
        )
    )


def find_media_dir(files: DataFrame) -> DataFrame:
    """files(root, parent, path, depth) -> the media folder of each root.

    A sub-folder holding a media file comes before the root itself.
    """
    media = files.filter(
        file_suffix(F.col("path")).isin(P.MEDIA_FOLDER_SUFFIXES) & (F.col("depth") <= 2)
    )
    return media.groupBy("root").agg(
        F.min_by("parent", F.struct((F.col("depth") == 1).cast("int"), "parent")).alias("media_dir")
    )


def transcribe_media(
    files: DataFrame,
    load_transcriber: Callable[[], Callable[[str], str | None]] | None = None,
    n_partitions: int | None = None,
    with_errors: bool = False,
) -> DataFrame:
    """Text of each audio or video file as (file_path, text).

    ``load_transcriber`` runs once per task and returns path -> text; only paths
    travel through Spark, the transcriber opens the file.  Files it fails on or
    returns nothing for are skipped; ``with_errors`` keeps them, with a third
    column ``error``.  Without a transcriber the result is empty.
    """
    schema = "file_path string, text string, error string"
    wanted = files.filter(file_suffix(F.col("path")).isin(P.AUDIO_SUFFIXES + P.VIDEO_SUFFIXES))
    if load_transcriber is None:
        return wanted.filter(F.lit(False)).select(
            F.col("path").alias("file_path"), F.lit("").alias("text"),
            *([F.lit("").alias("error")] if with_errors else []),
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = load_transcriber()
        for batch in batches:
            texts, errors = [], []
            for path in batch["path"]:
                text, problem = None, None
                try:
                    text = transcribe(path)
                except Exception as error:  # skip this file only
                    problem = str(error) or type(error).__name__
                errors.append(problem)
                texts.append(None if text is None else text.strip())
            yield pd.DataFrame({"file_path": batch["path"], "text": texts, "error": errors})

    # a listing is tiny next to the work behind it: spread it evenly
    n = n_partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paths = wanted.select("path").repartition(n, "path")
    done = paths.mapInPandas(run, schema)
    return done if with_errors else done.filter(F.col("text").isNotNull()).drop("error")
