"""Result tables that a stream keeps up to date, a folder for each micro-batch.

A chat that lands today may correct any day of any group, so no state can be
forgotten by the time of a message, and rewriting a whole table in each batch
does not scale.  These tables need no state store: each batch writes what it
adds, readers merge, and every now and then the parts are merged into one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from parley.operators.clean import clean_messages
from parley.operators.language import SAMPLE_MESSAGES, detect_language
from parley.session import attach, spread

_FOLDER = re.compile(r"(batch|merged)=(\d+)")
ORDER = ("timestamp", "path", "block", "seq")


class BatchLog:
    """Folders ``batch=N`` (what batch N adds) and ``merged=N`` (all up to N).

    ``merge`` brings rows of several batches together and must be associative:
    ``merge(merge(a) + b) = merge(a + b)``.  Without it the batches are only put
    one after the other and never merged.  A batch that is run again writes its
    own folder again from what lies before it, so a restart changes nothing.
    Folders are visible once they are complete; without a merge their number grows with
    the batches, so let a batch take many files.  Merging removes the folders of
    the merge before the last one, so a reader that has just listed them is safe.
    """

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame] | None = None, merge_every: int = 100):
        if merge_every < 1:
            raise ValueError("merge_every must be at least 1")
        self.path, self.merge, self.merge_every = path.rstrip("/"), merge, merge_every

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number:012d}"

    def _complete(self, spark: SparkSession) -> dict[str, list[int]]:
        """Numbers of the complete folders; at most ``2 * merge_every`` with a merge."""
        files = spark._jvm.org.apache.hadoop.fs
        root = files.Path(self.path)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        found: dict[str, list[int]] = {"batch": [], "merged": []}
        if system.exists(root):
            for status in system.listStatus(root):
                match = _FOLDER.fullmatch(status.getPath().getName())
                if match and system.exists(files.Path(status.getPath(), "_SUCCESS")):
                    found[match[1]].append(int(match[2]))
        return {kind: sorted(numbers) for kind, numbers in found.items()}

    def last(self, spark: SparkSession) -> int | None:
        """The latest complete batch."""
        there = self._complete(spark)
        return max(there["batch"] + there["merged"], default=None)

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """All rows (of the batches ``before`` a number); None while there is no batch."""
        there = self._complete(spark)
        fits = lambda n: before is None or n < before
        base = max(filter(fits, there["merged"]), default=None)
        parts = [] if base is None else [self._folder("merged", base)]
        parts += [self._folder("batch", n) for n in there["batch"] if fits(n) and (base is None or n > base)]
        if not parts:
            return None
        rows = spark.read.parquet(*parts)
        return rows if self.merge is None else self.merge(rows)

    def read_batch(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(self._folder("batch", number))

    def write(self, rows: DataFrame, number: int) -> None:
        """What batch ``number`` adds."""
        spark = rows.sparkSession
        added = rows if self.merge is None else self.merge(rows)
        added.write.mode("overwrite").parquet(self._folder("batch", number))
        if self.merge is not None and (number + 1) % self.merge_every == 0:
            self.read(spark, number + 1).write.mode("overwrite").parquet(self._folder("merged", number))
            self._forget(spark, number)

    def _forget(self, spark: SparkSession, number: int) -> None:
        there = self._complete(spark)
        done = [n for n in there["merged"] if n < number]
        if not done:
            return
        files = spark._jvm.org.apache.hadoop.fs
        old = [self._folder("merged", n) for n in done[:-1]]
        old += [self._folder("batch", n) for n in there["batch"] if n <= done[-1]]
        for folder in old:
            path = files.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _each_batch(rows: DataFrame, target: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    # the stream's progress lies inside the table: batch numbers belong to it
    state = f"{target.rstrip('/')}/progress"
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", state)


# -- sums ----------------------------------------------------------------------


def sums_log(target: str, keys: Sequence[str], merge_every: int = 100) -> BatchLog:
    """A table of sums: all columns but the keys are added up."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))

    return BatchLog(f"{target.rstrip('/')}/sums", merge, merge_every)


def _timeline_log(target: str, keys: Sequence[str], merge_every: int = 100) -> BatchLog:
    return sums_log(target, [*keys, "day"], merge_every)


def write_timeline(
    messages: DataFrame, target: str, keys: Sequence[str] = ("group_name",), merge_every: int = 100
) -> DataStreamWriter:
    """Messages per day as a table; start the writer with any trigger.

    A batch writes one row for each key and day that it has messages of, however
    old they are; nothing else is rewritten, but for one merge in ``merge_every``
    batches.  Messages without a time are left out, null keys count as a key.
    The result does not depend on the order or the grouping of the files.
    """
    log = _timeline_log(target, keys, merge_every)
    timed = messages.filter(F.col("timestamp").isNotNull())
    ones = timed.select(*keys, F.to_date("timestamp").alias("day"), F.lit(1).cast("bigint").alias("messages"))
    return _each_batch(ones, target, log.write)


def read_timeline(spark: SparkSession, target: str, keys: Sequence[str] = ("group_name",)) -> DataFrame | None:
    """The days as of the last complete batch; None before the first one."""
    return _timeline_log(target, keys).read(spark)


# -- messages with the language of their group ------------------------------------


class _CleanedTables:
    def __init__(self, target: str, keys: Sequence[str], order: Sequence[str], lists, model, merge_every: int = 100):
        root = target.rstrip("/")
        self.keys, self.order, self.lists, self.model = list(keys), list(order), lists, model
        self.raw = BatchLog(f"{root}/raw")
        self.cleaned = BatchLog(f"{root}/cleaned")
        self.moved = BatchLog(f"{root}/moved")
        self.first = BatchLog(f"{root}/first", self._first_ten, merge_every)
        self.settled = BatchLog(f"{root}/settled", self._latest, merge_every)

    def _first_ten(self, rows: DataFrame) -> DataFrame:
        columns = list(dict.fromkeys([*self.keys, *self.order, "msg_type", "message"]))
        place = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order))
        texts = rows.filter((F.col("msg_type") == "text") & F.col("message").isNotNull()).select(*columns)
        return texts.withColumn("_place", place).filter(F.col("_place") <= SAMPLE_MESSAGES).drop("_place")

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.max_by("language", "since").alias("language"), F.max("since").alias("since"))

    def keyed(self, rows: DataFrame) -> DataFrame:
        """``_key`` stands for the key columns in joins; null keys are equal."""
        return rows.withColumn("_key", F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}))

    def among(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """The rows of the given groups."""
        return attach(self.keyed(rows), self.keyed(groups).select("_key"), ["_key"], "inner").drop("_key")

    def with_settled(self, rows: DataFrame, settled: DataFrame, how: str = "inner") -> DataFrame:
        """Add ``_language`` and ``_since`` of each row's group."""
        values = self.keyed(settled).select("_key", F.col("language").alias("_language"), F.col("since").alias("_since"))
        return attach(self.keyed(rows), values, ["_key"], how).drop("_key")


def write_cleaned(
    messages: DataFrame,
    target: str,
    keys: Sequence[str] = ("group_name",),
    order: Sequence[str] = ORDER,
    language_lists=None,
    language_model=None,
    **clean_options,
) -> DataStreamWriter:
    """Cleaned messages of a stream, in the language of their whole group.

    The first ten text messages of each group are kept (ten rows a group, whatever
    arrives), and its language is found from them as in a batch.  An export that
    lands later may hold older messages; when that changes the language, the
    messages of this group that came before are cleaned again, and only they.
    After each batch the table equals ``clean_messages`` on all messages so far,
    in whatever order and grouping the files landed.  ``messages`` are parsed
    messages with the ``order`` columns; options go to ``clean_messages``.
    """
    t = _CleanedTables(target, keys, order, language_lists, language_model)

    def clean(rows: DataFrame, settled: DataFrame) -> DataFrame:
        named = t.with_settled(rows.drop("language", "since"), settled)
        named = named.withColumnsRenamed({"_language": "language", "_since": "since"})
        return clean_messages(named, keys=keys, given_language=True, **clean_options)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        t.raw.write(spread(batch), number)  # a batch of few files is work for all cores
        rows = t.raw.read_batch(spark, number)
        t.first.write(rows, number)
        touched = rows.select(*keys).distinct()
        firsts = t.among(t.first.read(spark, number + 1), touched)
        found = detect_language(firsts, keys, order, language_lists, language_model)
        before = t.settled.read(spark, number)
        if before is None:
            before = found.withColumn("since", F.lit(number).cast("bigint")).limit(0)
        # groups without a text message have no language yet
        named = t.with_settled(touched, found.withColumn("since", F.lit(None).cast("bigint")), "left")
        named = named.select(*keys, F.col("_language").alias("language"))
        was = t.with_settled(named, before, "left")
        changed = was.filter(F.col("_since").isNull() | ~F.col("language").eqNullSafe(F.col("_language")))
        t.moved.write(changed.select(*keys, "language", F.lit(number).cast("bigint").alias("since")), number)
        moved = t.moved.read_batch(spark, number)
        cleaned = clean(rows, t._latest(before.unionByName(moved)))
        again = t.among(moved, before.select(*keys))
        if not again.isEmpty():
            cleaned = cleaned.unionByName(clean(t.raw.read(spark, number), again))
        t.cleaned.write(cleaned, number)
        t.settled.write(moved, number)  # last: readers go by it

    return _each_batch(messages, target, write)


def read_cleaned(spark: SparkSession, target: str, keys: Sequence[str] = ("group_name",)) -> DataFrame | None:
    """The cleaned messages as of the last complete batch; None before the first one."""
    t = _CleanedTables(target, keys, ORDER, None, None)
    last = t.settled.last(spark)
    if last is None:
        return None
    rows = t.with_settled(t.cleaned.read(spark, last + 1), t.settled.read(spark, last + 1))
    return rows.filter(F.col("since") == F.col("_since")).drop("since", "_since", "_language")
