"""Mixing of sources to target weights by Pareto order sampling.

All steps are DataFrame operations.  A document first gets the whole copies
that its source's rate makes certain.  The words still missing are filled by an
order sample: documents are ranked by their random odds over their inclusion
odds, and the lowest ranks are taken until the words are reached.

Ranks are never sorted as a whole: sums per source and bin of the rank show the
bin in which the words run out, and only that bin is sorted.  What a round
leaves (less than the next document) is filled by further rounds among the
documents that still fit.  Each round ends in two numbers per source, so that
every decision is an expression on the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.common import WORD, saved
from parley.session import attach

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source, and a document, may be used
BINS = 4096
ROUNDS = 5


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    digits = F.substring(F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to one row per source (source, words).

    Weights go round the sources in code-point order, null last.  A target
    stops at ``most`` times the words of its source; what is above is shared out
    again by weight.  The level at which all is placed is found in one pass:
    with sources in order of cap over weight, it is the highest of the levels
    left after capping the first k.  One row per source meets in one task.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double")
    caps = sources.withColumn("weight", weight).withColumn("cap", (F.col("words") * most).cast("double"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = caps.withColumn("level", (F.sum("words").over(everything) - before) / rest)
    top = F.max("level").over(everything)
    return level.select("source", "words", F.least(F.col("cap"), top * F.col("weight")).alias("target"))


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def _extra(plan: list[tuple[str, str]]) -> Column:
    """1 where one of the rounds takes the document once more."""
    taken = F.lit(False)
    for room, cut in plan:
        taken = taken | ((F.col("__size") <= F.col(room)) & (F.col("__rank") < F.col(cut)))
    return F.when(taken, 1).otherwise(0)


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    prefer: str | None = None,
    rounds: int = ROUNDS,
    bins: int = BINS,
) -> DataFrame:
    """All documents with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    docs: doc_id, text, source; a column with one of the four names is replaced.
    ``prefer`` names a positive column that makes documents likelier: the
    inclusion probability of the last copy is the source's rate times prefer over
    its mean in the source.  Null and blank texts have size 0 and get the whole
    copies of their source only.  Rows with the same doc_id get the same rank
    and are taken together.  The result does not depend on partitioning.
    """
    own = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*own)
    ranked = docs.select(
        F.col("doc_id"),
        _key(F.col("source")).alias("__key"),
        F.col("source"),
        size_of(F.col("text")).alias("__size"),
        (F.col(prefer).cast("double") if prefer else F.lit(1.0)).alias("__prefer"),
    )
    table = saved(ranked, "sizes")
    sums = table.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__size").alias("words"), F.avg("__prefer").alias("__mean"))
    rates = targets(sums.select("source", "words"), weights, most).withColumn("__key", _key(F.col("source"))).drop("source")
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    state = (
        sums.select("__key", "__mean")
        .join(rates, "__key")
        .withColumn("__whole", F.least(F.floor(rate + 1e-9), F.lit(most)).cast("int"))
        .withColumn("__share", F.greatest(rate - F.col("__whole"), F.lit(0.0)))
        .withColumn("__room0", F.greatest(F.col("target") - F.col("__whole") * F.col("words"), F.lit(0.0)))
    )
    plan: list[tuple[str, str]] = []

    def with_rank(rows: DataFrame) -> DataFrame:
        chance = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("__share") * F.col("__prefer") / F.col("__mean")))
        odds = uniform(F.col("doc_id"))
        return rows.withColumn("__rank", (odds / (1 - odds)) / (chance / (1 - chance)))

    for k in range(rounds):
        state = saved(state, "mix-state")
        room, cut = f"__room{k}", f"__cut{k}"
        open_ = with_rank(attach(table, state, ["__key"], how="inner")).filter(
            (F.col("__size") > 0) & (F.col("__size") <= F.col(room)) & (_extra(plan) == 0)
        )
        open_ = open_.withColumn("__bin", F.floor(F.col("__rank") / (1 + F.col("__rank")) * bins).cast("int"))
        by_bin = open_.groupBy("__key", "__bin").agg(F.sum("__size").alias("__sum"), F.first(room).alias("__want"))
        upto = F.sum("__sum").over(Window.partitionBy("__key").orderBy("__bin"))
        turning = (
            by_bin.withColumn("__upto", upto)
            .filter(F.col("__upto") > F.col("__want"))
            .groupBy("__key")
            .agg(F.min("__bin").alias("__bin"), F.min_by(F.col("__upto") - F.col("__sum"), "__bin").alias("__before"))
        )
        inside = (
            attach(open_, turning, ["__key", "__bin"], how="inner")
            .groupBy("__key", "__rank", "__before", room)
            .agg(F.sum("__size").alias("__sum"))
            .withColumn("__upto", F.col("__before") + F.sum("__sum").over(Window.partitionBy("__key").orderBy("__rank")))
            .filter(F.col("__upto") > F.col(room))
            .groupBy("__key")
            .agg(F.min("__rank").alias(cut), F.min_by(F.col("__upto") - F.col("__sum"), "__rank").alias("__used"))
        )
        all_of = by_bin.groupBy("__key").agg(F.sum("__sum").alias("__all"))
        state = (
            state.join(inside, "__key", "left")
            .join(all_of, "__key", "left")
            .withColumn(f"__room{k + 1}", F.greatest(F.col(room) - F.coalesce("__used", "__all", F.lit(0)), F.lit(0.0)))
            .withColumn(cut, F.coalesce(F.col(cut), F.lit(float("inf"))))
            .drop("__used", "__all")
        )
        plan.append((room, cut))
    final = saved(state, "mix-state").withColumnRenamed("words", "mix_source_size").withColumnRenamed("target", "mix_target")
    rows = docs.withColumn("__key", _key(F.col("source"))).withColumn("__size", size_of(F.col("text")))
    rows = rows.withColumn("__prefer", F.col(prefer).cast("double") if prefer else F.lit(1.0))
    rows = with_rank(attach(rows, final, ["__key"], how="inner"))
    extra = F.when(F.col("__size") > 0, _extra(plan)).otherwise(0)
    return rows.withColumn("mix_copies", F.col("__whole") + extra).select(*docs.columns, F.col("__size").alias("mix_size"), *own[1:])


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, same columns."""
    return mixed(docs, **options).filter("mix_copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*docs.columns)
