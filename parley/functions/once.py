"""Keep the optimizer from computing an expensive expression several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later filters cannot pull apart.

    A filter on a computed column is pushed below the projection, where the
    expression is evaluated again for every mention.  For long regex chains that
    multiplies the cost.  The output of a generator stays where it is: this one
    emits exactly one row per input row.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def unnest(df: DataFrame, keep: list, array: str | Column, name: str) -> DataFrame:
    """One row per array element; null and empty arrays vanish.

    A plain ``explode`` makes the optimizer test the array's size first, which
    computes it twice.
    """
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.filter(F.col(name).isNotNull())
