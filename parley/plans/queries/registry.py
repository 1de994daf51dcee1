"""Where queries register: Spark function and SQL side by side."""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Callable
from functools import lru_cache

import pyspark
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return register


def sql_texts() -> dict[str, str]:
    return {name: text() if callable(text) else text for name, text in _SQL.items()}


@lru_cache(maxsize=None)
def bundled_list(name: str) -> tuple[str, ...]:
    """A stop-word list of Spark ML, read from its jar: no session needed."""
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars")
    for jar in glob.glob(os.path.join(jars, "spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as archive:
            data = archive.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt")
            return tuple(data.decode("utf-8").split("\n"))
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(name))


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(sql_string(w) for w in words) + "]"
