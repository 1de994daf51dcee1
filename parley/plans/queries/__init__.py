"""Named queries over the given tables, each with an equivalent SQL text."""

from parley.plans.queries import (  # noqa: F401  (they register their queries)
    activity,
    cleaning,
    comparing,
    files,
    modelling,
    parsing,
    profiles,
    streams,
)
from parley.plans.queries.registry import QUERIES, sql_texts

__all__ = ["QUERIES", "sql_texts"]
