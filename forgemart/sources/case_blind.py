"""A mart whose texts compare without regard to case, as the model's own text comparison does."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLATION = "UTF8_LCASE"


def case_blind(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """The rows with text columns (all, or those named) under a collation that ignores case: filters,
    groups, joins, distinct counts and sorting on them then agree about what is equal.

    A group is shown as one of its spellings. Parquet doesn't prune by such columns, so filters that
    are known to be in one case belong before this.
    """
    chosen = set(df.columns if columns is None else columns)
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name in chosen]
    return df.withColumns({c: F.collate(F.col(f"`{c}`"), COLLATION) for c in texts})


class CaseBlindMart:
    """Another mart's tables with case-blind texts."""

    def __init__(self, mart):
        self._mart = mart

    def table(self, name: str, *columns: str) -> DataFrame:
        return case_blind(self._mart.table(name, *columns))
