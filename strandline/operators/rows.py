"""Row-level helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, key: str, columns: dict[str, Column], prefer: Column | None = None) -> DataFrame:
    """One row per ``key``: (key, *columns).

    Repeated rows count once. Of repeated rows that differ, the one with the
    smallest (``prefer``, *columns) is kept (nulls first), so the result does not
    depend on the order of rows. Rows whose key is null are left out. Columns other than
    the named ones are ignored, so clashing names cannot matter.
    """
    order = ([prefer.alias("__p")] if prefer is not None else []) + [c.alias(n) for n, c in columns.items()]
    kept = df.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.struct(*order).alias("__row"))
    least = kept.groupBy(key).agg(F.min("__row").alias("__row"))
    return least.select(key, *[F.col(f"__row.{n}").alias(n) for n in columns])
