"""Normalising vendor landing tables into panel bars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, SYMBOL

VALUE_COLUMNS = ("open", "high", "low", "close", "volume", "amount")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first whole row per key by a stated order.

    An aggregate, not a window: copies of one key combine map-side, so a key repeated in a large
    share of the rows costs one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*df.columns)


def daily_bars(parts: Sequence[DataFrame], order: Sequence[str | Column] | None = None) -> DataFrame:
    """Vendor 1: rename, union, parse dates and keep one row per (symbol, date).

    ``order`` says which copy counts as the first; by default the smallest remaining columns.
    """
    if not parts:
        raise ValueError("daily bars need at least one table")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    df = df.withColumnsRenamed({"trade_date": DATE, "vol": "volume"})
    if isinstance(df.schema[DATE].dataType, T.StringType):
        df = df.withColumn(DATE, F.to_date(DATE, "yyyyMMdd"))
    rest = [c for c in df.columns if c not in (SYMBOL, DATE)]
    return first_per_key(df, [SYMBOL, DATE], order or rest)


def _numbers(df: DataFrame) -> dict[str, Column]:
    return {c: F.col(c).try_cast("double") for c in VALUE_COLUMNS if c in df.columns}


def text_daily_bars(df: DataFrame, code: str | Column) -> DataFrame:
    """Vendor 2, daily: every field arrives as text."""
    code = F.lit(code) if isinstance(code, str) else code
    return df.withColumns(
        {
            **_numbers(df),
            "code": code,
            "time": F.to_timestamp_ntz(F.col(DATE), F.lit("yyyy-MM-dd")),
            "frequency": F.lit("d"),
        }
    )


def text_minute_bars(df: DataFrame, code: str | Column, minutes: int | str = 5) -> DataFrame:
    """Vendor 2, minute bars: time is ``yyyyMMddHHmmss`` with three trailing zeros."""
    code = F.lit(code) if isinstance(code, str) else code
    return df.withColumns(
        {
            **_numbers(df),
            "code": code,
            "time": F.to_timestamp_ntz(F.substring("time", 1, 14), F.lit("yyyyMMddHHmmss")),
            "frequency": F.lit(f"{minutes}min"),
        }
    )


def listed_stocks(df: DataFrame) -> DataFrame:
    """Security master rows that are stocks (type '1')."""
    return df.where(F.col("type") == "1")
