"""Input contract, key check and type compaction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, REQUIRED_COLUMNS, SYMBOL

#: Bytes of the integer widths.
WIDTHS = {"byte": 1, "short": 2, "int": 4, "long": 8}


def as_date(df: DataFrame, column: str) -> Column:
    """The column as a DATE. Text in none of the vendors' forms raises; null stays null."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        return F.to_date(column)
    read = [F.try_to_date(column, form) for form in ("yyyyMMdd", "yyyy-MM-dd", "yyyy/MM/dd")]
    refused = F.raise_error(F.concat(F.lit("unreadable date: "), F.col(column))).cast("date")
    return F.when(F.col(column).isNotNull(), F.coalesce(*read, refused))


def check_input(df: DataFrame) -> DataFrame:
    """Require the panel columns, make ``date`` a DATE and turn NaN into null.

    No sort: windows order rows where order matters.
    """
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks {missing}")
    fixed = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    if not isinstance(df.schema[DATE].dataType, T.DateType):
        fixed[DATE] = as_date(df, DATE)
    return df.withColumns(fixed) if fixed else df


def unique_rows(df: DataFrame) -> int:
    """The number of rows; raises when a (symbol, date) occurs twice.

    One aggregate gives both. Counts combine map-side, so copies cannot pile up.
    """
    counts = df.groupBy(SYMBOL, DATE).count()
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.max_by(F.struct(SYMBOL, DATE, "count"), "count").alias("worst")).first()
    if size["keys"] and size["worst"]["count"] > 1:
        row = size["worst"]
        raise ValueError(f"Panel has {row['count']} rows for {row[SYMBOL]} on {row[DATE]}; normalise daily bars first.")
    return size["keys"]


def assert_unique_keys(df: DataFrame) -> DataFrame:
    unique_rows(df)
    return df


def compact_types(df: DataFrame, integers: Mapping[str, str] | None = None) -> DataFrame:
    """Doubles become floats, the symbol a string, and integers the declared widths of ``integers``.

    Widths (``byte``, ``short``, ``int``, ``long``) are declared, not found by a scan; a value that does not fit raises.
    """
    casts = {
        f.name: F.col(f.name).cast("float")
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType)
    }
    for name, width in (integers or {}).items():
        if width not in WIDTHS or not isinstance(df.schema[name].dataType, T.IntegralType):
            raise ValueError(f"{name}: {width} is no width for {df.schema[name].dataType.simpleString()}")
        limit = 1 << 8 * WIDTHS[width] - 1
        value = F.col(name)
        fits = value.isNull() | value.between(F.lit(-limit), F.lit(limit - 1))
        refused = F.raise_error(F.concat(F.lit(f"{name} does not fit {width}: "), value.cast("string"))).cast(width)
        casts[name] = F.when(fits, value.cast(width)).otherwise(refused)
    if SYMBOL in df.columns:
        casts[SYMBOL] = F.col(SYMBOL).cast("string")
    return df.withColumns(casts)
