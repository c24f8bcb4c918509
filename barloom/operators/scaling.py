"""Scaler fitting, mergeable moments, missing masks, forward fill and the feature base table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, SYMBOL, YearSplits
from barloom.functions.windows import running

Scaler = dict[str, tuple[float, float]]


def split_of(date: Column, splits: YearSplits) -> Column:
    """Split name by calendar year; null for a year in no split."""
    name = F.lit(None).cast("string")
    for split, years in splits.as_dict().items():
        name = F.when(F.year(date).isin(*years), split).otherwise(name) if years else name
    return name


def rows_of_years(df: DataFrame, years: Sequence[int], date: str = DATE) -> DataFrame:
    """Rows of the given years, as date ranges, which the scan can prune."""
    inside = F.lit(False)
    for year in sorted(set(years)):
        inside = inside | F.col(date).between(*year_bounds(year, year))
    return df.where(inside)


def year_bounds(first: int, last: int) -> tuple[Column, Column]:
    return F.lit(dt.date(first, 1, 1)), F.lit(dt.date(last, 12, 31))


def fit_scaler(df: DataFrame, columns: Sequence[str], splits: YearSplits) -> Scaler:
    """Mean and population deviation per column over the train years, as one aggregate row."""
    _refuse({c: "not in the panel" for c in columns if c not in df.columns})
    train = rows_of_years(df, splits.as_dict()["train"])
    row = train.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"{c}|mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}|std") for c in columns],
    ).first()
    if not row["_rows"]:
        raise ValueError("the panel has no row of the train years")
    # a constant column keeps its values; a column without any value is never scaled
    return {c: (row[f"{c}|mean"] or 0.0, row[f"{c}|std"] or 1.0) for c in columns}


def partial_moments(df: DataFrame, columns: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """(count, sum, sum of squares) per feature and part of the data, in long form.

    The rows are aggregated in their wide form; only the result is turned into long rows.
    """
    x = {c: F.col(c).cast("double") for c in columns}
    wide = df.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.count(v).alias("count"),
                F.sum(v).alias("sum"),
                F.sum(v * v).alias("sumsq"),
            ).alias(f"__{c}")
            for c, v in x.items()
        ]
    )
    keys = [c for c in wide.columns if not c.startswith("__")]
    return wide.select(*keys, F.inline(F.array(*[f"__{c}" for c in columns])))


def merge_moments(parts: DataFrame) -> DataFrame:
    return parts.groupBy("feature").agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq")
    )


def presence_mask(column: str) -> Column:
    return F.col(column).isNotNull().cast("byte")


def forward_fill(column: str) -> Column:
    """Last known value of the symbol, 0 before the first."""
    return F.coalesce(F.last(column, ignorenulls=True).over(running()), F.lit(0.0))


def scale(value: Column, mean: float, deviation: float) -> Column:
    return (value - F.lit(mean)) / F.lit(deviation)


def _refuse(faults: dict[str, str]) -> None:
    """Raise with all faulty columns and what is wrong with each."""
    if faults:
        raise ValueError(", ".join(f"{column}: {fault}" for column, fault in faults.items()))


def check_feature_columns(df: DataFrame, columns: Sequence[str], scaled: Sequence[str]) -> None:
    types = {f.name: f.dataType for f in df.schema.fields}
    faults = {c: "scaled but no feature" for c in scaled if c not in columns}
    for c in columns:
        if not isinstance(types.get(c), T.NumericType):
            faults[c] = "not a number" if c in types else "not in the panel"
    _refuse(faults)


def feature_base(df: DataFrame, columns: Sequence[str], scaler: Scaler) -> DataFrame:
    """(symbol, date, filled and scaled features, one mask per feature). Coalescing to 0 leaves no
    null behind; masks describe the values before filling."""
    check_feature_columns(df, columns, list(scaler))
    filled = {
        c: scale(forward_fill(c), *scaler[c]) if c in scaler else forward_fill(c) for c in columns
    }
    return df.select(
        SYMBOL,
        DATE,
        *[v.cast("float").alias(c) for c, v in filled.items()],
        *[presence_mask(c).alias(f"{c}_mask") for c in columns],
    )


def assert_no_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Raise when a feature still holds a null (one aggregate over the table)."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    left = [c for c in columns if row[c]]
    if left:
        raise ValueError(f"stored features hold nulls: {left}")
    return df
