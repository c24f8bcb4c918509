"""Data health of a panel: missing values, rows and symbols by month and day, repeated keys, in one scan.

Exact counts add rows up by (symbol, date) first, with map-side partials, so that distinct keys are rows
and every figure is a sum. The quick way keeps sketches instead, which merge without that exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL


def _level() -> Column:
    return F.when(F.grouping("_day") == 0, "day").when(F.grouping("_month") == 0, "month").otherwise("all").alias("level")


def panel_health(df: DataFrame, columns: Sequence[str], exact: bool = True, precision: float = 0.02) -> DataFrame:
    """``level, period, rows, keys, repeated, {column}_missing``: one row for all, per month and per day.

    ``keys`` are distinct (symbol, date), which at the level ``day`` are the symbols of the day; ``repeated`` counts the
    rows beyond the first of each, ``missing`` is the share of nulls and NaNs. With ``exact`` off, keys are estimated
    within about ``precision`` and ``repeated`` follows from the estimate. Rows without a date have a null period.
    """
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    absent = {c: F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull() for c in columns}
    gaps = [f"_gap_{k}" for k in range(len(columns))]
    day, month = F.to_date(DATE).alias("_day"), F.trunc(F.to_date(DATE), "month").alias("_month")
    sets = [[], [F.col("_month")], [F.col("_month"), F.col("_day")]]
    if exact:
        keyed = df.groupBy(SYMBOL, day).agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(absent[c]).alias(g) for c, g in zip(columns, gaps, strict=True)])
        source, rows, keys = keyed.withColumn("_month", F.trunc("_day", "month")), F.sum("_rows"), F.count(F.lit(1))
        missing = [F.sum(g) for g in gaps]
    else:
        key = F.xxhash64(F.col(SYMBOL), F.col("_day"))
        source = df.select(F.col(SYMBOL), day, month, *[absent[c].alias(g) for c, g in zip(columns, gaps, strict=True)])
        rows, keys, missing = F.count(F.lit(1)), F.approx_count_distinct(key, precision), [F.count_if(g) for g in gaps]
    found = source.groupingSets(sets, "_month", "_day").agg(
        _level(), rows.alias("rows"), keys.alias("keys"), *[m.alias(g) for m, g in zip(missing, gaps, strict=True)]
    )
    period = F.when(F.col("level") == "day", F.col("_day")).when(F.col("level") == "month", F.col("_month"))
    shares = [F.try_divide(F.col(g), F.col("rows")).alias(f"{c}_missing") for c, g in zip(columns, gaps, strict=True)]
    repeated = F.greatest(F.col("rows") - F.col("keys"), F.lit(0))
    return found.select("level", period.alias("period"), "rows", "keys", repeated.alias("repeated"), *shares)
