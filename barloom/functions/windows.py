"""Window frames and numeric primitives shared by all feature code.

A panel holds one row per (symbol, date) and ``date`` is a DATE, so a symbol never has more rows
than there are calendar days. That is why windows and grouped maps may partition by symbol: the
group is bounded by the calendar, however large the panel grows. A date has no such bound (a
cross-section is as wide as the universe); see ``operators.cross_section`` for that axis.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL

EPS = 1e-12
#: Rows of a panel that one task sorts by symbol: at most some 100 MB, so nothing is spilled.
ROWS_PER_TASK = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks a panel of so many rows is spread over by symbol: whole rounds of the cores at hand."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    return -(-(rows // ROWS_PER_TASK + 1) // cores) * cores


def per_symbol() -> WindowSpec:
    return Window.partitionBy(SYMBOL).orderBy(DATE)


def trailing(rows: int) -> WindowSpec:
    return per_symbol().rowsBetween(-(rows - 1), 0)


def leading(rows: int) -> WindowSpec:
    return per_symbol().rowsBetween(1, rows)


def running() -> WindowSpec:
    return per_symbol().rowsBetween(Window.unboundedPreceding, 0)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg: Callable[[Column], Column], x: Column | str, rows: int) -> Column:
    """Trailing aggregate that is null until ``rows`` non-null values are in the frame."""
    x, frame = _col(x), trailing(rows)
    return F.when(F.count(x).over(frame) >= rows, agg(x).over(frame))


def with_rolling(df: DataFrame, wanted: dict[str, tuple[Callable, str, int]]) -> DataFrame:
    """Many ``rolling`` columns, ``{name: (aggregate, column, rows)}``, in one window operator.

    Aggregates of the same column and frame share one count of non-null values.
    """
    frames = {(c, n): f"__n_{c}_{n}" for _, c, n in wanted.values()}
    added = {name: F.count(c).over(trailing(n)) for (c, n), name in frames.items()}
    added |= {f"__{name}": agg(c).over(trailing(n)) for name, (agg, c, n) in wanted.items()}
    gated = {
        name: F.when(F.col(frames[c, n]) >= n, F.col(f"__{name}"))
        for name, (_, c, n) in wanted.items()
    }
    return df.withColumns(added).withColumns(gated).drop(*added)


def drop_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def prior(x: Column | str, rows: int = 1) -> Column:
    return F.lag(_col(x), rows).over(per_symbol())


def safe_div(a: Column | str, b: Column | str, eps: float = EPS) -> Column:
    """a / (|b| + eps). The sign of b is dropped by definition."""
    return _col(a) / (F.abs(_col(b)) + F.lit(eps))


def standardise(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / (std + eps); exactly 0 where every value in the group is the same."""
    return F.when(std == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise(
        (x - mean) / (std + F.lit(EPS))
    )


def rolling_zscore(x: Column | str, rows: int) -> Column:
    x, frame = _col(x), trailing(rows)
    z = standardise(x, F.avg(x).over(frame), F.stddev_samp(x).over(frame))
    return F.when(F.count(x).over(frame) >= rows, z)


def clip(x: Column, bound: float) -> Column:
    # greatest/least skip nulls, so a null has to be kept apart
    return F.when(x.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * position / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
