"""Drawdown and ratios of return series, from states that merge.

A stretch of a series is summed up by its total growth, its highest and lowest wealth on the way and its
worst fall from an earlier height, all as logarithms. Two stretches that follow each other merge into the same kind of state,
so a series is cut into stretches of bounded length, folded there, and the states are merged level by
level: no task sees a series in whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 1024


def one_return(ret: Column) -> Column:
    """The state of a single period, in logarithms: wealth goes from 1 to ``1 + ret``, or to 0 if all or more is lost."""
    growth = F.when(ret > -1, F.log1p(ret)).otherwise(F.lit(float("-inf")))
    return F.struct(
        growth.alias("growth"), F.greatest(growth, F.lit(0.0)).alias("high"),
        F.least(growth, F.lit(0.0)).alias("low"), F.least(growth, F.lit(0.0)).alias("fall"),
    )


def merged(first: Column, then: Column) -> Column:
    """The state of two stretches in a row. ``high`` and ``low`` start from a wealth of 1, ``fall`` from the height before it."""
    return F.struct(
        (first["growth"] + then["growth"]).alias("growth"),
        F.greatest(first["high"], first["growth"] + then["high"]).alias("high"),
        F.least(first["low"], first["growth"] + then["low"]).alias("low"),
        F.least(first["fall"], then["fall"], first["growth"] + then["low"] - first["high"]).alias("fall"),
    )


def _folded(rows: DataFrame, keys: Sequence[str], order: str, state: Column) -> DataFrame:
    """The states of a group in order, merged to one."""
    nothing = F.struct(*[F.lit(0.0).alias(n) for n in ("growth", "high", "low", "fall")])
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), state.alias("s"))))
    return rows.groupBy(*keys).agg(F.aggregate(listed, nothing, lambda done, x: merged(done, x["s"])).alias("state"))


def drawdown(series: DataFrame, by: Sequence[str], at: str = "pos", ret: str = "ret") -> DataFrame:
    """``by..., log_growth, max_drawdown``: logarithm of the total growth and the worst fall from a height, 0 or less.

    ``at`` is a whole number from 0, at most once in a series; periods without a return are passed over. Stretches of
    ``STRETCH`` numbers are folded first and then as many states at a time, until one is left. Logarithms keep growth
    finite however long a series is; a loss of all is minus infinity.
    """
    by, known = list(by), series.where(F.col(ret).isNotNull()).select(*by, F.col(at).cast("long").alias("_at"), F.col(ret).cast("double").alias("_ret"))
    widest = known.agg(F.max("_at")).first()[0] or 0
    states = _folded(known.withColumn("_part", F.expr(f"_at div {STRETCH}")), [*by, "_part"], "_at", one_return(F.col("_ret")))
    parts = widest // STRETCH
    while parts:
        parts //= STRETCH
        upper = states.select(*by, F.col("_part").alias("_at"), F.expr(f"_part div {STRETCH}").alias("_part"), "state")
        states = _folded(upper, [*by, "_part"], "_at", F.col("state"))
    return states.select(*by, F.col("state.growth").alias("log_growth"), F.expm1("state.fall").alias("max_drawdown"))


def ratios(series: DataFrame, by: Sequence[str], periods: float, ret: str = "ret", benchmark: str | None = None) -> DataFrame:
    """``by..., n, mean, volatility, sharpe, hit_ratio`` and, with a benchmark column, ``information_ratio``.

    Deviations use n - 1; ``periods`` per year scale volatility and ratios. A series without variation has no ratio.
    """
    x, root = F.col(ret), F.lit(float(periods) ** 0.5)
    columns = {
        "n": F.count(x), "mean": F.avg(x), "volatility": F.stddev_samp(x) * root,
        "sharpe": F.try_divide(F.avg(x), F.stddev_samp(x)) * root,
        "hit_ratio": F.avg((x > 0).cast("double")),
    }
    if benchmark:
        active = x - F.col(benchmark)
        columns["information_ratio"] = F.try_divide(F.avg(active), F.stddev_samp(active)) * root
    return series.groupBy(*by).agg(*[v.alias(k) for k, v in columns.items()])


def performance(series: DataFrame, by: Sequence[str], periods: float, at: str = "pos", ret: str = "ret", benchmark: str | None = None) -> DataFrame:
    """Ratios and drawdown of each series in one frame."""
    return ratios(series, by, periods, ret, benchmark).join(drawdown(series, by, at, ret), list(by))
