"""Portfolios from predictions: returns by quantile, cohorts held for several days, turnover and costs.

A quantile is a range of places in the date's order of predictions, which ``ranking`` finds for dates of
any size. Holding periods overlap: the portfolio of a day is the mean of the cohorts of the last
``holding`` days, so a sample is spread over as many days as it is held and nothing else grows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import SYMBOL
from barloom.functions.staging import stored
from barloom.operators.ranking import positions_in_group
from barloom.operators.scoring import DAY, MIN_GROUP_SIZE, complete, scored_days

LONG_SHORT = "long_short"


def with_quantile(rows: DataFrame, groups: int) -> DataFrame:
    """Adds ``quantile``, from 1 for the lowest predictions; sizes in a date differ by one at most. ``rows`` are read twice,
    so they should be stored."""
    placed = positions_in_group(rows, [DAY], "y_pred", "sample_id")
    return placed.withColumn("quantile", F.expr(f"(_position - 1) * {int(groups)} div _group_rows + 1")).drop("_position", "_group_rows")


def log_wealth(ret: Column, frame) -> Column:
    """Logarithm of the running product of ``1 + ret`` over the frame; minus infinity from a total loss on, null returns count as 0."""
    growth = F.coalesce(F.sum(F.log1p(F.when(ret > -1, ret))).over(frame), F.lit(0.0))
    return F.when(F.min(ret).over(frame) <= -1, F.lit(float("-inf"))).otherwise(growth)


def quantile_returns(preds: DataFrame, groups: int = 5, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """``label_date, portfolio, n, ret, log_wealth``: mean target of each quantile of a date, and of the highest less the lowest.

    ``log_wealth`` compounds a portfolio's returns over the dates. Dates that scores leave out are left out here.
    """
    rows = with_quantile(stored(complete(preds).select(DAY, "sample_id", "y_pred", "y_true")), groups)
    mine = lambda q: F.when(F.col("quantile") == q, F.col("y_true"))
    metrics = {f"n_{q}": F.count(mine(q)) for q in range(1, groups + 1)} | {f"r_{q}": F.avg(mine(q)) for q in range(1, groups + 1)}
    days = scored_days(rows, min_size, False, **metrics)
    one = lambda name, n, ret: F.struct(F.lit(name).alias("portfolio"), n.cast("long").alias("n"), ret.alias("ret"))
    each = [one(f"q{q}", F.col(f"n_{q}"), F.col(f"r_{q}")) for q in range(1, groups + 1)]
    each.append(one(LONG_SHORT, F.col("n_1") + F.col(f"n_{groups}"), F.col(f"r_{groups}") - F.col("r_1")))
    returns = days.select(DAY, F.inline(F.array(*each)))
    # one row per date and portfolio
    sofar = Window.partitionBy("portfolio").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("log_wealth", log_wealth(F.col("ret"), sofar))


def monotonicity(returns: DataFrame) -> DataFrame:
    """One row: the quantiles' mean returns in order, how many of the steps rise, and whether all do."""
    means = returns.where(F.col("portfolio") != LONG_SHORT).groupBy("portfolio").agg(F.avg("ret").alias("mean"))
    number = F.expr("cast(substring(portfolio, 2) as int)")
    ordered = means.agg(F.sort_array(F.collect_list(F.struct(number.alias("q"), "mean"))).alias("m"), F.corr(number, "mean").alias("correlation"))
    steps = F.expr("transform(sequence(1, greatest(size(m) - 1, 1)), i -> int(m[i].mean > m[i - 1].mean))")
    rising = F.aggregate(steps, F.lit(0), lambda a, b: a + b)
    return ordered.where("size(m) > 1").select(
        F.expr("transform(m, x -> x.mean)").alias("means"), rising.cast("long").alias("rising"), (F.size("m") - 1).cast("long").alias("steps"),
        (rising == F.size("m") - 1).alias("monotone"), "correlation",
    )


def cohorts(preds: DataFrame, calendar: DataFrame, groups: int = 5, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """``pos, symbol, weight``: the highest quantile of each date that has enough rows, equally weighted.

    ``preds`` needs the symbol column besides those of a prediction table, ``calendar`` is ``(cal_date, pos)``.
    """
    rows = stored(complete(preds).select(DAY, "sample_id", "y_pred", "y_true", SYMBOL))
    top = with_quantile(rows, groups).where(F.col("quantile") == groups)
    days = scored_days(rows, min_size, False).select(DAY)
    sizes = top.groupBy(DAY).agg(F.count(F.lit(1)).alias("_k")).join(days, DAY)
    # both one row per date
    placed = sizes.join(calendar.select(F.col("cal_date").alias(DAY), "pos"), DAY)
    return top.join(placed, DAY).select("pos", SYMBOL, (F.lit(1.0) / F.col("_k")).alias("weight"))


def holdings(bought: DataFrame, holding: Sequence[int]) -> DataFrame:
    """``holding, pos, symbol, weight, before``: what is held on a day, and what was on the day before.

    A row of a cohort gives one row per day that it is held and for the day after. Today's and yesterday's weights
    meet by one aggregate on (holding, day, symbol); the cohorts are read once.
    """
    spans = F.explode(F.array(*[F.lit(int(h)) for h in holding]))
    held = bought.select("pos", SYMBOL, F.col("weight").alias("whole"), spans.alias("holding"))
    held = held.select("holding", SYMBOL, (F.col("whole") / F.col("holding")).alias("part"), "pos", F.explode(F.expr("sequence(pos, pos + holding)")).alias("day"))
    both = held.select(
        "holding", F.col("day").alias("pos"), SYMBOL,
        F.when(F.col("day") < F.col("pos") + F.col("holding"), F.col("part")).otherwise(0.0).alias("weight"),
        F.when(F.col("day") > F.col("pos"), F.col("part")).otherwise(0.0).alias("before"),
    )
    return both.groupBy("holding", "pos", SYMBOL).agg(F.sum("weight").alias("weight"), F.sum("before").alias("before"))


def daily_portfolio(held: DataFrame, returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """``holding, date, names, kept, turnover, gross``: one row per holding period and trading day.

    ``kept`` counts names that were held the day before, ``turnover`` is half the sum of weight changes, ``gross``
    the weighted return of the day. ``returns`` is ``(symbol, pos, ret)``; a name without a return earns nothing.
    """
    priced = held.join(returns, [SYMBOL, "pos"], "left")
    days = priced.groupBy("holding", "pos").agg(
        F.count_if(F.col("weight") > 0).alias("names"),
        F.count_if((F.col("weight") > 0) & (F.col("before") > 0)).alias("kept"),
        (F.sum(F.abs(F.col("weight") - F.col("before"))) / 2.0).alias("turnover"),
        F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"),
    )
    return days.join(calendar.select("pos", F.col("cal_date").alias("date")), "pos").drop("pos")


def cost_grid(daily: DataFrame, costs: Sequence[float]) -> DataFrame:
    """``holding, cost, days, turnover, gross, net, net_std, hit_ratio``: means over the days at each cost per unit of turnover."""
    priced = daily.select("*", F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("cost"))
    net = F.col("gross") - F.col("cost") * F.col("turnover")
    return priced.groupBy("holding", "cost").agg(
        F.count(F.lit(1)).alias("days"), F.avg("turnover").alias("turnover"), F.avg("gross").alias("gross"),
        F.avg(net).alias("net"), F.stddev_pop(net).alias("net_std"), F.avg((net > 0).cast("double")).alias("hit_ratio"),
    )


def volatility_exposure(preds: DataFrame, groups: int = 5, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """``label_date, n, top, bottom, tilt``: mean predicted deviation of the highest and the lowest quantile and their
    difference in deviations of the whole date; null where the date has one deviation only."""
    rows = with_quantile(stored(complete(preds).select(DAY, "sample_id", "y_pred", "y_true", F.sqrt("pred_risk").alias("_dev"))), groups)
    inside = lambda q: F.avg(F.when(F.col("quantile") == q, F.col("_dev")))
    days = scored_days(rows, min_size, False, top=inside(groups), bottom=inside(1), spread=F.stddev_pop("_dev"))
    return days.withColumn("tilt", F.try_divide(F.col("top") - F.col("bottom"), F.col("spread"))).drop("spread")
