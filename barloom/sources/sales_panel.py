"""Panels derived from order lines: a supplier or a nation plays the symbol, a ship day the bar.

price = extended price / quantity. The first and last price of a day follow the full line key, so
the result does not depend on file order. Most lines of a supplier are a bar of their own, so lines go to
their supplier's task once: the aggregate, the window over its bars and all windows by symbol after them share
that exchange and its sort. A nation has many lines a day; its bars keep map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import DATE, DEFAULT_UNIVERSE, SYMBOL
from barloom.functions.windows import prior, rolling, tasks_for
from barloom.operators.base_features import daily_return
from barloom.operators.membership import flag_membership, snapshot_intervals
from barloom.operators.targets import future_return

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_bars(lines: DataFrame, symbol: Column, tasks: int | None = None) -> DataFrame:
    """One row per symbol and day. With ``tasks`` the lines are spread over so many by their symbol alone."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct(*LINE_KEY)
    price_of = lambda line: F.col(line)["l_extendedprice"] / F.col(line)["l_quantity"]
    rows = lines.select(symbol.cast("string").alias(SYMBOL), F.to_date("l_shipdate").alias(DATE), *LINE_KEY)
    if tasks:
        rows = rows.repartition(tasks, SYMBOL)
    return (
        rows.withColumn("price", price)
        .groupBy(SYMBOL, DATE)
        .agg(
            F.min(key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max(key).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )
        .withColumns({"open": price_of("open"), "close": price_of("close")})
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A: one symbol per supplier."""
    return _supplier_bars(spark, sf_dir)[0]


def _supplier_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Panel A and the number of tasks that it is spread over by symbol."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, lines.count())
    return raw_bars(lines, F.col("l_suppkey"), tasks).withColumn("pre_close", prior("close")), tasks


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel B: one symbol per supplier nation; denser in time."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )
    return raw_bars(lines, F.col("s_nationkey")).withColumn("pre_close", prior("close"))


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade calendar: every ship day, as an exchange calendar table."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("cal_date")).distinct()
    return days.select(F.lit("SSE").alias("exchange"), "cal_date", F.lit(1).alias("is_open"))


def index_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(index_code, trade_date, con_code): on the first ship day of a year, the suppliers whose sales
    of the year before were above that year's average."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("con_code"),
        F.to_date("l_shipdate").alias("day"),
        "l_extendedprice",
    )
    yearly = lines.groupBy("con_code", F.year("day").alias("year")).agg(
        F.sum("l_extendedprice").alias("sales")
    )
    # one row per calendar year each, so both sides are bounded by the calendar
    level = yearly.groupBy("year").agg(F.avg("sales").alias("level"))
    first_day = lines.groupBy((F.year("day") - 1).alias("year")).agg(F.min("day").alias("trade_date"))
    return (
        yearly.join(level, "year")
        .join(first_day, "year")
        .where(F.col("sales") > F.col("level"))
        .select(F.lit("399300.SZ").alias("index_code"), "trade_date", "con_code")
    )


def member_years(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """First and last year with constituents; the first year of sales only decides on the next."""
    row = table(spark, sf_dir, "lineitem").agg(
        F.year(F.min("l_shipdate")).alias("first"), F.year(F.max("l_shipdate")).alias("last")
    ).first()
    return row["first"] + 1, row["last"]


def panel_with_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel A with the membership flag from the yearly snapshots."""
    return universe_by_symbol(spark, sf_dir)[0]


def universe_by_symbol(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Panel A with the membership flag and the number of tasks that it is spread over by symbol."""
    intervals = snapshot_intervals(index_snapshots(spark, sf_dir), *member_years(spark, sf_dir))
    bars, tasks = _supplier_bars(spark, sf_dir)
    return flag_membership(bars, intervals, DEFAULT_UNIVERSE, tasks), tasks


def predictions(panel: DataFrame) -> DataFrame:
    """A prediction table from a naive rule: past five-bar return in coarse steps as the forecast of
    the next five bars, squared 20-bar volatility as its risk."""
    returns = panel.withColumn("ret_1", daily_return("close", 0.2))
    past = F.try_divide(F.col("close"), prior("close", 5)) - 1.0
    deviation = rolling(F.stddev_samp, "ret_1", 20)
    return returns.select(
        F.concat_ws(":", SYMBOL, F.col(DATE).cast("string")).alias("sample_id"),
        F.col(DATE).alias("label_date"),
        (F.floor(past * 20) / 21).alias("y_pred"),
        future_return("close", 5).alias("y_true"),
        (deviation * deviation).alias("pred_risk"),
    )
