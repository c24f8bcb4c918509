"""Trading calendars: one row per exchange and open day, so always small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import DATE


def open_days(calendar: DataFrame, exchange: str = "SSE") -> DataFrame:
    """(exchange, cal_date) of open days: nulls dropped, days unique. A plain date list is a table
    with only ``cal_date``."""
    if "cal_date" not in calendar.columns:
        raise ValueError("Trade calendar must contain 'cal_date'.")
    days = calendar.where("is_open = 1") if "is_open" in calendar.columns else calendar
    if "exchange" not in days.columns:
        days = days.withColumn("exchange", F.lit(exchange))
    return (
        days.select("exchange", F.to_date("cal_date").alias("cal_date"))
        .where("cal_date is not null")
        .distinct()
    )


def positions(days: DataFrame) -> DataFrame:
    """0-based position of each open day of an exchange."""
    order = Window.partitionBy("exchange").orderBy("cal_date")
    return days.withColumn("pos", F.row_number().over(order) - 1)


def panel_calendar(panel: DataFrame, calendar: DataFrame, exchange: str = "SSE") -> DataFrame:
    """Positions of the exchange's open days between the first and the last bar of the panel."""
    first, last = panel.agg(F.min(DATE), F.max(DATE)).first()
    days = open_days(calendar, exchange).where(F.col("exchange") == exchange)
    inside = days.where(F.col("cal_date").between(F.lit(first), F.lit(last)))
    return positions(inside.select("exchange", "cal_date"))
