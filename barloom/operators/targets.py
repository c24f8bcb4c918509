"""Future return and future risk labels, counted in rows of the symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL
from barloom.functions.windows import leading, per_symbol, safe_div
from barloom.operators.base_features import daily_return


def future_return(price: str, h: int) -> Column:
    return F.try_divide(F.lead(price, h).over(per_symbol()), F.col(price)) - 1.0


def future_volatility(h: int) -> Column:
    """Population deviation of the next h daily returns; null unless all h are present."""
    frame = leading(h)
    return F.when(F.count("ret_1").over(frame) == h, F.stddev_pop("ret_1").over(frame))


def add_targets(
    df: DataFrame,
    horizons: Sequence[int] = (1, 5, 10),
    price_col: str = "close",
    add_risk_target: bool = True,
    add_risk_adjusted_return: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Append the labels; returns the frame and their names in order ret, risk, ra per horizon."""
    missing = sorted({SYMBOL, DATE, price_col} - set(df.columns))
    if missing:
        raise ValueError(f"the panel lacks {missing}")
    out = df if "ret_1" in df.columns else df.withColumn("ret_1", daily_return(price_col))
    adjust = add_risk_adjusted_return and "volatility_20" in df.columns
    labels: dict[str, Column] = {}
    for h in horizons:
        labels[f"y_ret_{h}"] = future_return(price_col, h)
        if add_risk_target:
            labels[f"y_risk_vol_{h}"] = future_volatility(h).cast("float")
        if adjust:
            ratio = safe_div(future_return(price_col, h), "volatility_20")
            labels[f"y_ret_{h}_ra"] = ratio.cast("float")
    return out.withColumns(labels), list(labels)
