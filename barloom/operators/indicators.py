"""Technical indicators. Recursive ones come from ``recursions``; the rest are native windows.

Convention: null until a full window; a zero denominator gives null unless stated otherwise.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, SYMBOL, FeatureSpec, numeric_specs
from barloom.functions.windows import (
    drop_helpers,
    prior,
    rolling,
    running,
    safe_div,
    with_rolling,
)
from barloom.operators.recursions import (
    COLUMNS,
    EXTENDED_GROUPS,
    TA_GROUPS,
    KernelErrors,
    add_recursive,
)

TA_COLUMNS = (
    "rsi_14", "roc_10", "willr_14", "stoch_k_14", "stoch_d_14",
    "macd", "macd_signal", "macd_hist", "cci_20", "adx_14", "atr_14",
    "bb_h", "bb_l", "bb_m", "bb_width", "bb_pos", "obv", "cmf_20", "mfi_14",
)
EXTENDED_COLUMNS = (*COLUMNS["supertrend"], *COLUMNS["kdj"], "er_10", "natr_14")


def rate_of_change(n: int) -> Column:
    past = prior("close", n)
    return F.try_divide(F.lit(100.0) * (F.col("close") - past), past)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def mean_deviation(column: str, mean: str, n: int) -> Column:
    """Mean distance of the last n values from the current window mean.

    The mean sits inside the sum, which no window aggregate can express, so the sum is written over
    lags; a missing lag makes it null, which is the full-window rule.
    """
    steps = [f"lag({column}, {i}) over (partition by {SYMBOL} order by {DATE})" for i in range(1, n)]
    return F.expr(" + ".join(f"abs({v} - {mean})" for v in [column, *steps])) / n


def on_balance_volume() -> Column:
    falling = F.col("close") < prior("close")
    return F.when(falling, -F.col("volume")).otherwise(F.col("volume"))


def chaikin_flow() -> Column:
    spread = F.col("high") - F.col("low")
    position = (F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))
    return F.coalesce(F.try_divide(position, spread) * F.col("volume"), F.lit(0.0))


def signed_money_flow(price: str) -> Column:
    before = prior(price)
    sign = F.when(F.col(price) > before, 1.0).when(F.col(price) < before, -1.0).otherwise(0.0)
    return sign * F.col(price) * F.col("volume")


def money_flow_index(gained: str, lost: str) -> Column:
    ratio = F.try_divide(F.col(gained), F.col(lost))
    return F.when((F.col(lost) == 0) & (F.col(gained) > 0), 100.0).otherwise(
        100.0 - F.lit(100.0) / (1.0 + ratio)
    )


def window_ta(df: DataFrame) -> DataFrame:
    """The indicators that need no recursion, as stacked windows over one sort."""
    out = df.withColumns(
        {
            "__price": typical_price(),
            "__signed_volume": on_balance_volume(),
            "__flow_volume": chaikin_flow(),
        }
    ).withColumn("__flow", signed_money_flow("__price"))
    out = out.withColumns(
        {
            "__gain": F.greatest(F.col("__flow"), F.col("__flow") * 0.0),
            "__loss": F.greatest(-F.col("__flow"), F.col("__flow") * 0.0),
        }
    )
    out = with_rolling(
        out,
        {
            "__top": (F.max, "high", 14),
            "__bottom": (F.min, "low", 14),
            "__price_mean": (F.avg, "__price", 20),
            "bb_m": (F.avg, "close", 20),
            "__band": (F.stddev_pop, "close", 20),
            "__flow_sum": (F.sum, "__flow_volume", 20),
            "__volume_sum": (F.sum, "volume", 20),
            "__gained": (F.sum, "__gain", 14),
            "__lost": (F.sum, "__loss", 14),
        },
    )
    close, top, bottom = F.col("close"), F.col("__top"), F.col("__bottom")
    out = out.withColumns(
        {
            "roc_10": rate_of_change(10),
            "willr_14": F.try_divide(F.lit(-100.0) * (top - close), top - bottom),
            "stoch_k_14": F.try_divide(F.lit(100.0) * (close - bottom), top - bottom),
            "__mean_deviation": mean_deviation("__price", "__price_mean", 20),
            "bb_h": F.col("bb_m") + 2.0 * F.col("__band"),
            "bb_l": F.col("bb_m") - 2.0 * F.col("__band"),
            "obv": F.sum("__signed_volume").over(running()),
            "cmf_20": F.try_divide(F.col("__flow_sum"), F.col("__volume_sum")),
            "mfi_14": money_flow_index("__gained", "__lost"),
        }
    )
    span = F.col("bb_h") - F.col("bb_l")
    out = out.withColumns(
        {
            "stoch_d_14": rolling(F.avg, "stoch_k_14", 3),
            "cci_20": F.try_divide(
                F.col("__price") - F.col("__price_mean"), F.lit(0.015) * F.col("__mean_deviation")
            ),
            "bb_width": safe_div(span, "bb_m"),
            "bb_pos": safe_div(close - F.col("bb_l"), span),
        }
    )
    return drop_helpers(out)


def efficiency_ratio(df: DataFrame) -> DataFrame:
    """Net move over path travelled, over 10 rows."""
    out = df.withColumn("__step", F.abs(F.col("close") - prior("close")))
    ratio = F.try_divide(F.abs(F.col("close") - prior("close", 10)), rolling(F.sum, "__step", 10))
    return drop_helpers(out.withColumn("er_10", ratio))


def relative_range(df: DataFrame) -> DataFrame:
    """ATR in percent of price."""
    return df.withColumn("natr_14", F.try_divide(F.lit(100.0) * F.col("atr_14"), F.col("close")))


def window_extended(df: DataFrame) -> DataFrame:
    """Efficiency ratio over 10 rows (net move over path travelled) and ATR in percent of price."""
    return relative_range(efficiency_ratio(df))


def numeric_prices(df: DataFrame) -> DataFrame:
    """Prices that come as text, as numbers; text that is none is null."""
    texts = [c for c in ("high", "low", "close") if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.col(c).try_cast("double") for c in texts}) if texts else df


def add_indicators(
    df: DataFrame, ta: bool = True, extended: bool = True, errors: KernelErrors | None = None
) -> tuple[DataFrame, list[FeatureSpec]]:
    """Both indicator families with a single pass over the recursions.

    Extended indicators need high, low and close; without them they are skipped with a warning. With ``errors``
    a recursion that raises for a symbol fails alone.
    """
    usable = {"high", "low", "close"} <= set(df.columns)
    if extended and not usable:
        warnings.warn("extended indicators skipped: high, low, close required", RuntimeWarning)
        extended = False
    if not (ta or extended):
        return df, []
    out, names = numeric_prices(df) if extended else df, []
    # windows first: no window needs a recursion, so all share one exchange on the symbol
    if ta:
        out = window_ta(out)
        names += TA_COLUMNS
    if extended:
        out = efficiency_ratio(out)
        names += EXTENDED_COLUMNS
    groups = [*(TA_GROUPS if ta else ("atr",)), *(EXTENDED_GROUPS if extended else ())]
    out = add_recursive(out, groups, errors=errors)
    if extended:
        out = relative_range(out)
    return (out if ta else out.drop("atr_14")), numeric_specs(names)


def number_suffix(value: float) -> str:
    """3.0 -> '3', 2.5 -> '2p5'."""
    return f"{float(value):g}".replace(".", "p")


# Default batch of the indicator table. Fixed values.
INDICATOR_CONFIG = (
    {"kind": "macd", "fast": 12, "slow": 26, "signal": 9},
    {"kind": "rsi", "length": 14},
)


def indicator_batch(df: DataFrame, config: Sequence[dict] = INDICATOR_CONFIG) -> DataFrame:
    """Append a configured list of indicators to every symbol of the panel."""
    required = [SYMBOL, DATE, "open", "high", "low", "close", "volume"]
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the panel lacks {missing}")
    passes: list[dict] = []
    for entry in config:
        plan = next((p for p in passes if entry["kind"] not in p), None)
        if plan is None:
            passes.append(plan := {})
        if entry["kind"] == "macd":
            args = {k: entry[k] for k in ("fast", "slow", "signal")}
            tag = "_".join(number_suffix(v) for v in args.values())
            plan["macd"] = (args, (f"MACD_{tag}", f"MACDs_{tag}", f"MACDh_{tag}"))
        elif entry["kind"] == "rsi":
            plan["rsi"] = ({"n": entry["length"]}, (f"RSI_{number_suffix(entry['length'])}",))
        else:
            raise ValueError(f"Unknown indicator kind: {entry['kind']!r}")
    for plan in passes:  # a kind once in each
        df = add_recursive(df, list(plan), plan)
    return df


def indicator_table(df: DataFrame) -> DataFrame:
    """(symbol, date, macd, macds, macdh, rsi) as a table of its own."""
    narrow = df.select(SYMBOL, DATE, "high", "low", "close")
    out = add_recursive(narrow, ["macd", "rsi"])
    return out.select(
        SYMBOL,
        DATE,
        "macd",
        F.col("macd_signal").alias("macds"),
        F.col("macd_hist").alias("macdh"),
        F.col("rsi_14").alias("rsi"),
    )


def with_indicator_table(df: DataFrame) -> DataFrame:
    return df.join(indicator_table(df), [SYMBOL, DATE], "left")
