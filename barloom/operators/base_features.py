"""Price, volume, volatility and risk-adjusted features of one symbol's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import FeatureConfig, FeatureSpec, numeric_specs
from barloom.functions.windows import clip, drop_helpers, prior, safe_div, with_rolling


def daily_return(price: str = "close", bound: float | None = None) -> Column:
    """price / previous price - 1, optionally clipped to +-bound."""
    change = F.try_divide(F.col(price), prior(price)) - 1.0
    return change if bound is None else clip(change, bound)


def downside(column: str = "ret_1") -> Column:
    """Losses only: gains and missing returns count as 0."""
    return F.when(F.col(column) < 0, F.col(column)).otherwise(F.lit(0.0))


def return_columns(cfg: FeatureConfig) -> dict[str, Column]:
    return {
        "ret_1": daily_return("close", cfg.clip_return),
        "log_ret_1": F.log(F.try_divide(F.col("close"), prior("close"))),
        "oc_ratio": safe_div(F.col("close") - F.col("open"), "open"),
        "hl_ratio": safe_div(F.col("high") - F.col("low"), "close"),
        "co_gap": safe_div(F.col("open") - F.col("pre_close"), "pre_close"),
    }


def price_columns(w: int) -> dict[str, Column]:
    low, high = F.col(f"__low_{w}"), F.col(f"__high_{w}")
    return {
        f"ret_{w}": F.try_divide(F.col("close"), prior("close", w)) - 1.0,
        f"ma_ratio_{w}": safe_div("close", f"__close_mean_{w}") - 1.0,
        f"price_pos_{w}": safe_div(F.col("close") - low, high - low),
    }


def volatility_columns(w: int) -> dict[str, Column]:
    return {
        f"volatility_{w}": F.col(f"__ret_std_{w}"),
        f"volume_ma_ratio_{w}": safe_div("volume", f"__volume_mean_{w}") - 1.0,
    }


def risk_columns(w: int) -> dict[str, Column]:
    return {
        f"sharpe_like_{w}": safe_div(f"__ret_mean_{w}", f"__ret_std_{w}"),
        f"sortino_like_{w}": safe_div(f"__ret_mean_{w}", f"__loss_std_{w}"),
        f"drawdown_{w}": safe_div("close", f"__close_max_{w}") - 1.0,
    }


def add_base_features(df: DataFrame, cfg: FeatureConfig) -> tuple[DataFrame, list[FeatureSpec]]:
    """All base features. Every window shares one exchange and one sort on (symbol, date)."""
    if "pre_close" not in df.columns:
        raise ValueError("the panel lacks pre_close")
    first = return_columns(cfg)
    frames: dict = {}
    later: dict[str, Column] = {}
    for w in cfg.price_windows:
        frames |= {
            f"__close_mean_{w}": (F.avg, "close", w),
            f"__low_{w}": (F.min, "low", w),
            f"__high_{w}": (F.max, "high", w),
        }
        later |= price_columns(w)
    for w in cfg.vol_windows:
        frames |= {
            f"__ret_std_{w}": (F.stddev_samp, "ret_1", w),
            f"__volume_mean_{w}": (F.avg, "volume", w),
        }
        later |= volatility_columns(w)
        if cfg.add_risk_adjusted_features:
            frames |= {
                f"__ret_mean_{w}": (F.avg, "ret_1", w),
                f"__loss_std_{w}": (F.stddev_samp, "__loss", w),
                f"__close_max_{w}": (F.max, "close", w),
            }
            later |= risk_columns(w)
    out = df.withColumns(first).withColumn("__loss", downside())
    out = with_rolling(out, frames).withColumns(later)
    return drop_helpers(out), numeric_specs([*first, *later])
