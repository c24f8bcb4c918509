"""Calendar encodings of the bar date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, FeatureSpec
from barloom.functions.windows import cyclic, prior

CYCLIC_COLUMNS = tuple(f"{part}_{fn}" for part in ("dow", "month", "doy", "dom") for fn in ("sin", "cos"))
FLAG_COLUMNS = tuple(f"is_{p}_{edge}" for p in ("month", "quarter", "year") for edge in ("start", "end"))
CALENDAR_COLUMNS = (*CYCLIC_COLUMNS, *FLAG_COLUMNS, "gap_days")


def _pairs(parts: dict[str, tuple[Column, float]]) -> dict[str, Column]:
    out = {}
    for name, (position, period) in parts.items():
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(position, period)
    return out


def calendar_columns(date: str = DATE) -> dict[str, Column]:
    d = F.col(date)
    next_day = F.date_add(d, 1)
    flags = {}
    for unit in ("month", "quarter", "year"):
        flags[f"is_{unit}_start"] = d == F.trunc(d, unit)
        flags[f"is_{unit}_end"] = next_day == F.trunc(next_day, unit)
    gap = F.coalesce(F.datediff(d, prior(date)), F.lit(1))
    return {
        **_pairs(
            {
                "dow": (F.weekday(d), 5),
                "month": (F.month(d) - 1, 12),
                "doy": (F.dayofyear(d), 365),
                "dom": (F.dayofmonth(d) - 1, 31),
            }
        ),
        **{name: flag.cast("byte") for name, flag in flags.items()},
        "gap_days": F.greatest(gap, F.lit(1)).cast("int"),
    }


def add_calendar_features(df: DataFrame) -> tuple[DataFrame, list[FeatureSpec]]:
    specs = [FeatureSpec(c, "cyclic", "float32") for c in CYCLIC_COLUMNS]
    specs += [FeatureSpec(c, "boolean", "int8") for c in FLAG_COLUMNS]
    specs.append(FeatureSpec("gap_days", "other", "int16"))
    return df.withColumns(calendar_columns()), specs


def add_weekly_calendar(df: DataFrame, date: str = DATE) -> DataFrame:
    """The other published encoding: 7-day week, month 1..12, 365.25-day year."""
    d = F.col(date)
    return df.withColumns(
        _pairs(
            {
                "dow": (F.weekday(d), 7),
                "month": (F.month(d), 12),
                "doy": (F.dayofyear(d), 365.25),
            }
        )
    )
