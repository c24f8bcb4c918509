"""Small panels with hand-checkable results (FIXTURES.md)."""

import pandas as pd

BAR_SCHEMA = (
    "ts_code string, date date, open double, high double, low double, close double, "
    "pre_close double, volume long, in_csi300 boolean"
)


def _panel(symbols, dates, base_step, slope, tilt, wave, shift, high_pad, low_pad, volume):
    rows = []
    for s, code in enumerate(symbols):
        base = 10.0 + base_step * s
        previous = base
        for i, day in enumerate(dates):
            close = base + slope * i + tilt * s + wave(i)
            opened = previous + shift(i)
            rows.append(
                (
                    code, day.date(), opened, max(opened, close) + high_pad(s),
                    min(opened, close) - low_pad(s), close, previous, volume(s, i), True,
                )
            )
            previous = close
    return rows


def three_years(spark):
    days = [d for y in ("2022-01-03", "2023-01-02", "2024-01-02") for d in pd.bdate_range(y, periods=12)]
    rows = _panel(
        ["000001.SZ", "000002.SZ"], days, 2.0, 0.15, 0.05, lambda i: 0.0,
        lambda i: 0.01 * ((i % 3) - 1), lambda s: 0.1, lambda s: 0.1,
        lambda s, i: 1_000_000 + 10_000 * s + 1_000 * i,
    )
    return spark.createDataFrame(rows, BAR_SCHEMA), days


def three_symbols(spark):
    days = list(pd.bdate_range("2023-01-02", periods=15))
    rows = _panel(
        ["000001.SZ", "000002.SZ", "000004.SZ"], days, 3.0, 0.12, 0.03, lambda i: 0.05 * (i % 3),
        lambda i: 0.02 * ((i % 2) - 0.5), lambda s: 0.08 + 0.01 * s, lambda s: 0.07 + 0.01 * s,
        lambda s, i: 1_000_000 + 10_000 * s + 2_500 * i,
    )
    return spark.createDataFrame(rows, BAR_SCHEMA), days


def calendar(spark, days):
    rows = [("SSE", d.date() if hasattr(d, "date") else d, 1) for d in days]
    return spark.createDataFrame(rows, "exchange string, cal_date date, is_open int")
