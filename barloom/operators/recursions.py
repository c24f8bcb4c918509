"""Indicators whose value depends on their own previous value.

Spark has no native operator for an ordered recursion. Spark partitions by symbol and sorts; an Arrow function
walks over the rows in blocks of whole symbols and lays those of similar length side by side, so a kernel takes a
step for many symbols at once. It sees keys and prices only; all other columns stay in Spark. A symbol has at most
one row per calendar day, hence a block is small whatever the size of the panel.

A kernel that raises for a symbol ends the job, unless a ``KernelErrors`` is given: then its columns are null for
that symbol and the failure is counted on the side.
"""

from __future__ import annotations

import sys
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, SYMBOL
from barloom.functions.windows import per_symbol

# ship these small functions inside the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = {
    "rsi": ("rsi_14",),
    "macd": ("macd", "macd_signal", "macd_hist"),
    "adx": ("adx_14",),
    "atr": ("atr_14",),
    "supertrend": tuple(f"supertrend_10_3_{part}" for part in ("line", "dir", "long", "short")),
    "kdj": tuple(f"kdj_9_3_{part}" for part in "kdj"),
}
TA_GROUPS = ("rsi", "macd", "adx", "atr")
EXTENDED_GROUPS = ("supertrend", "kdj")
#: Rows of a block; the last symbol of a block waits for the next one.
BLOCK = 1 << 15

# Kernels take one symbol as Series or many as the columns of DataFrames, missing values after their last rows.


def _smooth(x: pd.Series, alpha: float, warm_up: int) -> pd.Series:
    return x.ewm(alpha=alpha, adjust=False, ignore_na=True, min_periods=warm_up).mean()


def _ema(x: pd.Series, n: int) -> pd.Series:
    return _smooth(x, 2.0 / (n + 1), n)


def _wilder(x: pd.Series, n: int) -> pd.Series:
    return _smooth(x, 1.0 / n, n)


def _wilder_from_mean(x: pd.Series, n: int) -> pd.Series:
    """Wilder smoothing whose first value is the plain mean of the first n inputs."""
    values = x.to_numpy()
    known = ~np.isnan(values)
    seen = np.cumsum(known, axis=0)
    seed = np.where(known & (seen <= n), values, 0.0).sum(axis=0) / n
    seeded = x.where(seen > n)
    seeded[known & (seen == n)] = 0.0
    return _smooth(seeded + np.where(known & (seen == n), seed, 0.0), 1.0 / n, 1)


def _true_range(high, low, close) -> pd.Series:
    prev = close.shift(1)
    return np.fmax(np.fmax(high - low, (high - prev).abs()), (low - prev).abs())


def _rsi(high, low, close, n: int = 14):
    change = close.diff()
    gain = _wilder(change.clip(lower=0.0).fillna(0.0), n)
    loss = _wilder((-change).clip(lower=0.0).fillna(0.0), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 100.0 - 100.0 / (1.0 + gain / loss)
    return (value.where(loss != 0, 100.0).where(loss.notna()),)


def _macd(high, low, close, fast: int = 12, slow: int = 26, signal: int = 9):
    line = _ema(close, fast) - _ema(close, slow)
    smoothed = _ema(line, signal)
    return line, smoothed, line - smoothed


def _atr(high, low, close, n: int = 14):
    return (_wilder_from_mean(_true_range(high, low, close), n),)


def _adx(high, low, close, n: int = 14):
    # the first row has no previous bar, so it contributes neither range nor movement
    up, down = high.diff(), -low.diff()
    has_prev = close.shift(1).notna()
    plus = up.where((up > down) & (up > 0), 0.0).where(has_prev)
    minus = down.where((down > up) & (down > 0), 0.0).where(has_prev)
    tr = _wilder(_true_range(high, low, close).where(has_prev), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        di_plus, di_minus = 100.0 * _wilder(plus, n) / tr, 100.0 * _wilder(minus, n) / tr
        dx = 100.0 * (di_plus - di_minus).abs() / (di_plus + di_minus)
    return (_wilder_from_mean(dx.replace([np.inf, -np.inf], np.nan), n),)


def _supertrend(high, low, close, n: int = 10, width: float = 3.0):
    band = width * _wilder_from_mean(_true_range(high, low, close), n)
    mid = (high + low) / 2.0
    uppers, lowers, closes, active = (x.to_numpy(copy=True) for x in (mid + band, mid - band, close, band.notna()))
    direction = np.full(closes.shape, np.nan)
    upper, lower, trend = (np.full(closes.shape[1:], np.nan) for _ in range(3))
    for i in np.flatnonzero(active.reshape(len(active), -1).any(axis=1)):
        this_upper, this_lower, now = uppers[i], lowers[i], active[i]
        crossed = np.where(closes[i] > upper, 1.0, np.where(closes[i] < lower, -1.0, np.nan))
        crossed = np.where(np.isnan(trend), 1.0, crossed)
        ratchet = np.isnan(crossed)
        this_lower = np.where(ratchet & (trend > 0) & (lower > this_lower), lower, this_lower)
        this_upper = np.where(ratchet & (trend < 0) & (upper < this_upper), upper, this_upper)
        trend = np.where(now, np.where(ratchet, trend, crossed), trend)
        upper, lower = np.where(now, this_upper, upper), np.where(now, this_lower, lower)
        uppers[i], lowers[i] = np.where(now, this_upper, uppers[i]), np.where(now, this_lower, lowers[i])
        direction[i] = np.where(now, trend, np.nan)
    like = lambda values: type(close)(values, index=close.index)
    trend_at = like(direction)
    long, short = like(lowers).where(trend_at > 0), like(uppers).where(trend_at < 0)
    return long.fillna(short), trend_at, long, short


def _kdj(high, low, close, n: int = 9, signal: int = 3):
    bottom, top = low.rolling(n).min(), high.rolling(n).max()
    span = (top - bottom).where(lambda s: s != 0)
    k = _wilder(100.0 * (close - bottom) / span, signal)
    d = _wilder(k, signal)
    return k, d, 3.0 * k - 2.0 * d


_KERNELS = {
    "rsi": _rsi,
    "macd": _macd,
    "adx": _adx,
    "atr": _atr,
    "supertrend": _supertrend,
    "kdj": _kdj,
}


ERRORS = "__kernel_errors"


class KernelErrors:
    """Failures of indicator kernels, one row per kernel: name, symbols it failed for, message of the first symbol.

    The figures are observed metrics of the frame's first action, so nothing is computed twice and a task
    that runs again is not counted twice.
    """

    def __init__(self) -> None:
        self._watched: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, groups: Sequence[str]) -> DataFrame:
        """``df`` without its error column, which is observed on the way."""
        seen, error = Observation(), lambda g: F.col(ERRORS)[g]
        figures = [
            figure
            for g in groups
            for figure in (F.count(error(g)).alias(f"{g}_count"), F.min_by(error(g), F.when(error(g).isNotNull(), F.col(SYMBOL))).alias(f"{g}_message"))
        ]
        self._watched += [(g, seen) for g in groups]
        return df.observe(seen, *figures).drop(ERRORS)

    def rows(self) -> list[tuple[str, int, str]]:
        """Kernels that failed; waits for the frame's first action."""
        return [(g, seen.get[f"{g}_count"], seen.get[f"{g}_message"]) for g, seen in self._watched if seen.get[f"{g}_count"]]

    def warn(self) -> list[tuple[str, int, str]]:
        """The rows, with one warning for all of them."""
        found = self.rows()
        if found:
            told = "; ".join(f"{kernel} for {n} symbols ({message})" for kernel, n, message in found)
            warnings.warn(f"indicators left empty: {told}", RuntimeWarning, stacklevel=2)
        return found


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in runs of equal codes: number of the run, place in it, and the runs' lengths."""
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    sizes = np.diff(np.append(starts, len(codes)))
    return np.repeat(np.arange(len(starts)), sizes), np.arange(len(codes)) - np.repeat(starts, sizes), sizes


def _side_by_side(kernels: dict, plan: list, group: str, bars: list[np.ndarray], isolated: bool) -> tuple[list[np.ndarray], dict[int, str]]:
    """A kernel over symbols that are the columns of ``bars``, with the failures by column.

    Where it raises, each symbol is tried alone; unless failures are isolated, the first symbol's is raised.
    """
    keywords = {g: kwargs for g, kwargs, _ in plan}
    alone = lambda g, k: kernels[g](*[pd.Series(b[:, k]) for b in bars], **keywords[g])
    try:
        return [np.asarray(x) for x in kernels[group](*[pd.DataFrame(b) for b in bars], **keywords[group])], {}
    except Exception:
        symbols, failed = range(bars[0].shape[1]), {}
        if not isolated:
            for k in symbols:
                for g in keywords:
                    alone(g, k)
        found = [np.full(bars[0].shape, np.nan) for g, _, columns in plan if g == group for _ in columns]
        for k in symbols:
            try:
                for out, x in zip(found, alone(group, k)):
                    out[:, k] = x
            except Exception as error:
                failed[k] = f"{type(error).__name__}: {error}"
        return found, failed


def add_recursive(
    df: DataFrame, groups: Sequence[str], params: dict | None = None, errors: KernelErrors | None = None
) -> DataFrame:
    """Append the columns of the named indicator groups; same-named columns are replaced.

    ``params`` maps a group to ``(keyword arguments, output names)`` for other windows. With ``errors`` a group that
    raises for a symbol leaves nulls and is counted there.
    """
    plan = [(g, *(params or {}).get(g, ({}, COLUMNS[g]))) for g in groups]
    names = [c for _, _, columns in plan for c in columns]
    kept = df.drop(*[c for c in names if c in df.columns])
    added = [T.StructField(c, T.DoubleType()) for c in names]
    if errors is not None:
        added.append(T.StructField(ERRORS, T.StructType([T.StructField(g, T.StringType()) for g in groups])))
    isolated, kernels, block = errors is not None, dict(_KERNELS), BLOCK

    def symbols(rows: pa.Table, codes: np.ndarray) -> pa.StructArray:
        """The new columns for rows that hold whole symbols."""
        run, place, sizes = _places(codes)
        undated = rows.column(DATE).is_null().to_numpy()
        order = np.lexsort((undated, run)) if undated.any() else np.arange(len(run))  # a missing date comes last
        bars = [rows.column(c).cast(pa.float64()).to_numpy()[order] for c in ("high", "low", "close")]
        out = {c: np.full(len(run), np.nan) for c in names}
        told: dict[int, dict[str, str]] = {}
        lengths = np.frexp(sizes)[1]
        for length in np.unique(lengths):  # at most twice the rows of the block, whatever its symbols
            mine = np.flatnonzero(lengths == length)
            column = np.full(len(sizes), -1)
            column[mine] = np.arange(len(mine))
            at = np.flatnonzero(lengths[run] == length)
            cell = (place[at], column[run[at]])
            laid = [np.full((sizes[mine].max(), len(mine)), np.nan) for _ in bars]
            for wide, x in zip(laid, bars):
                wide[cell] = x[at]
            for group, _, columns in plan:
                found, failed = _side_by_side(kernels, plan, group, laid, isolated)
                for name, values in zip(columns, found):
                    out[name][order[at]] = values[cell]
                for k, message in failed.items():
                    told.setdefault(int(mine[k]), {})[group] = message
        arrays = [pa.array(out[c], from_pandas=True) for c in names]
        if isolated:
            firsts = {int(s): told[k] for k, s in enumerate(np.cumsum(sizes) - sizes) if k in told}
            kind = pa.struct([(g, pa.string()) for g in groups])
            arrays.append(pa.array([{g: firsts[i].get(g) for g in groups} if i in firsts else None for i in range(len(run))], kind) if firsts else pa.nulls(len(run), kind))
        return pa.StructArray.from_arrays(arrays, names=[f.name for f in added])

    def stream(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held, waiting = [], 0
        for batch in batches:
            held.append(pa.Table.from_struct_array(batch))
            waiting += len(batch)
            if waiting < block:
                continue
            rows = pa.concat_tables(held).combine_chunks()
            codes = rows.column(SYMBOL).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
            end = int(np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))[-1])
            if end:
                yield symbols(rows.slice(0, end), codes[:end])
            held, waiting = [rows.slice(end)], len(codes) - end
        if waiting:
            rows = pa.concat_tables(held).combine_chunks()
            yield symbols(rows, rows.column(SYMBOL).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy())

    # as it depends on the rows before, nothing may be moved past it
    found = F.arrow_udf(stream, T.StructType(added)).asNondeterministic()
    # the place is a window column, which asks for rows by symbol and date; rows that lie so are not exchanged again
    placed = kept.withColumn("__place", F.row_number().over(per_symbol()))
    inputs = F.struct(SYMBOL, DATE, "high", "low", "close", "__place")
    out = placed.withColumn("__found", found(inputs)).select(*kept.columns, "__found.*")
    return errors.watch(out, groups) if errors is not None else out
