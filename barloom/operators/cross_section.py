"""Per-date cross-section: z-score and percentile rank inside the universe.

Both need the members' values only, which go to their date's task once. One Arrow group gives a date's moments and the
ranks of all columns, as long as the date has no more members than ``WIDEST``; what is stored are ranks, as whole numbers.
Where a date is wider, the members' values are stored and such dates are ranked in long form, spread over tasks (``ranking``).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, DEFAULT_UNIVERSE, SYMBOL, FeatureSpec
from barloom.functions.staging import stored
from barloom.functions.windows import standardise
from barloom.operators.ranking import join_on, with_average_rank

# ship these small functions inside the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Members of a date that one task ranks: with 18 columns about 40 MB.
WIDEST = 1 << 18
#: Bits of a rank on its way to its symbol: twice its place in a date of at most ``WIDEST`` members, with room to spare.
BITS = 21

# Columns that get a cross-section rank and z-score when present.
CANDIDATES = (
    "ret_1", "ret_5", "ret_10", "ret_20",
    "volatility_5", "volatility_10", "volatility_20",
    "rsi_14", "macd_hist", "cci_20", "adx_14", "atr_14", "bb_width", "cmf_20", "mfi_14",
    "sharpe_like_20", "sortino_like_20", "drawdown_20",
)


def masked(column: str, universe: str) -> Column:
    return F.when(F.col(universe), F.col(column))


def moments_by_date(df: DataFrame, columns: Sequence[str], universe: str = DEFAULT_UNIVERSE, date: str = DATE) -> DataFrame:
    """Mean and deviation of the members' values, one row per date."""
    return df.groupBy(date).agg(
        *[
            fn(masked(c, universe)).alias(f"__{c}_{tag}")
            for c in columns
            for tag, fn in (("mean", F.avg), ("std", F.stddev_samp))
        ]
    )


def with_zscores(
    df: DataFrame, moments: DataFrame, columns: Sequence[str], universe: str = DEFAULT_UNIVERSE, date: str = DATE
) -> DataFrame:
    """Add ``{c}_cs_z`` from the moments of the dates."""
    scores = {
        f"{c}_cs_z": standardise(masked(c, universe), F.col(f"__{c}_mean"), F.col(f"__{c}_std"))
        for c in columns
    }
    helpers = [c for c in moments.columns if c != date]
    # one row per calendar day
    return join_on(df, F.broadcast(moments), [date], "left").withColumns(scores).drop(*helpers)


def zscore_by_date(
    df: DataFrame, columns: Sequence[str], universe: str = DEFAULT_UNIVERSE, date: str = DATE
) -> DataFrame:
    """Add ``{c}_cs_z``: members only, moments from one aggregate with one row per date."""
    return with_zscores(df, moments_by_date(df, columns, universe, date), columns, universe, date)


def _average_ranks(x: np.ndarray, known: np.ndarray, pct: bool) -> np.ndarray:
    """1-based ranks with ties averaged, NaN above all; NaN where the value is not known."""
    out, values = np.full(len(x), np.nan), x[known]
    if not len(values):
        return out
    order = np.argsort(values)
    ordered = values[order]
    tied = (ordered[1:] == ordered[:-1]) | (np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
    starts = np.flatnonzero(np.append(True, ~tied))
    sizes = np.diff(np.append(starts, len(ordered)))
    ranks = np.empty(len(values))
    ranks[order] = np.repeat(starts + (sizes + 1) / 2.0, sizes)
    out[known] = ranks / len(values) if pct else ranks
    return out


def _one_per_symbol(symbols: pa.ChunkedArray, found: list[np.ndarray]) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """The first row of every symbol, None if no symbol stands twice, and its highest ranks."""
    codes = symbols.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
    _, firsts, places = np.unique(codes, return_index=True, return_inverse=True)
    if len(firsts) == len(codes):
        return None, found
    highest = []
    for ranks in found:
        top = np.full(len(firsts), np.nan)
        np.fmax.at(top, places, ranks)
        highest.append(top)
    return firsts, highest


def _moments(x: np.ndarray) -> tuple[float, float, float]:
    """Count, mean and sample deviation, NaN where there is none. Distances from one of the values are added up, so equal
    values have exactly zero deviation."""
    if not len(x):
        return 0.0, np.nan, np.nan
    with np.errstate(invalid="ignore"):
        near = x[0] if np.isfinite(x[0]) else 0.0
        apart = x - near
        mean = apart.mean()
        apart -= mean
        return float(len(x)), near + mean, np.sqrt(np.dot(apart, apart) / (len(x) - 1)) if len(x) > 1 else np.nan


def wide_dates(df: DataFrame, universe: str = DEFAULT_UNIVERSE, date: str = DATE) -> list:
    """Dates with more than ``WIDEST`` members, so bounded by the calendar; as a rule there is none."""
    return [row[0] for row in df.where(universe).groupBy(date).count().where(F.col("count") > WIDEST).select(date).collect()]


def rank_by_date(
    df: DataFrame,
    columns: Sequence[str],
    universe: str = DEFAULT_UNIVERSE,
    date: str = DATE,
    pct: bool = True,
) -> DataFrame:
    """(symbol, date, ``{c}_cs_rank``) of the members; ranks are a share of the date's values or plain.

    ``df`` is read twice, so it should be stored. A member that stands twice in a date has one row with its highest ranks.
    """
    columns, names = list(columns), [f"{c}_cs_rank" for c in columns]
    members = df.where(universe).select(SYMBOL, date, *[F.col(c).cast("double") for c in columns])
    schema = T.StructType([*members.schema.fields[:2], *[T.StructField(c, T.DoubleType()) for c in names]])
    wide = wide_dates(df, universe, date)

    def one_date(table: pa.Table) -> pa.Table:
        found = []
        for c in columns:
            column = table.column(c)
            known = column.is_valid().to_numpy()
            found.append(_average_ranks(column.to_numpy(), known, pct))
        firsts, found = _one_per_symbol(table.column(SYMBOL), found)
        if firsts is not None:
            table = table.take(pa.array(firsts))
        arrays = [table.column(SYMBOL), table.column(date), *[pa.array(x, from_pandas=True) for x in found]]
        return pa.Table.from_arrays(arrays, names=schema.names)

    inside = reduce(or_, [F.col(date).eqNullSafe(F.lit(d)) for d in wide]) if wide else F.lit(False)
    ranked = members.where(~inside).groupBy(date).applyInArrow(one_date, schema)
    if not wide:
        return ranked
    tall = members.where(inside).unpivot([SYMBOL, date], columns, "__column", "__x")
    spread = with_average_rank(tall.where(F.col("__x").isNotNull()), [date, "__column"], "__x", "__rank")
    rank = F.col("__rank") / F.col("__rank_of") if pct else F.col("__rank")
    return ranked.unionByName(
        spread.groupBy(SYMBOL, date).agg(*[F.max(F.when(F.col("__column") == c, rank)).alias(f"{c}_cs_rank") for c in columns])
    )


def cross_tables(
    df: DataFrame, columns: Sequence[str], universe: str = DEFAULT_UNIVERSE, date: str = DATE, wide: bool | None = None, tasks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Ranks, one row per member and date, and moments, one row per date.

    ``wide`` tells whether some date has more than ``WIDEST`` members, where the caller knows; else ``df`` is read for it.
    With ``tasks`` the ranks are spread over so many by symbol.
    """
    if universe not in df.columns:
        raise ValueError(f"The panel has no universe column {universe!r}")
    if bool(wide_dates(df, universe, date)) if wide is None else wide:
        members = stored(df.where(universe).select(SYMBOL, date, universe, *columns))
        ranks = rank_by_date(members, columns, universe, date)
        return ranks.repartition(tasks, SYMBOL) if tasks else ranks, moments_by_date(members, columns, universe, date)
    return _tables_of_dates(df.where(universe).select(SYMBOL, date, *columns), columns, date, tasks)


def _spread_places(places: DataFrame, columns: Sequence[str], date: str, tasks: int) -> DataFrame:
    """The same rows, exchanged by symbol. Places are small whole numbers, so three of them travel as one long, 0 for none."""
    threes = [list(columns[i : i + 3]) for i in range(0, len(columns), 3)]
    place = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    packed = [reduce(lambda x, c: F.shiftleft(x, BITS).bitwiseOR(place(c)), three[1:], place(three[0])) for three in threes]
    sent = places.select(SYMBOL, date, *[x.alias(f"__places_{i}") for i, x in enumerate(packed)]).repartition(tasks, SYMBOL)
    unpacked = [
        F.nullif(F.shiftright(F.col(f"__places_{i}"), BITS * (len(three) - 1 - k)).bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(0)).cast("int").alias(c)
        for i, three in enumerate(threes)
        for k, c in enumerate(three)
    ]
    return sent.select(SYMBOL, date, *unpacked)


def _tables_of_dates(members: DataFrame, columns: Sequence[str], date: str, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables from one Arrow group for each date. A rank is stored as twice its place, which is a whole number, and a
    date's counts, means and deviations beside its first member."""
    columns = list(columns)
    values = members.select(SYMBOL, date, *[F.col(c).cast("double") for c in columns])
    places = [T.StructField(c, T.IntegerType()) for c in columns]
    schema = T.StructType([*values.schema.fields[:2], *places, T.StructField("__of_date", T.ArrayType(T.DoubleType()))])

    def one_date(table: pa.Table) -> pa.Table:
        found, figures = [], []
        for c in columns:
            column = table.column(c)
            known, x = column.is_valid().to_numpy(), column.to_numpy()
            found.append(_average_ranks(x, known, False))
            figures += [None if np.isnan(v) and not known.any() else float(v) for v in _moments(x[known])]
            if known.sum() == 1:
                figures[-1] = None
        firsts, found = _one_per_symbol(table.column(SYMBOL), found)
        if firsts is not None:
            table = table.take(pa.array(firsts))
        of_date = pa.array([figures, *[None] * (table.num_rows - 1)], pa.list_(pa.float64()))
        twice = [pa.array(2 * x, from_pandas=True).cast(pa.int32()) for x in found]
        return pa.Table.from_arrays([table.column(SYMBOL), table.column(date), *twice, of_date], names=schema.names)

    both = stored(values.groupBy(date).applyInArrow(one_date, schema))
    figure = lambda k: F.col("__of_date")[k]
    of_dates = both.where(F.col("__of_date").isNotNull())
    counts = of_dates.select(date, *[figure(3 * k).alias(f"__{c}_count") for k, c in enumerate(columns)])
    rows = both.drop("__of_date")
    # one row per calendar day
    shares = join_on(_spread_places(rows, columns, date, tasks) if tasks else rows, F.broadcast(counts), [date])
    ranks = shares.select(SYMBOL, date, *[(F.col(c) / F.lit(2.0) / F.col(f"__{c}_count")).alias(f"{c}_cs_rank") for c in columns])
    named = [figure(3 * k + i).alias(f"__{c}_{tag}") for k, c in enumerate(columns) for i, tag in ((1, "mean"), (2, "std"))]
    return ranks, of_dates.select(date, *named)


def cross_section(
    df: DataFrame, columns: Sequence[str], universe: str = DEFAULT_UNIVERSE, date: str = DATE
) -> DataFrame:
    """Append ``{c}_cs_rank`` and ``{c}_cs_z`` for every column. (symbol, date) is unique.

    ``df`` is computed twice, for the members' ranks and for the result; nothing but those ranks is stored.
    """
    if universe not in df.columns:
        raise ValueError(f"The panel has no universe column {universe!r}")
    if not columns:
        return df
    names = [f"{c}_cs_{kind}" for c in columns for kind in ("rank", "z")]
    table = df.drop(*names)
    ranks, moments = cross_tables(table, columns, universe, date)
    scored = with_zscores(join_on(table, ranks, [SYMBOL, date], "left"), moments, columns, universe, date)
    return scored.select(*[c for c in df.columns if c not in names], *names)


def candidates(df: DataFrame) -> list[str]:
    return [c for c in CANDIDATES if c in df.columns]


def cross_specs(columns: Sequence[str]) -> list[FeatureSpec]:
    return [FeatureSpec(f"{c}_cs_{kind}", "cross_sectional", "float32") for c in columns for kind in ("rank", "z")]


def add_cross_section(
    df: DataFrame, universe: str = DEFAULT_UNIVERSE
) -> tuple[DataFrame, list[FeatureSpec]]:
    present = candidates(df)
    return cross_section(df, present, universe), cross_specs(present)
