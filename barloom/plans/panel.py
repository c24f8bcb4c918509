"""Raw panel -> features -> labels -> stored artifact."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.config import (
    DATE,
    PRICE_COLUMNS,
    SYMBOL,
    FeatureConfig,
    FeatureSpec,
    PanelBuildConfig,
    numeric_specs,
)
from barloom.functions.staging import read_by, read_json, release, write_by, write_json
from barloom.functions.windows import tasks_for
from barloom.operators.base_features import add_base_features
from barloom.operators.calendar_features import add_calendar_features
from barloom.operators.contract import assert_unique_keys, check_input, compact_types, unique_rows
from barloom.operators.cross_section import candidates, cross_specs, cross_tables, wide_dates, with_zscores
from barloom.operators.indicators import TA_COLUMNS, add_indicators, numeric_prices
from barloom.operators.ranking import join_on
from barloom.operators.recursions import KernelErrors
from barloom.operators.selection import annotated, specs_of, warn_of_bare_columns
from barloom.operators.targets import add_targets
from barloom.operators.zscores import add_rolling_zscores
from barloom.sources.tables import read_panel


def raw_specs() -> list[FeatureSpec]:
    ids = [FeatureSpec(SYMBOL, "id", "str"), FeatureSpec(DATE, "id", "datetime64[ns]")]
    return ids + numeric_specs(PRICE_COLUMNS)


def symbol_features(df: DataFrame, cfg: FeatureConfig) -> tuple[DataFrame, list[FeatureSpec]]:
    """Features that look at one symbol at a time; row count unchanged. Repeated (symbol, date) are refused."""
    out, specs = _windowed(assert_unique_keys(check_input(df)), cfg)
    return _normalised(out, cfg, raw_specs() + specs)


def _windowed(
    df: DataFrame, cfg: FeatureConfig, horizons: Sequence[int] = (), errors: KernelErrors | None = None
) -> tuple[DataFrame, list[FeatureSpec]]:
    """Everything before the z-scores. Indicators go last, as no window needs their recursions: all windows, the
    recursions and the z-scores after them then share one exchange and one sort on the symbol."""
    bars = numeric_prices(df) if cfg.add_extended_ta_features and {"high", "low", "close"} <= set(df.columns) else df
    out, specs = add_base_features(bars, cfg)
    if cfg.add_time_features:
        out, more = add_calendar_features(out)
        specs = specs + more
    if horizons:
        out, _ = add_targets(out, horizons)
    out, first = add_indicators(out, cfg.add_ta_features, cfg.add_extended_ta_features, errors)
    return out, first + specs


def _normalised(
    df: DataFrame, cfg: FeatureConfig, specs: list[FeatureSpec], crossed: Sequence[str] = (), moments: DataFrame | None = None
) -> tuple[DataFrame, list[FeatureSpec]]:
    """Adds ``{c}_z{w}`` for every numeric column, raw prices included, and notes all specs.

    ``crossed`` columns have their cross-section rank already; z-scores inside the date follow from the moments.
    """
    names = sorted(s.name for s in specs if s.kind == "numeric")
    scores = numeric_specs([f"{c}_z{w}" for c in names for w in cfg.zscore_windows])
    # the indicators leave the rows as they need them, by symbol and date
    out = add_rolling_zscores(df, names, cfg.zscore_windows, arranged=cfg.add_ta_features or cfg.add_extended_ta_features)
    if moments is not None:
        out = with_zscores(out, moments, crossed, cfg.universe_column)
    out = annotated(out, specs + scores)
    warn_of_bare_columns(out)
    return out, specs_of(out)


def _beside(df: DataFrame, ranks: DataFrame, tasks: int | None) -> DataFrame:
    """The bars with their ranks. Both go to the tasks by symbol alone, in the order that the windows after it need anyway;
    a key's bar then meets its ranks in a window, null keys included. Keys of the bars are unique.

    Without ``tasks`` both lie by symbol already and neither is exchanged; a key's ranks may come in several rows. The symbol
    has another name meanwhile, as a table's own column and that of a plain frame do not pass for the same one.
    """
    names, symbol = ranks.columns[2:], SYMBOL if tasks else "__symbol"
    sides = [t.withColumn("__bar", F.lit(bar)).withColumnRenamed(SYMBOL, symbol) for t, bar in ((df, True), (ranks, False))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True)
    same = Window.partitionBy(symbol, DATE)
    met = (both.repartition(tasks, SYMBOL) if tasks else both).withColumns({c: F.max(c).over(same) for c in names})
    return met.where("__bar").withColumnRenamed(symbol, SYMBOL).select(*df.columns, *names)


def _cross_of_stored(first: DataFrame, crossed: Sequence[str], universe: str, wide: bool, tasks: int) -> tuple[DataFrame, DataFrame]:
    """``cross_tables`` of bars that lie in ``tasks`` buckets by symbol; the ranks lie there too.

    Base features and indicators go to their dates one after the other, which halves what is on disk at once. No column is
    computed for both, as base features need no recursion and indicators no base feature.
    """
    parts = [part for part in ([c for c in crossed if c not in TA_COLUMNS], [c for c in crossed if c in TA_COLUMNS]) if part]
    tables = [cross_tables(first, part, universe, wide=wide, tasks=tasks) for part in parts]
    ranks = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [ranks for ranks, _ in tables])
    # one row per calendar day
    moments = reduce(lambda a, b: join_on(a, F.broadcast(b), [DATE], "left"), [moments for _, moments in tables])
    return ranks.select(SYMBOL, DATE, *[f"{c}_cs_rank" for c in crossed]), moments


def panel_features(
    df: DataFrame,
    cfg: FeatureConfig | None = None,
    horizons: Sequence[int] = (),
    errors: KernelErrors | None = None,
    spread: int | None = None,
) -> tuple[DataFrame, list[FeatureSpec]]:
    """All features of a panel and their specs; an empty panel gives an empty frame and no specs.

    With ``horizons`` the labels are computed too, on the symbol exchange that is there anyway.
    The features are computed twice. First the members' candidates alone, for ranks and moments by date; then the
    ranks meet the bars, which are narrow, and stay beside them, so no wide row is stored or exchanged.
    ``spread`` is the number of buckets by symbol in which ``df`` is stored; such bars are not exchanged, and of the members
    only ranks are stored.
    """
    cfg = cfg or FeatureConfig()
    df = check_input(df)
    rows = unique_rows(df)
    if not rows:
        return df, []
    if not cfg.cross_sectional_rank:
        out, specs = _windowed(df, cfg, horizons, errors)
        return _normalised(out, cfg, raw_specs() + specs)
    tasks = spread or tasks_for(df.sparkSession, rows)
    first, _ = _windowed(df if spread else df.repartition(tasks, SYMBOL), cfg, horizons, errors and KernelErrors())
    crossed = candidates(first)
    if cfg.universe_column not in df.columns:
        raise ValueError(f"The panel has no universe column {cfg.universe_column!r}")
    if spread and crossed:
        ranks, moments = _cross_of_stored(first, crossed, cfg.universe_column, bool(wide_dates(df, cfg.universe_column)), tasks)
    else:
        ranks, moments = cross_tables(first, crossed, cfg.universe_column, wide=True)
    df = df.drop(*ranks.columns[2:])
    out, specs = _windowed(_beside(df, ranks, None if spread else tasks), cfg, horizons, errors)
    return _normalised(out, cfg, raw_specs() + specs + cross_specs(crossed), crossed, moments)


@dataclass(frozen=True)
class ProcessedPanel:
    path: str
    manifest_path: str
    target_columns: list[str]
    specs: list[FeatureSpec]


def build_processed_panel(spark: SparkSession, config: PanelBuildConfig) -> ProcessedPanel:
    """Read the raw panel, compute features and labels, store them with a manifest beside.

    An indicator that fails for a symbol is left empty there, warned of once and named in the manifest. The panel is stored
    in buckets by symbol, in which its rows come anyway.
    """
    raw, errors = read_panel(spark, config.raw_path), KernelErrors()
    tasks = tasks_for(spark, raw.count())
    if not config.feature_config.cross_sectional_rank:
        raw = raw.repartition(tasks, SYMBOL)
    labelled, specs = panel_features(raw, config.feature_config, config.target_horizons, errors)
    known = {s.name for s in specs} | set(raw.columns)
    targets = [c for c in labelled.columns if c not in known]
    stored = annotated(compact_types(labelled), specs)
    write_by(stored, config.processed_path, SYMBOL, DATE, tasks)
    release(spark)
    manifest = {
        "version": 1,
        "symbol_buckets": tasks,
        "artifact_signature": {
            **config.signature(),
            "target_columns": targets,
            "feature_specs": [asdict(s) for s in specs],
        },
        "build_options": {},
        "indicator_errors": [{"kernel": k, "symbols": n, "message": m} for k, n, m in (errors.warn() if specs else [])],
    }
    write_json(spark, manifest, config.manifest_path)
    return ProcessedPanel(config.processed_path, config.manifest_path, targets, specs)


def load_processed_panel(
    spark: SparkSession, config: PanelBuildConfig
) -> tuple[DataFrame, list[str], list[FeatureSpec]]:
    """The stored panel, its target names and specs; a panel built with another config is refused."""
    df = read_panel(spark, config.processed_path)
    manifest = read_json(spark, config.manifest_path)
    found = manifest.get("artifact_signature")
    if not isinstance(found, dict):
        raise ValueError(f"{config.manifest_path} has no signature of its build")
    expected = config.signature()
    different = sorted(k for k in expected if found.get(k) != expected[k])
    if different:
        raise ValueError(f"Processed artifact config mismatch in {different}.")
    specs = [FeatureSpec(**s) for s in found["feature_specs"]]
    buckets = manifest.get("symbol_buckets")
    return read_by(df, config.processed_path, SYMBOL, DATE, buckets) if buckets else df, found["target_columns"], specs


def panel_buckets(spark: SparkSession, config: PanelBuildConfig) -> int | None:
    """In how many buckets by symbol the stored panel lies; None for a panel stored without."""
    return read_json(spark, config.manifest_path).get("symbol_buckets")
