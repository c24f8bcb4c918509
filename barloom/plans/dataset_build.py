"""Processed panel -> feature base, per-split sample metadata and a result manifest.

The feature base keeps each row's index in its symbol's history and lies in folders by year and by a hash of
the symbol, so that loading a split reads the folders its samples reach into and numbers nothing again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL, DatasetConfig, YearSplits
from barloom.functions.staging import read_by, read_json, release, write_by, write_json
from barloom.functions.windows import tasks_for
from barloom.operators.samples import (
    assert_valid_tensors,
    sample_metadata,
    sample_tensors,
    split_counts,
    usable_samples,
    with_row_index,
)
from barloom.operators.scaling import Scaler, assert_no_nulls, feature_base, fit_scaler
from barloom.operators.selection import cross_section_columns, feature_columns, scaler_columns
from barloom.operators.trade_calendar import panel_calendar
from barloom.plans.panel import load_processed_panel, panel_buckets


#: Rows that a folder of the feature base is meant to hold; more symbols make more folders.
ROWS_PER_FOLDER = 1 << 20
YEAR, SHARE = "year", "share"


@dataclass(frozen=True)
class DatasetResult:
    processed_path: str
    processed_config_path: str
    features_path: str
    metadata_path: str
    result_path: str
    feature_columns: list[str]
    target_columns: list[str]
    cross_sectional_columns: list[str]
    sample_counts: dict[str, int]
    feature_shares: int
    feature_buckets: int


def share_of(shares: int) -> Column:
    """Which of the shares of a year a symbol's rows lie in, by the hash that spreads rows over tasks."""
    return F.pmod(F.hash(F.col(SYMBOL).cast("string")), F.lit(shares)).cast("int")


@dataclass(frozen=True)
class Layout:
    """How the feature base lies: shares of a year, buckets by symbol, and whether the panel lies in those buckets already."""

    shares: int
    buckets: int
    given: bool


def layout_of(panel: DataFrame, buckets: int | None = None) -> Layout:
    """The number of buckets is a multiple of the shares, so a bucket's rows lie in one share. ``buckets`` are those by symbol
    in which the panel is stored; they stay, where the shares can be a divisor of their number."""
    spread = panel.agg(F.count(F.lit(1)).alias("n"), (F.year(F.max(DATE)) - F.year(F.min(DATE)) + 1).alias("years")).first()
    shares = max(1, spread["n"] // (ROWS_PER_FOLDER * (spread["years"] or 1)) + 1)
    fitting = next((k for k in range(shares, (buckets or 0) + 1) if buckets % k == 0), None)
    if fitting:
        return Layout(fitting, buckets, True)
    return Layout(shares, -(-tasks_for(panel.sparkSession, spread["n"]) // shares) * shares, False)


def write_features(panel: DataFrame, columns: Sequence[str], scaler: Scaler, path: str, layout: Layout | None = None) -> int:
    """Store the feature base with ``idx``, by year and share of symbols; returns the number of shares.

    The panel is spread over tasks by symbol once, for the windows, or lies so already; a task's rows lie in one share and are
    written from there as one bucket by symbol, without a second exchange of the wide rows.
    """
    layout = layout or layout_of(panel)
    base = feature_base(panel if layout.given else panel.repartition(layout.buckets, SYMBOL), columns, scaler)
    placed = with_row_index(base).withColumns({YEAR: F.year(DATE), SHARE: share_of(layout.shares)})
    write_by(placed, path, SYMBOL, DATE, layout.buckets, (YEAR, SHARE), "snappy")
    release(panel.sparkSession)
    return layout.shares


def read_features(features: DataFrame, metadata: DataFrame, shares: int) -> DataFrame:
    """The folders of the feature base that the windows of the samples reach into.

    What reaches the driver is one row per year and share.
    """
    years = F.explode(F.sequence(F.year("sequence_start_date"), F.year("sequence_end_date")))
    reached = metadata.select(years.alias(YEAR), share_of(shares).alias(SHARE)).distinct().collect()
    wanted = [sorted({row[c] for row in reached}) for c in (YEAR, SHARE)]
    return features.where(F.col(YEAR).isin(wanted[0]) & F.col(SHARE).isin(wanted[1]))


def write_metadata(metadata: DataFrame, path: str, splits: YearSplits) -> dict[str, int]:
    """Store samples as one folder per split and count them."""
    spark = metadata.sparkSession
    metadata.write.mode("overwrite").partitionBy("split").option("compression", "snappy").parquet(path)
    stored = spark.read.schema(metadata.schema).parquet(path)
    return {r["split"]: r["samples"] for r in split_counts(stored, splits).collect()}


def read_split(spark: SparkSession, path: str, split: str, schema) -> DataFrame:
    """Samples of one split; a split without samples gives an empty frame of the same schema."""
    return spark.read.schema(schema).parquet(path).where(F.col("split") == split).drop("split")


def build_dataset(spark: SparkSession, config: DatasetConfig, calendar: DataFrame) -> DatasetResult:
    """``calendar`` is an exchange calendar table ``(exchange, cal_date, is_open)``."""
    processed = config.processed
    panel, targets, specs = load_processed_panel(spark, processed)
    universe = processed.feature_config.universe_column
    features = feature_columns(panel, targets, universe_column=universe)
    if not features:
        raise ValueError("the processed panel has no model features")
    panel = panel.withColumn(DATE, F.to_date(DATE))
    days = panel_calendar(panel, calendar, config.exchange)
    if days.isEmpty():
        raise ValueError("no open day of the exchange in the panel's range")

    scaled = [c for c in scaler_columns(specs) if c in set(features)]
    scaler = fit_scaler(panel, scaled, config.splits)

    root = f"{config.dataset_dir.rstrip('/')}/{config.dataset_name}"
    features_path = f"{root}_features.parquet"
    layout = layout_of(panel, panel_buckets(spark, processed))
    shares = write_features(panel, features, scaler, features_path, layout)
    assert_no_nulls(spark.read.parquet(features_path), features)

    cross = cross_section_columns(specs)
    metadata = sample_metadata(
        panel, days, config.sequence, config.splits, targets, config.label_column, cross
    )
    metadata_path = f"{root}_metadata.parquet"
    counts = write_metadata(metadata, metadata_path, config.splits)

    result = DatasetResult(
        processed.processed_path,
        processed.manifest_path,
        features_path,
        metadata_path,
        f"{root}_build_result.json",
        features,
        targets,
        cross,
        counts,
        shares,
        layout.buckets,
    )
    document = {**asdict(result), "metadata_schema": metadata.schema.jsonValue()}
    write_json(spark, document, result.result_path)
    return result


def _plainly_valid(features: DataFrame, usable: DataFrame, names: Sequence[str], cross: Sequence[str]) -> bool:
    """Whether some sample has rows and no row or sample at hand has a gap, so that no tensor can have one.

    Reads rows as they are stored, where ``assert_valid_tensors`` has to build all tensors; what it would refuse is not plain.
    """
    gap = lambda columns: reduce(or_, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns], F.lit(False))
    one = usable.select(SYMBOL, "start_idx", "end_idx").first()
    if one is None:
        return False
    reached = features.where(F.col(SYMBOL).eqNullSafe(F.lit(one[SYMBOL])) & F.col("idx").between(one["start_idx"], one["end_idx"]))
    sides = [c for x in cross if x in usable.columns for c in (x, f"{x}_mask")]
    wide = [*names, *[f"{c}_mask" for c in names]]
    return not reached.isEmpty() and features.where(gap(wide)).isEmpty() and usable.where(gap(sides)).isEmpty()


def load_samples(
    spark: SparkSession,
    result_path: str,
    split: str,
    y_return: str = "y_ret_5",
    y_risk: str = "y_risk_vol_5",
    validate: bool = True,
) -> DataFrame:
    """Materialised samples of one split, located through the result manifest."""
    from pyspark.sql.types import StructType

    result = read_json(spark, result_path)
    names = result.get("feature_columns")
    if not names:
        raise ValueError(f"{result_path} names no features")
    schema = StructType.fromJson(result["metadata_schema"])
    metadata = read_split(spark, result["metadata_path"], split, schema)
    usable = usable_samples(metadata, y_return, y_risk)
    stored, buckets = spark.read.parquet(result["features_path"]), result.get("feature_buckets")
    if buckets:
        stored = read_by(stored, result["features_path"], SYMBOL, DATE, buckets, (YEAR, SHARE))
    features = read_features(stored, usable, result["feature_shares"])
    cross = result.get("cross_sectional_columns", [])
    tensors = sample_tensors(features, metadata, names, cross, y_return, y_risk, buckets=buckets)
    return tensors if not validate or _plainly_valid(features, usable, names, cross) else assert_valid_tensors(tensors)
