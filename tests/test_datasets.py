import datetime as dt
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import (
    DatasetConfig,
    FeatureConfig,
    PanelBuildConfig,
    SequenceConfig,
    YearSplits,
)
from barloom.operators import batches, scaling
from barloom.operators.samples import sample_metadata
from barloom.operators.trade_calendar import open_days, positions
from barloom.plans.dataset_build import build_dataset, load_samples
from barloom.plans.panel import build_processed_panel, load_processed_panel
from fixtures import calendar, three_years

warnings.simplefilter("ignore", RuntimeWarning)
SPLITS = YearSplits([2022], [2023], [2024])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dataset"))
    panel, days = three_years(spark)
    panel.write.parquet(f"{folder}/bars.parquet")
    features = FeatureConfig(
        (2,), (2,), (2,), cross_sectional_rank=False, add_time_features=False,
        add_ta_features=False, add_extended_ta_features=False,
    )
    config = PanelBuildConfig(f"{folder}/bars.parquet", folder, features, (1,))
    build_processed_panel(spark, config)
    full = DatasetConfig(config, SPLITS, SequenceConfig(3, 2, (1,)), folder)
    import pandas as pd

    open_calendar = [d for y in (2022, 2023, 2024) for d in pd.bdate_range(f"{y}-01-02", f"{y}-12-31")]
    return config, build_dataset(spark, full, calendar(spark, open_calendar))


def test_dataset_counts_and_width(spark, built):
    _, result = built
    assert result.sample_counts == {"train": 10, "evaluate": 10, "test": 10}
    assert len(result.feature_columns) == 31
    base = spark.read.parquet(result.features_path)
    assert len(base.drop("idx", "year", "share").columns) == 2 + 62
    train = base.where(F.year("date") == 2022)
    scaled = [c for c in result.feature_columns if c == "oc_ratio"]
    assert abs(train.agg(F.avg(scaled[0])).first()[0]) < 1e-5


def test_dates_stay_in_their_split(spark, built):
    _, result = built
    rows = spark.read.parquet(result.metadata_path)
    years = {"train": 2022, "evaluate": 2023, "test": 2024}
    for r in rows.select("split", "sequence_end_date").distinct().collect():
        assert r.sequence_end_date.year == years[r.split]


def test_samples_read_their_own_symbol(spark, built):
    _, result = built
    rows = load_samples(spark, result.result_path, "train", "y_ret_1", "y_risk_vol_1").collect()
    assert len(rows) == 10
    base = spark.read.parquet(result.features_path).toPandas().sort_values(["ts_code", "date"])
    names = result.feature_columns + [f"{c}_mask" for c in result.feature_columns]
    for r in rows:
        code, first, last = r.sample_id.split(":")
        mine = base[(base.ts_code == code)]
        day = mine.date.map(lambda d: d.strftime("%Y%m%d"))
        want = mine[(day >= first) & (day <= last)][names].to_numpy(dtype="float32")
        np.testing.assert_allclose(np.array(r.x_seq, dtype="float32"), want)


def test_load_reads_the_folders_of_its_split(spark, built):
    from barloom.functions.staging import read_json
    from barloom.operators.samples import with_row_index
    from barloom.plans.dataset_build import read_features

    _, result = built
    base = spark.read.parquet(result.features_path)
    assert {(r.year, r.n) for r in base.groupBy("year").agg(F.count("*").alias("n")).collect()} == {(2022, 24), (2023, 24), (2024, 24)}
    stored = base.select("ts_code", "date", "idx").collect()
    assert sorted(stored) == sorted(with_row_index(base.drop("idx")).select("ts_code", "date", "idx").collect())
    samples = spark.read.parquet(result.metadata_path).where("split = 'evaluate'")
    shares = read_json(spark, result.result_path)["feature_shares"]
    plan = read_features(base, samples, shares)._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: (.*?), PushedFilters", plan)[1]
    assert re.search(r"year#\d+ (=|IN) \(?2023\b", filters) and not re.search(r"\b2022\b|\b2024\b", filters)
    tensors = load_samples(spark, result.result_path, "evaluate", "y_ret_1", "y_risk_vol_1")
    loaded = tensors._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"year#\d+ (=|IN) \(?2023\b", loaded) and "row_number" not in loaded


def test_manifest_mismatch_is_refused(spark, built):
    config, _ = built
    assert load_processed_panel(spark, config)[1] == ["y_ret_1", "y_risk_vol_1"]
    other = PanelBuildConfig(config.raw_path, config.processed_dir, FeatureConfig(), (1,))
    with pytest.raises(ValueError, match="mismatch"):
        load_processed_panel(spark, other)
    with pytest.raises(FileNotFoundError):
        load_processed_panel(spark, PanelBuildConfig("x", "/nowhere/at/all"))


def test_gap_tolerance(spark):
    day = lambda d: dt.date(2024, 1, d)
    rows = [
        ("A", day(2), 10.0, 0.01, 0.02), ("A", day(3), 10.2, 0.02, 10.4 / 10.2 - 1),
        ("A", day(5), 10.4, 0.03, 10.6 / 10.4 - 1), ("A", day(8), 10.6, 0.04, None),
    ]
    panel = spark.createDataFrame(rows, "ts_code string, date date, close double, ret_1 double, y_ret_1 double")
    days = positions(open_days(calendar(spark, [day(d) for d in (2, 3, 4, 5, 8)])))
    find = lambda *gaps: sample_metadata(
        panel, days, SequenceConfig(3, 1, (1,), *gaps), SPLITS, ["y_ret_1"], "y_ret_1"
    ).collect()
    assert find(0, 0) == []
    (only,) = find(1, 1)
    assert (only.sequence_end_date, only.label_date, only.ret_1_mask) == (day(5), day(8), 1.0)
    assert only.sample_id == "A:20240102:20240105"


def test_config_checks():
    with pytest.raises(ValueError, match="2020 belongs to one split"):
        YearSplits([2020], [2021], [2020])
    with pytest.raises(ValueError, match="sequence_length is at least 1"):
        SequenceConfig(0)
    with pytest.raises(ValueError, match="there is a horizon"):
        PanelBuildConfig("a", "b", target_horizons=())
    panel = PanelBuildConfig("a", "b", target_horizons=(5, 1))
    with pytest.raises(ValueError, match="the panel's horizons"):
        DatasetConfig(panel, SPLITS, SequenceConfig(3, 1, (1,)), "d")
    assert DatasetConfig(panel, SPLITS, SequenceConfig(3, 1, (1, 5)), "d").label_column == "y_ret_1"


def test_scaler_errors_and_moments(spark):
    panel, _ = three_years(spark)
    with pytest.raises(ValueError, match="nope: not in the panel"):
        scaling.fit_scaler(panel, ["nope"], SPLITS)
    with pytest.raises(ValueError, match="train years"):
        scaling.fit_scaler(panel, ["close"], YearSplits([1999], [], []))
    flat = scaling.fit_scaler(panel.withColumn("one", F.lit(1.0)), ["one"], SPLITS)
    assert flat["one"] == (1.0, 1.0)
    with pytest.raises(ValueError, match="in_csi300: not a number"):
        scaling.feature_base(panel, ["in_csi300"], {})
    parts = scaling.partial_moments(panel, ["close", "open"], [F.year("date").alias("y")])
    merged = {r.feature: r for r in scaling.merge_moments(parts).collect()}
    whole = panel.agg(F.sum("close"), F.sum(F.col("close") * F.col("close"))).first()
    assert merged["close"]["count"] == 72
    assert merged["close"]["sum"] == pytest.approx(whole[0])
    assert merged["close"]["sumsq"] == pytest.approx(whole[1])


@pytest.fixture(scope="module")
def skewed_samples(spark):
    """A third of all samples share one label date."""
    day = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17 + 1)
    return spark.range(3000).select(
        F.concat(F.lit("s"), F.lpad("id", 5, "0")).alias("sample_id"),
        F.date_add(F.lit("2024-01-01"), day.cast("int")).alias("label_date"),
    ).cache()


@pytest.mark.parametrize("shuffle", [True, False])
@pytest.mark.parametrize("drop_last", [True, False])
def test_date_batches(skewed_samples, shuffle, drop_last):
    plan = batches.date_batches(skewed_samples, 7, shuffle, drop_last).toPandas()
    sizes = plan.groupby(["label_date", "batch_in_date"]).sample_id.agg(["count", "nunique"])
    assert (sizes["count"] <= 7).all() and (sizes["count"] == sizes["nunique"]).all()
    total = batches.batch_count(skewed_samples, 7, drop_last).first().batches
    assert len(sizes) == total
    assert plan.sample_id.is_unique
    assert (sizes["count"] == 7).all() if drop_last else len(plan) == 3000
    if not shuffle:
        in_order = plan.sort_values(["label_date", "batch_in_date", "slot"])
        for _, g in in_order.groupby("label_date"):
            assert g.sample_id.is_monotonic_increasing


def test_epochs_differ_and_repeat(skewed_samples):
    first = batches.date_batches(skewed_samples, 7, epoch=0)
    again = batches.date_batches(skewed_samples, 7, epoch=0)
    other = batches.date_batches(skewed_samples, 7, epoch=1)
    assert first.exceptAll(again).count() == 0
    assert first.exceptAll(other).count() > 0


@pytest.mark.parametrize("drop_last", [True, False])
def test_rank_batches(skewed_samples, drop_last):
    plan = batches.rank_batches(skewed_samples, 7, 4, drop_last=drop_last).toPandas()
    steps = plan.groupby("rank").step.agg(["min", "max", "nunique"])
    assert len(steps) == 4 and steps["max"].nunique() == 1 and (steps["nunique"] == steps["max"] + 1).all()
    assert (plan.groupby(["rank", "step"]).label_date.nunique() == 1).all()
    total = batches.batch_count(skewed_samples, 7, drop_last).first().batches
    whole = total // 4 * 4 if drop_last else -(-total // 4) * 4
    assert len(plan.groupby(["rank", "step"])) == whole
