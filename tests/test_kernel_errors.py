"""Indicators that fail for a symbol fail alone, are counted on the side and warned of once."""

import warnings

import pytest
from pyspark.sql import functions as F

from barloom.config import FeatureConfig, PanelBuildConfig
from barloom.functions.staging import read_json
from barloom.operators import recursions
from barloom.operators.indicators import add_indicators
from barloom.plans.panel import build_processed_panel
from fixtures import three_symbols


@pytest.fixture
def broken(monkeypatch):
    """A Supertrend that cannot handle the second symbol's prices and a KDJ that cannot handle any but the first's."""

    def fails_above(kernel, limit, message):
        def run(high, low, close, **kwargs):
            if close.iloc[0] > limit:
                raise ValueError(message)
            return kernel(high, low, close, **kwargs)

        return run

    kernels = recursions._KERNELS
    monkeypatch.setitem(kernels, "supertrend", fails_above(kernels["supertrend"], 15.5, "prices too high"))
    monkeypatch.setitem(kernels, "kdj", fails_above(kernels["kdj"], 12.5, "not this symbol"))


def test_a_failing_kernel_leaves_nulls_and_a_row(spark, broken):
    panel, _ = three_symbols(spark)
    errors = recursions.KernelErrors()
    out, _ = add_indicators(panel, ta=True, extended=True, errors=errors)
    assert recursions.ERRORS not in out.columns
    whole, _ = add_indicators(panel, ta=True, extended=False)
    filled = {r.ts_code: r for r in out.groupBy("ts_code").agg(F.count("kdj_9_3_k").alias("kdj"), F.count("supertrend_10_3_dir").alias("trend"), F.count("er_10").alias("er"), F.count("atr_14").alias("atr")).collect()}
    assert [filled[c].kdj > 0 for c in sorted(filled)] == [True, False, False]
    assert [filled[c].trend > 0 for c in sorted(filled)] == [True, True, False]
    assert all(r.er == 5 and r.atr == 2 for r in filled.values()) and out.count() == whole.count()
    assert sorted(errors.rows()) == [("kdj", 2, "ValueError: not this symbol"), ("supertrend", 1, "ValueError: prices too high")]
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        errors.warn()
    assert len(told) == 1 and "kdj for 2 symbols" in str(told[0].message)


def test_without_a_report_the_job_fails(spark, broken):
    panel, _ = three_symbols(spark)
    with pytest.raises(Exception, match="not this symbol"):
        add_indicators(panel, ta=False, extended=True)[0].collect()


def test_a_build_names_failures_in_its_manifest(spark, broken, tmp_path):
    panel, _ = three_symbols(spark)
    panel.write.parquet(f"{tmp_path}/bars.parquet")
    features = FeatureConfig((3,), (3,), (5,), add_ta_features=False)
    config = PanelBuildConfig(f"{tmp_path}/bars.parquet", str(tmp_path), features, (1,))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        build_processed_panel(spark, config)
    assert sum("indicators left empty" in str(w.message) for w in told) == 1
    found = read_json(spark, config.manifest_path)["indicator_errors"]
    assert sorted((f["kernel"], f["symbols"]) for f in found) == [("kdj", 2), ("supertrend", 1)]
    assert "kdj_9_3_k" in spark.read.parquet(config.processed_path).columns


def test_no_failure_no_rows(spark):
    panel, _ = three_symbols(spark)
    errors = recursions.KernelErrors()
    add_indicators(panel, errors=errors)[0].collect()
    assert errors.rows() == []
