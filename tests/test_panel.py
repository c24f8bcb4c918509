import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import FeatureConfig, FeatureSpec, target_horizon, target_mask
from barloom.functions.windows import rolling_zscore, safe_div
from barloom.operators import zscores
from barloom.operators.base_features import add_base_features
from barloom.operators.contract import assert_unique_keys, check_input, compact_types
from barloom.operators.cross_section import CANDIDATES, cross_section
from barloom.operators.indicators import add_indicators, indicator_batch, number_suffix
from barloom.operators.selection import annotated, feature_columns, specs_of, warn_of_bare_columns
from barloom.operators.targets import add_targets
from barloom.operators.zscores import add_rolling_zscores
from barloom.plans.panel import panel_features
from fixtures import three_symbols, three_years

warnings.simplefilter("ignore", RuntimeWarning)


def pdf(df, *keys):
    return df.toPandas().sort_values(list(keys or ("ts_code", "date"))).reset_index(drop=True)


def close(a, b):
    np.testing.assert_allclose(
        np.asarray(a, dtype=float), np.asarray(b, dtype=float), rtol=1e-9, atol=1e-12, equal_nan=True
    )


@pytest.fixture(scope="module")
def random_bars(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in range(4):
        price = 20.0 + s
        for i, day in enumerate(pd.bdate_range("2020-01-01", periods=90)):
            before, price = price, max(1.0, price * (1 + rng.normal(0, 0.05)))
            high, low = max(before, price) * 1.01, min(before, price) * 0.99
            rows.append((f"S{s}", day.date(), before, high, low, price, before, int(rng.integers(1, 99)), bool(s)))
    return spark.createDataFrame(
        rows,
        "ts_code string, date date, open double, high double, low double, close double, "
        "pre_close double, volume long, in_csi300 boolean",
    ).repartition(5).cache()


def test_contract(spark):
    df, _ = three_years(spark)
    with pytest.raises(ValueError, match="volume"):
        check_input(df.drop("volume"))
    text = df.withColumn("date", F.date_format("date", "yyyyMMdd")).withColumn("close", F.lit(float("nan")))
    fixed = check_input(text)
    assert dict(fixed.dtypes)["date"] == "date"
    assert fixed.where("close is not null or date is null").count() == 0
    assert_unique_keys(df)
    with pytest.raises(ValueError, match="2 rows"):
        assert_unique_keys(df.unionByName(df))
    assert dict(compact_types(df).dtypes)["close"] == "float"


def test_base_features_match_pandas(random_bars):
    out, specs = add_base_features(random_bars, FeatureConfig())
    assert len(specs) == 29
    got = pdf(out)
    for _, g in got.groupby("ts_code"):
        ret = g["close"].pct_change(fill_method=None).clip(-0.2, 0.2)
        close(g["ret_1"], ret)
        close(g["volatility_10"], ret.rolling(10).std())
        close(g["ma_ratio_20"], g["close"] / (g["close"].rolling(20).mean().abs() + 1e-12) - 1)
        loss = ret.where(ret < 0, 0.0)
        close(g["sortino_like_5"], ret.rolling(5).mean() / (loss.rolling(5).std() + 1e-12))
        close(g["drawdown_5"], g["close"] / (g["close"].rolling(5).max() + 1e-12) - 1)


def test_safe_div_drops_the_sign(spark):
    row = spark.range(1).select(safe_div(F.lit(1.0), F.lit(-2.0)).alias("a"), safe_div(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert row.a == pytest.approx(0.5) and row.b == pytest.approx(1e12)


def test_zscore_kernel_equals_window_form(random_bars):
    df = random_bars.withColumn("gap", F.when(F.col("volume") > 20, F.col("close")))
    df = df.withColumn("flat", F.lit(0.3))
    columns = ["close", "gap", "flat"]
    kernel = pdf(add_rolling_zscores(df, columns, (1, 5, 10)))
    native = pdf(df.withColumns({f"{c}_z{w}": rolling_zscore(c, w) for c in columns for w in (1, 5, 10)}))
    for c in columns:
        for w in (1, 5, 10):
            close(kernel[f"{c}_z{w}"], native[f"{c}_z{w}"])


def test_zscores_over_the_ends_of_stretches(monkeypatch):
    pick = np.random.default_rng(4)
    x = pick.normal(size=(3, 41))
    x[0, pick.random(41) < 0.1], x[1, 10:30] = np.nan, 0.3
    whole = {rows: zscores._rolling_z(x, rows) for rows in (1, 2, 5, 41, 42)}
    for stretch in (1, 4, 37):
        monkeypatch.setattr(zscores, "STRETCH", stretch)
        for rows, found in whole.items():
            np.testing.assert_array_equal(zscores._rolling_z(x, rows), found)
    for k, rows in ((0, 2), (2, 5), (2, 41)):
        window = pd.Series(x[k]).rolling(rows)
        np.testing.assert_allclose(whole[rows][k], (x[k] - window.mean()) / window.std(), rtol=1e-6)
    assert (whole[5][1, 14:30] == 0).all() and np.isnan(whole[42]).all()


def test_indicators_match_pandas(random_bars):
    out, specs = add_indicators(random_bars)
    assert len(specs) == 28
    for _, g in pdf(out).groupby("ts_code"):
        ema = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        line = ema(g["close"], 12) - ema(g["close"], 26)
        close(g["macd"], line)
        close(g["macd_signal"], ema(line, 9))
        tp = (g["high"] + g["low"] + g["close"]) / 3
        spread = tp.rolling(20).apply(lambda w: np.abs(w - w.mean()).mean())
        close(g["cci_20"], (tp - tp.rolling(20).mean()) / (0.015 * spread))
        assert g["adx_14"].first_valid_index() - g.index[0] == 27
        assert g["atr_14"].first_valid_index() - g.index[0] == 13
        long, short = g["supertrend_10_3_long"], g["supertrend_10_3_short"]
        close(g["supertrend_10_3_line"], long.fillna(short))
        assert not (long.notna() & short.notna()).any()
    assert (number_suffix(3.0), number_suffix(2.5)) == ("3", "2p5")
    with pytest.raises(ValueError, match="Unknown indicator"):
        indicator_batch(random_bars, [{"kind": "vortex"}])


def test_extended_indicators_need_prices(random_bars):
    with pytest.warns(RuntimeWarning, match="skipped"):
        out, specs = add_indicators(random_bars.drop("high"), ta=False)
    assert specs == [] and "er_10" not in out.columns


def test_spec_count_of_the_small_panel(spark):
    df, _ = three_symbols(spark)
    cfg = FeatureConfig((3, 5), (3, 5), (5,), add_ta_features=False, add_extended_ta_features=False)
    out, specs = panel_features(df, cfg)
    assert len(specs) == 75
    kinds = [s.kind for s in specs]
    assert kinds.count("cross_sectional") == 6 and kinds.count("id") == 2
    assert out.count() == 45
    empty, none = panel_features(df.limit(0), cfg)
    assert none == [] and empty.count() == 0


def test_default_feature_width(random_bars):
    out, specs = panel_features(random_bars, None, (1, 5))
    model = feature_columns(out, [c for c in out.columns if c.startswith("y_")])
    assert len(model) == 232
    assert sum(s.kind == "cross_sectional" for s in specs) == 2 * len(CANDIDATES) == 36


def test_cross_section_stays_in_the_universe(random_bars):
    df, _ = add_base_features(random_bars, FeatureConfig())
    plain = pdf(cross_section(df, ["ret_1", "ret_5"]))
    members = plain[plain.in_csi300]
    want = members.groupby("date")["ret_5"].rank(pct=True)
    close(members["ret_5_cs_rank"], want)
    assert plain.loc[~plain.in_csi300, "ret_1_cs_rank"].isna().all()
    by_day = plain[plain.in_csi300].groupby("date")["ret_1_cs_z"].mean().dropna()
    assert np.abs(by_day).max() < 1e-9


def test_no_look_ahead_and_symbol_isolation(random_bars):
    cfg = FeatureConfig(add_time_features=False, cross_sectional_rank=False, zscore_windows=(5,))
    whole = pdf(panel_features(random_bars, cfg)[0])
    cut = pdf(panel_features(random_bars.where("date < '2020-03-20'"), cfg)[0])
    alone = pdf(panel_features(random_bars.where("ts_code = 'S2'"), cfg)[0])
    numbers = [c for c in whole.columns if c not in ("ts_code", "date", "in_csi300")]
    early = whole[whole.date < cut.date.max() + pd.Timedelta(days=1)].reset_index(drop=True)
    close(early[numbers], cut[numbers])
    close(whole[whole.ts_code == "S2"][numbers], alone[numbers])


def test_targets(random_bars):
    out, names = add_targets(random_bars, (1, 3))
    assert names == ["y_ret_1", "y_risk_vol_1", "y_ret_3", "y_risk_vol_3"]
    for _, g in pdf(out).groupby("ts_code"):
        close(g["y_ret_3"], g["close"].shift(-3) / g["close"] - 1)
        ret = g["close"].pct_change(fill_method=None)
        want = ret.rolling(3).std(ddof=0).shift(-3)
        np.testing.assert_allclose(g["y_risk_vol_3"], want, rtol=1e-5, equal_nan=True)
        assert (g["y_risk_vol_1"].dropna() == 0).all()
    with pytest.raises(ValueError, match="lacks"):
        add_targets(random_bars.drop("close"))


def test_specs_live_in_the_schema(spark, tmp_path):
    spec = FeatureSpec("a", "numeric", "float32")
    noted = annotated(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), [spec, spec])
    noted.write.parquet(f"{tmp_path}/noted")
    assert specs_of(spark.read.parquet(f"{tmp_path}/noted")) == specs_of(noted) == [spec]
    with pytest.raises(ValueError, match="described twice"):
        annotated(noted, [FeatureSpec("a", "boolean", "int8")])
    with pytest.raises(ValueError, match="no column"):
        annotated(noted.drop("a"), [spec])
    with pytest.warns(RuntimeWarning, match="'b'"):
        warn_of_bare_columns(noted)


def test_target_names():
    names = {"y_ret_5": 5, "y_ret_5_ra": 5, "y_risk_vol_10": 10, "y_risk_3": 3, "y_other": None}
    assert {n: target_horizon(n) for n in names} == names
    assert target_mask("y_ret_5") == "ret_5_mask"
    assert target_mask("y_ret_5_ra") == "ret_5_ra_mask"
    assert target_mask("y_ret_1_ra") == "y_ret_1_ra_mask"
    assert target_mask("y_risk_vol_5") == "y_risk_vol_5_mask"


def test_recomputing_replaces_columns(random_bars):
    once, _ = add_indicators(random_bars)
    twice, _ = add_indicators(once)
    assert sorted(once.columns) == sorted(twice.columns)
    assert replace(FeatureConfig(), clip_return=None).clip_return is None
