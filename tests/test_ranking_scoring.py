import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import ranking, scoring

DAY = dt.date(2024, 1, 2)


def table(spark, pred, true, risk=0.01, day=DAY):
    rows = [(f"s{i:03d}", day, float(p), float(t), risk) for i, (p, t) in enumerate(zip(pred, true))]
    return spark.createDataFrame(
        rows, "sample_id string, label_date date, y_pred double, y_true double, pred_risk double"
    )


@pytest.fixture(scope="module")
def skewed(spark):
    """One date holds most rows, a third of all rows share one prediction, some dates and predictions
    are null."""
    rng = np.random.default_rng(3)
    n = 2400
    pred = np.round(rng.normal(size=n), 2)
    pred[rng.random(n) < 0.35] = 0.25
    day = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5, n))
    rows = [
        (
            f"s{i:05d}",
            None if rng.random() < 0.03 else DAY + dt.timedelta(days=int(day[i])),
            None if rng.random() < 0.05 else float(pred[i]),
            float(rng.normal() + pred[i]),
        )
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "sample_id string, label_date date, y_pred double, y_true double")
    return df.repartition(6).cache(), pd.DataFrame(rows, columns=df.columns)


def test_ranks_equal_pandas(skewed):
    df, frame = skewed
    got = scoring.with_ranks(df).toPandas().set_index("sample_id").sort_index()
    frame = frame.set_index("sample_id").sort_index()
    assert len(got) == len(frame)
    for value, rank in (("y_pred", "pred_rank"), ("y_true", "true_rank")):
        want = frame.groupby("label_date", dropna=False)[value].rank()
        np.testing.assert_allclose(got[rank], want)


def test_positions_cover_every_row_of_every_group(skewed):
    df, frame = skewed
    for value in ("y_pred", "sample_id"):
        got = ranking.positions_in_group(df, ["label_date"], value, "sample_id").collect()
        assert len(got) == len(frame)
        groups = {}
        for row in got:
            groups.setdefault(row.label_date, []).append(row)
        for rows in groups.values():
            first = lambda r: (r[value] is not None, r[value] or 0) if value == "y_pred" else r[value]
            rows.sort(key=lambda r: (first(r), hashlib.md5(r.sample_id.encode()).hexdigest()))
            assert [r._position for r in rows] == list(range(1, len(rows) + 1))
            assert {r._group_rows for r in rows} == {len(rows)}


def test_a_value_across_cuts_has_one_rank(spark, skewed, monkeypatch):
    """Cut by hand into many partitions, so that the shared value lies in several of them."""
    df, frame = skewed
    ordinary = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *c: ordinary(self, 40, *c))
    cut = ranking._sorted(df, ["label_date"], ["y_pred", "sample_id"]).withColumn("_part", F.spark_partition_id())
    assert cut.where("y_pred = 0.25").select("_part").distinct().count() > 5
    got = ranking.with_average_rank(df, ["label_date"], "y_pred", "r").toPandas().set_index("sample_id")
    frame = frame.set_index("sample_id")
    groups = frame.groupby("label_date", dropna=False)["y_pred"]
    got = got.loc[frame.index]
    np.testing.assert_allclose(got["r"], groups.rank())
    np.testing.assert_allclose(got["r_of"], groups.transform("count"))


def test_runs_over_many_small_batches(spark):
    """Runs and groups that begin and end inside, at and across batches, with nulls, NaN and both zeros."""
    rng = np.random.default_rng(8)
    values = [None, -0.0, 0.0, 1.0, 1.0, 1.0, 2.5, float("nan"), float("inf")]
    rows = [(None if k % 7 == 0 else f"g{k % 3}", values[int(rng.integers(len(values)))], k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, id int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.id: (r.r, r.r_of) for r in ranking.with_average_rank(df, ["g"], "x", "r").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, x, k in rows:
        mine = [y for h, y, _ in rows if h == g and y is not None]
        key = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
        if x is None:
            assert got[k][0] is None
        else:
            lower, alike = sum(key(y) < key(x) for y in mine), sum(key(y) == key(x) for y in mine)
            assert got[k] == (lower + (alike + 1) / 2, len(mine))


def test_golden_scores(spark):
    x = np.arange(20.0)
    same, opposite = table(spark, x, x), table(spark, x, -x)
    assert scoring.date_ic(same).first().ic == pytest.approx(1)
    assert scoring.date_rank_ic(same).first().rank_ic == pytest.approx(1)
    assert scoring.date_rank_ic(opposite).first().rank_ic == pytest.approx(-1)
    spread = scoring.date_spread(same).first()
    assert spread.k == 4 and spread.spread == pytest.approx(16)
    assert scoring.date_ic(table(spark, x[:19], x[:19])).count() == 0
    assert scoring.date_ic(table(spark, np.ones(20), x)).count() == 0
    empty = scoring.metric_summary(table(spark, x[:5], x[:5])).first()
    assert all(v is None for v in empty)


def test_summary_without_a_rank_ic_is_empty(spark):
    x = np.arange(25.0)
    infinite = scoring.metric_summary(table(spark, np.append(x[:24], np.inf), x)).first()
    assert all(v is None for v in infinite)
    other = table(spark, x, x, day=DAY + dt.timedelta(days=1))
    mixed = scoring.metric_summary(table(spark, np.append(x[:24], np.inf), x).unionByName(other)).first()
    assert mixed.rank_ic_mean == pytest.approx(1) and mixed.top_bottom_spread == pytest.approx(20)


def test_spread_leaves_unknown_targets_out(spark):
    x = np.arange(20.0)
    true = x.copy()
    true[[0, 19]] = np.nan
    got = scoring.date_spread(table(spark, x, true), min_size=5).first()
    assert got.spread == pytest.approx(np.nanmean(true[16:]) - np.nanmean(true[:4]))


def test_losses(spark):
    pred, true = np.array([0.1, 0.2, 0.4]), np.array([0.0, 0.3, 0.2])
    df = table(spark, pred, true, risk=1e-9)
    row = scoring.loss_report(df, alpha_rank=0.5, alpha_mse=2.0).first()
    mse, var = ((pred - true) ** 2).mean(), 1e-4
    nll = (0.5 * (np.log(var) + (pred - true) ** 2 / var)).mean()
    x, y = pred - pred.mean(), true - true.mean()
    rank = -(x * y).mean() / np.sqrt((x * x).mean() * (y * y).mean() + 1e-8)
    assert row.mse_loss == pytest.approx(mse) and row.nll_loss == pytest.approx(nll)
    assert row.rank_loss == pytest.approx(rank)
    assert row.loss == pytest.approx(nll + 2 * mse + 0.5 * rank)
    assert row.pred_var_min == row.pred_var_max == var
    with pytest.raises(ValueError, match="Unsupported loss_type"):
        scoring.loss_report(df, loss_type="huber")
    plain = scoring.loss_report(df, loss_type="mse").first()
    assert plain.nll_loss == 0 and plain.rank_loss == 0 and plain.loss == pytest.approx(mse)
    flat = table(spark, [1.0, 1.0], true[:2]).groupBy("label_date").agg(scoring.rank_ic_loss().alias("r"))
    assert flat.first().r == 0


def test_roll_up(spark):
    rows = [(2, 1.0, 3.0, 5.0, 9.0), (6, 2.0, 5.0, 4.0, 8.0)]
    df = spark.createDataFrame(rows, "n long, loss double, rank_loss double, pred_var_min double, pred_var_max double")
    row = scoring.roll_up(df).first()
    assert (row.loss, row.rank_loss, row.pred_var_min, row.pred_var_max) == (1.75, 4.0, 4.0, 9.0)


def test_profile_flags(spark):
    df = table(spark, [1.0, float("inf"), float("nan")], [1.0, -1.0, 2.0])
    row = scoring.prediction_profile(df, ["y_pred"]).first()
    assert row.y_pred_has_inf and row.y_pred_has_nan and not row.y_pred_has_null
    assert row.y_true_pos_ratio == pytest.approx(2 / 3)
    assert df.select(F.count_if(F.isnan("y_pred"))).first()[0] == 1
