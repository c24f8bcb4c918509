"""Folds, portfolios, performance, market states, baselines and data health against plain Python."""

import datetime as dt
import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import baselines, folds, health, market_state, performance, portfolio

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=int(n))


def days(spark, n):
    return spark.createDataFrame([(day(k), k) for k in range(n)], "cal_date date, pos long")


# --- folds -----------------------------------------------------------------------------------


def samples(spark, n_days, length=3, horizon=4):
    rows = [(f"{s}:{k}", day(k - length + 1), day(k), day(k + horizon)) for s in range(3) for k in range(length - 1, n_days)]
    rows += [("no label", day(1), day(5), None), ("not open", day(1), dt.date(2030, 1, 1), day(9))]
    return spark.createDataFrame(rows, "sample_id string, sequence_start_date date, sequence_end_date date, label_date date")


@pytest.mark.parametrize(
    "plan",
    [
        folds.WalkForward(10, 5, 20),
        folds.WalkForward(7, 9, 12, embargo_days=3),
        folds.WalkForward(6, 2, first_test_day=15),
        folds.WalkForward(50, 50, first_test_day=90),
    ],
)
@pytest.mark.parametrize("whole", [False, True])
def test_walk_forward_equals_all_pairs(spark, plan, whole):
    calendar, table = days(spark, 60), samples(spark, 60)
    ranges = folds.fold_ranges(calendar, plan)
    found = [(r.fold, r.role, r.first_pos, r.last_pos) for r in ranges.collect()]
    want_ranges, k = [], 0
    while (first := plan.first_test_day + k * plan.step_days) <= 59:
        last = first - 1 - plan.embargo_days
        want_ranges += [
            (k, "train", max(0, last - plan.train_days + 1) if plan.train_days else 0, last),
            (k, "test", first, min(first + plan.test_days - 1, 59)),
        ]
        k += 1
    assert sorted(found) == sorted(want_ranges)
    assert all(r.first_date == day(r.first_pos) and r.last_date == day(r.last_pos) for r in ranges.collect())
    got = folds.in_folds(table, ranges, calendar, whole_windows=whole)
    assert got.columns == [*table.columns, "fold", "role"]
    pos = lambda d: (d - DAY).days
    open_day = lambda d: d is not None and 0 <= pos(d) < 60
    want = [
        (r.sample_id, fold, role)
        for r in table.collect()
        for fold, role, a, b in want_ranges
        if open_day(r.sequence_end_date) and open_day(r.label_date)
        and a <= pos(r.sequence_end_date) <= b and pos(r.label_date) <= b
        and (not whole or (open_day(r.sequence_start_date) and pos(r.sequence_start_date) >= a))
    ]
    assert sorted((r.sample_id, r.fold, r.role) for r in got.collect()) == sorted(want)


def test_no_training_label_reaches_a_test_range(spark):
    calendar = days(spark, 80)
    ranges = folds.fold_ranges(calendar, folds.WalkForward(10, 4, 30, embargo_days=2))
    got = folds.in_folds(samples(spark, 80), ranges, calendar)
    first_test = {r.fold: r.first_date for r in ranges.where("role = 'test'").collect()}
    summary = folds.split_summary(got, "fold", "role").collect()
    assert {r.fold for r in summary if r.role == "train"} == set(first_test)
    for r in summary:
        if r.role == "train":
            assert r.last_label_date < first_test[r.fold] - dt.timedelta(days=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folds_refuse_bad_plans_and_calendars(spark):
    for bad in [dict(test_days=0, step_days=1, train_days=5), dict(test_days=1, step_days=1), dict(test_days=1, step_days=1, train_days=5, embargo_days=-1)]:
        with pytest.raises(ValueError):
            folds.WalkForward(**bad)
    twice = days(spark, 5).unionByName(days(spark, 5))
    with pytest.raises(ValueError):
        folds.fold_ranges(twice, folds.WalkForward(1, 1, 2))
    assert folds.fold_ranges(days(spark, 5), folds.WalkForward(1, 1, 20)).count() == 0


# --- portfolios ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forecasts(spark):
    """One date holds 70 % of the rows, predictions repeat, some are null, one date is too small, one is flat."""
    rng = np.random.default_rng(11)
    rows = []
    for date, n in ((0, 700), (1, 60), (2, 33), (3, 7), (4, 90), (5, 41), (6, 30)):
        for k in range(n):
            pred = None if rng.random() < 0.03 else 1.0 if date == 6 else float(np.round(rng.normal(), 1))
            rows.append((f"s{k}:{day(date)}", f"s{k}", day(date), pred, float(rng.normal() / 10), float(rng.random())))
    frame = pd.DataFrame(rows, columns=["sample_id", "ts_code", "label_date", "y_pred", "y_true", "pred_risk"])
    schema = "sample_id string, ts_code string, label_date date, y_pred double, y_true double, pred_risk double"
    return spark.createDataFrame(rows, schema).repartition(6).cache(), frame


def quantiles(frame, groups):
    import hashlib

    known = frame.dropna(subset=["y_pred"]).copy()
    known["md5"] = known.sample_id.map(lambda s: hashlib.md5(s.encode()).hexdigest())
    known = known.sort_values(["label_date", "y_pred", "md5", "sample_id"])
    size, place = known.groupby("label_date").sample_id.transform("size"), known.groupby("label_date").cumcount()
    known["q"] = place * groups // size + 1
    spread = known.groupby("label_date").y_pred.transform(lambda x: x.std(ddof=0))
    return known[(size >= 20) & (spread > 1e-12)]


@pytest.mark.parametrize("groups", [2, 5, 7])
def test_quantile_returns_equal_pandas(forecasts, groups):
    df, frame = forecasts
    known = quantiles(frame, groups)
    want = known.groupby(["label_date", "q"]).y_true.agg(["size", "mean"])
    got = portfolio.quantile_returns(df, groups).toPandas().set_index(["label_date", "portfolio"]).sort_index()
    assert len(got) == len(want) + known.label_date.nunique()
    wealth = defaultdict(lambda: 1.0)
    for (date, q), row in want.sort_index().iterrows():
        r = got.loc[(date, f"q{q}")]
        wealth[q] *= 1 + row["mean"]
        assert r.n == row["size"]
        np.testing.assert_allclose([r.ret, r.log_wealth], [row["mean"], math.log(wealth[q])])
    for date in known.label_date.unique():
        spread = want.loc[(date, groups), "mean"] - want.loc[(date, 1), "mean"]
        np.testing.assert_allclose(got.loc[(date, "long_short")].ret, spread)


def test_sizes_of_quantiles_differ_by_one(forecasts):
    df, _ = forecasts
    rows = portfolio.with_quantile(df.where("y_pred is not null"), 7).groupBy("label_date", "quantile").count().collect()
    by_date = defaultdict(list)
    for r in rows:
        by_date[r.label_date].append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in by_date.values())


def test_wealth_after_a_total_loss_is_zero(spark):
    from pyspark.sql import Window

    rows = spark.createDataFrame([(k, r) for k, r in enumerate([0.5, None, -1.0, 0.5])], "t int, r double")
    out = rows.select(F.exp(portfolio.log_wealth(F.col("r"), Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))).alias("w"))
    np.testing.assert_allclose([r.w for r in out.collect()], [1.5, 1.5, 0.0, 0.0])


def test_monotonicity(spark):
    def one(means):
        rows = [(day(0), f"q{k + 1}", 1, m) for k, m in enumerate(means)] + [(day(0), "long_short", 2, -9.0)]
        return portfolio.monotonicity(spark.createDataFrame(rows, "label_date date, portfolio string, n long, ret double")).first()

    up = one([0.0, 0.1, 0.2, 0.2, 0.3] + [1.0 + k for k in range(7)])
    assert (up.rising, up.steps, up.monotone) == (10, 11, False) and up.means[-1] == 7.0
    assert one([1.0, 2.0]).monotone and not one([2.0, 1.0]).monotone


def test_holdings_and_costs_equal_a_loop(spark, forecasts):
    df, frame = forecasts
    calendar, horizons, costs = days(spark, 9), (1, 3), (0.0, 0.01)
    rng = np.random.default_rng(2)
    price = {(f"s{k}", t): float(rng.normal() / 50) for k in range(700) for t in range(9) if rng.random() < 0.8}
    returns = spark.createDataFrame([(*k, v) for k, v in price.items()], "ts_code string, pos long, ret double")
    top = quantiles(frame, 5)
    top = top[top.q == 5]
    bought = {pos: set(top[top.label_date == day(pos)].ts_code) for pos in range(9)}
    got = portfolio.daily_portfolio(portfolio.holdings(portfolio.cohorts(df, calendar), horizons), returns, calendar)
    rows = {(r.holding, (r.date - DAY).days): r for r in got.collect()}
    for h in horizons:
        before = {}
        for pos in range(9):
            now = defaultdict(float)
            for j in range(h):
                for s in bought.get(pos - j, ()):
                    now[s] += 1 / len(bought[pos - j]) / h
            if not now and not before:
                assert (h, pos) not in rows
                continue
            r = rows[h, pos]
            turnover = sum(abs(now.get(s, 0.0) - before.get(s, 0.0)) for s in {*now, *before}) / 2
            gross = sum(w * price.get((s, pos), 0.0) for s, w in now.items())
            assert (r.names, r.kept) == (len(now), len(set(now) & set(before)))
            np.testing.assert_allclose([r.turnover, r.gross], [turnover, gross], atol=1e-12)
            before = dict(now)
    grid = {(r.holding, r.cost): r for r in portfolio.cost_grid(got, costs).collect()}
    assert len(grid) == 4
    for (h, c), r in grid.items():
        net = [x.gross - c * x.turnover for (k, _), x in rows.items() if k == h]
        np.testing.assert_allclose([r.days, r.net, r.hit_ratio], [len(net), np.mean(net), np.mean(np.array(net) > 0)])


def test_volatility_exposure(forecasts):
    df, frame = forecasts
    known = quantiles(frame, 5)
    got = portfolio.volatility_exposure(df).toPandas().set_index("label_date")
    for date, rows in known.groupby("label_date"):
        dev = np.sqrt(rows.pred_risk)
        top, bottom = dev[rows.q == 5].mean(), dev[rows.q == 1].mean()
        np.testing.assert_allclose(list(got.loc[date, ["top", "bottom", "tilt"]]), [top, bottom, (top - bottom) / dev.std(ddof=0)])


# --- performance -----------------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [1024, 7, 2])
def test_drawdown_equals_the_ordered_scan(spark, monkeypatch, stretch):
    monkeypatch.setattr(performance, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    series = {f"p{k}": rng.normal(0.0, 0.05, rng.integers(1, 90)) for k in range(12)}
    series["up"], series["lost"], series["worse"] = np.full(9, 0.1), np.array([0.1, -1.0, 0.3]), np.array([0.2, -1.5, 2.0, -0.1])
    rows = [(name, 3 * i, float(r)) for name, values in series.items() for i, r in enumerate(values)] + [("p0", 2, None), ("none", 1, None)]
    got = {r.name: r for r in performance.drawdown(spark.createDataFrame(rows, "name string, pos long, ret double").repartition(5), ["name"]).collect()}
    assert set(got) == set(series)
    for name, values in series.items():
        wealth = peak = 1.0
        worst = 0.0
        for r in values:
            wealth *= max(1 + r, 0.0)
            peak = max(peak, wealth)
            worst = min(worst, wealth / peak - 1)
        np.testing.assert_allclose([math.exp(got[name].log_growth), got[name].max_drawdown], [wealth, worst], atol=1e-12)


def test_ratios(spark):
    values = [0.01, -0.02, 0.03, 0.0]
    df = spark.createDataFrame([("a", k, r, 0.01) for k, r in enumerate(values)] + [("flat", 0, 0.5, 0.5), ("flat", 1, 0.5, 0.5)], "p string, pos int, ret double, market double")
    got = {r.p: r for r in performance.performance(df, ["p"], 252, benchmark="market").collect()}
    x = np.array(values)
    want = [x.mean(), x.std(ddof=1) * math.sqrt(252), x.mean() / x.std(ddof=1) * math.sqrt(252), 0.5, (x - 0.01).mean() / (x - 0.01).std(ddof=1) * math.sqrt(252)]
    r = got["a"]
    np.testing.assert_allclose([r["mean"], r.volatility, r.sharpe, r.hit_ratio, r.information_ratio], want)
    assert got["flat"].sharpe is None and got["flat"].max_drawdown == 0.0


# --- market states ---------------------------------------------------------------------------


def test_states_are_runs(spark):
    rets = [0.0, 1.0, 1.0, 1.0, -3.0, -3.0, 0.5, 0.0, 0.0, 0.0, None, 2.0]
    rows = [("X", day(2 * k), r) for k, r in enumerate(rets)] + [("Y", day(0), 1.0)]
    states = market_state.market_states(spark.createDataFrame(rows, "index_code string, date date, ret double"), 2, 0.1)
    got = [(r.state, (r.first_date - DAY).days // 2, (r.last_date - DAY).days // 2, r.days) for r in states.orderBy("first_date").collect()]
    assert got == [("up", 1, 3, 3), ("down", 4, 6, 3), ("up", 7, 7, 1), ("flat", 8, 9, 2)]


def test_as_of_takes_the_last_row_before(spark):
    left = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("a", 9, "r"), ("b", 5, "s"), ("a", 5, "q")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 5, "x", 1), ("a", 7, "y", None), ("b", 6, "z", 3)], "k string, u int, state string, n int")
    got = market_state.as_of(left, right, ["k"], "t", "u", ["state", "n"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(
        map(str, [("a", 1, "p", None, None), ("a", 5, "q", "x", 1), ("a", 5, "q", "x", 1), ("a", 9, "r", "y", None), ("b", 5, "s", None, None)])
    )


def test_scores_by_state_and_year(spark):
    rows = [(dt.date(2023, 12, 30), 0.1, 0.2), (dt.date(2024, 1, 2), 0.3, -0.4), (dt.date(2024, 1, 5), None, 0.6)]
    scores = spark.createDataFrame(rows, "label_date date, ic double, rank_ic double")
    states = spark.createDataFrame([("ALL", "up", dt.date(2024, 1, 1)), ("ALL", "down", dt.date(2024, 1, 4))], "index_code string, state string, first_date date")
    got = {(r.year, r.state): (r.days, r.ic, r.rank_ic) for r in market_state.scores_by_state(scores, states).collect()}
    assert got[None, None][0] == 3 and got[2023, "none"] == (1, 0.1, 0.2) and got[2024, "down"] == (1, None, 0.6)
    np.testing.assert_allclose(got[2024, None], (2, 0.3, 0.1))


# --- baselines -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) * [1.0, 100.0, 0.01, 0.0] + [0.0, 5.0, -1.0, 2.0]
    y = x @ [0.5, -0.02, 30.0, 0.0] + 3.0 + rng.normal(size=400)
    part = rng.integers(0, 4, 400)
    rows = [(int(p), *map(float, v), float(t), k) for k, (p, v, t) in enumerate(zip(part, x, y, strict=True))]
    odd = [(0, None, 1.0, 1.0, 1.0, 1.0, 900), (1, 1.0, float("nan"), 1.0, 1.0, 1.0, 901), (None, 1.0, 1.0, 1.0, 1.0, 1.0, 902)]
    return spark.createDataFrame(rows + odd, "part int, a double, b double, c double, d double, y double, id long").repartition(7), x, y, part


def test_models_equal_direct_least_squares(regression):
    df, x, y, part = regression
    grams = baselines.gram_matrices(df, ["a", "b", "c", "d"], "y", F.col("part"))
    assert set(grams) == {"0", "1", "2", "3"} and sum(g[0, 0] for g in grams.values()) == 400
    for models, rows_of in (
        (baselines.leave_one_out(grams), lambda p: part != p),
        (baselines.walk_forward(grams), lambda p: part < p),
    ):
        for p, m in models.items():
            keep = rows_of(int(p))
            full = np.column_stack([np.ones(keep.sum()), x[keep][:, :3]])
            b, *_ = np.linalg.lstsq(full, y[keep], rcond=None)
            np.testing.assert_allclose([m.intercept, *m.coefficients], [*b, 0.0], atol=1e-7)
            np.testing.assert_allclose(m.residual_variance, np.mean((y[keep] - full @ b) ** 2))
    assert set(baselines.walk_forward(grams)) == {"1", "2", "3"}


def test_ridge_shrinks_scaled_coefficients(regression):
    df, x, y, _ = regression
    total = sum(baselines.gram_matrices(df, ["a", "b", "c"], "y", F.lit("all")).values())
    # the row without a part belongs to this one
    x, y = np.vstack([x[:, :3], [1.0, 1.0, 1.0]]), np.append(y, 1.0)
    z = (x - x.mean(0)) / x.std(0)
    b = np.linalg.solve(z.T @ z / len(z) + 0.7 * np.eye(3), z.T @ (y - y.mean()) / len(z)) / x.std(0)
    np.testing.assert_allclose(baselines.solve(total, 0.7).coefficients, b, rtol=1e-8)


def test_forecasts_are_scorable(spark, regression):
    from barloom.operators import scoring

    df, x, y, part = regression
    grams = baselines.gram_matrices(df, ["a", "b", "c", "d"], "y", F.col("part"))
    dated = df.withColumn("date", F.lit(DAY))
    preds = baselines.forecast(dated, baselines.leave_one_out(grams), ["a", "b", "c", "d"], F.col("part"), F.col("id").cast("string"), "date", "y")
    assert preds.count() == 403 and preds.where("y_pred is null").count() == 2
    assert scoring.date_rank_ic(preds.where("not isnan(y_pred)")).first().rank_ic > 0.8
    assert baselines.leave_one_out({}) == {} == baselines.walk_forward({})


def test_naive_forecasts(spark):
    bars = spark.createDataFrame([("a", day(k), 100.0 * 1.1**k) for k in range(12)], "ts_code string, date date, close double")
    rows = baselines.naive_forecasts(bars, horizon=2, window=3).where(F.col("label_date") == day(6)).collect()
    got = {r.rule: r for r in rows}
    np.testing.assert_allclose([got[r].y_pred for r in ("mean", "momentum", "reversal")], [0.2, 0.21, -0.21])
    np.testing.assert_allclose([got["mean"].y_true, got["mean"].pred_risk], [0.21, 0.0], atol=1e-12)


# --- health ----------------------------------------------------------------------------------


@pytest.mark.parametrize("exact", [True, False])
def test_health(spark, exact):
    rows = [("a", day(0), 1.0, "x"), ("a", day(0), None, None), ("b", day(0), float("nan"), "x"), ("a", day(40), 2.0, None), ("b", None, 1.0, "x"), ("b", None, 1.0, "x")]
    df = spark.createDataFrame(rows, "ts_code string, date date, price double, note string").repartition(3)
    got = {(r.level, r.period): (r["rows"], r["keys"], r.repeated, r.price_missing, r.note_missing) for r in health.panel_health(df, ["price", "note"], exact).collect()}
    assert got["all", None] == (6, 4, 2, 2 / 6, 2 / 6)
    assert got["day", day(0)] == (3, 2, 1, 2 / 3, 1 / 3) and got["month", dt.date(2024, 2, 1)] == (1, 1, 0, 0.0, 1.0)
    assert got["day", None][:3] == got["month", None][:3] == (2, 1, 1) and len(got) == 7


def test_health_scans_once(spark):
    df = spark.createDataFrame([("a", day(0), 1.0)], "ts_code string, date date, price double")
    plan = health.panel_health(df, ["price"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1
