"""Registered queries of the research operators: splits, evaluation, portfolios, baselines, data health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL
from barloom.functions.staging import stored
from barloom.operators import baselines, folds, health, market_state, performance, portfolio, scoring
from barloom.operators.targets import future_return
from barloom.plans import oracles as sql
from barloom.plans.catalog import KEYS, Query, _calendar, _features, _with_returns, metadata, preds, shown
from barloom.sources.sales_panel import predictions, supplier_panel, table

PLAN = folds.WalkForward(test_days=250, step_days=125, train_days=500, embargo_days=5)
QUANTILES = 5
HOLDING = (1, 5, 10)
COSTS = (0.0, 0.001, 0.005)
STATE_DAYS, STATE_BAND = 20, 0.005
PERIODS = 252
HORIZON, WINDOW = 5, 20
RIDGE_ALPHA = 0.1
RIDGE_FEATURES = ("ret_5", "oc_ratio")

# --- splits ----------------------------------------------------------------------------------


def _split_summary(spark, sf_dir):
    return shown(folds.split_summary(metadata(spark, sf_dir), "split"))


def _fold_ranges(spark, sf_dir):
    return shown(folds.fold_ranges(_calendar(spark, sf_dir), PLAN))


def _walk_forward(spark, sf_dir):
    calendar = _calendar(spark, sf_dir)
    rows = folds.in_folds(metadata(spark, sf_dir), folds.fold_ranges(calendar, PLAN), calendar)
    return shown(rows, ["fold", "role", "sample_id", "sequence_end_date", "label_date"])


def _fold_summary(spark, sf_dir):
    calendar = _calendar(spark, sf_dir)
    rows = folds.in_folds(metadata(spark, sf_dir), folds.fold_ranges(calendar, PLAN), calendar, whole_windows=True)
    return shown(folds.split_summary(rows, "fold", "role"))


_P = PLAN
RANGES = f"""last AS (SELECT max(pos) AS last FROM cal),
starts AS (SELECT unnest(range(0, (last - {_P.first_test_day}) // {_P.step_days} + 1)) AS fold, last FROM last),
ranges AS (
  SELECT fold, 'train' AS role,
         greatest({_P.first_test_day} + fold * {_P.step_days} - {_P.embargo_days} - {_P.train_days}, 0) AS first_pos,
         {_P.first_test_day} + fold * {_P.step_days} - 1 - {_P.embargo_days} AS last_pos FROM starts
  UNION ALL
  SELECT fold, 'test', {_P.first_test_day} + fold * {_P.step_days},
         least({_P.first_test_day} + fold * {_P.step_days} + {_P.test_days} - 1, last) FROM starts)"""
IN_FOLDS = f"""{sql.LABELLED}, {RANGES},
in_folds AS (
  SELECT m.*, r.fold, r.role, s.pos >= r.first_pos AS whole
  FROM metadata m JOIN cal e ON e.cal_date = m.sequence_end_date JOIN cal l ON l.cal_date = m.label_date
  JOIN cal s ON s.cal_date = m.sequence_start_date
  JOIN ranges r ON e.pos BETWEEN r.first_pos AND r.last_pos AND l.pos <= r.last_pos)"""
_SUMMARY = (
    "count(*) AS samples, min(sequence_end_date) AS first_date, max(sequence_end_date) AS last_date, max(label_date) AS last_label_date"
)

# --- scores by market state ------------------------------------------------------------------


def _index(spark, sf_dir) -> DataFrame:
    return market_state.index_returns(_with_returns(supplier_panel(spark, sf_dir)))


def _states(spark, sf_dir) -> DataFrame:
    return market_state.market_states(_index(spark, sf_dir), STATE_DAYS, STATE_BAND)


def _scores_by_state(spark, sf_dir):
    table_ = stored(preds(spark, sf_dir))
    days = scoring.date_ic(table_).drop("n").join(scoring.date_rank_ic(table_).drop("n"), "label_date")
    return shown(market_state.scores_by_state(days, _states(spark, sf_dir)))


STATES = f"""market AS (SELECT date, avg(ret_1) AS ret FROM rets GROUP BY date),
recent AS (
  SELECT date, CASE WHEN count(ret) OVER w >= {STATE_DAYS} THEN avg(ret) OVER w END AS mean FROM market
  WINDOW w AS (ORDER BY date ROWS BETWEEN {STATE_DAYS - 1} PRECEDING AND CURRENT ROW)),
labels AS (
  SELECT date, CASE WHEN mean > {STATE_BAND} THEN 'up' WHEN mean < -{STATE_BAND} THEN 'down' ELSE 'flat' END AS state
  FROM recent WHERE mean IS NOT NULL),
islands AS (
  SELECT state, min(date) AS first_date, max(date) AS last_date, count(*) AS days
  FROM (SELECT *, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY state ORDER BY date) AS g FROM labels)
  GROUP BY state, g)"""

# --- portfolios ------------------------------------------------------------------------------


def _quantile_returns(spark, sf_dir) -> DataFrame:
    return portfolio.quantile_returns(preds(spark, sf_dir), QUANTILES)


def _finite(c: str):
    return F.when(F.abs(c) < float("inf"), F.col(c))


def _wealth(spark, sf_dir):
    rows = _quantile_returns(spark, sf_dir).withColumn("log_wealth", _finite("log_wealth"))
    return shown(rows, ["label_date", "portfolio", "n", "ret", "log_wealth"])


def _monotonicity(spark, sf_dir):
    return shown(portfolio.monotonicity(_quantile_returns(spark, sf_dir)), ["rising", "steps", "monotone", "correlation"])


def _daily(spark, sf_dir) -> DataFrame:
    # predictions and returns read the bars
    calendar, bars = _calendar(spark, sf_dir), stored(supplier_panel(spark, sf_dir))
    named = predictions(bars).withColumn(SYMBOL, F.substring_index("sample_id", ":", 1))
    ahead = bars.select(SYMBOL, F.col(DATE).alias("cal_date"), future_return("close", 1).alias("ret"))
    returns = ahead.join(calendar.select("cal_date", "pos"), "cal_date").select(SYMBOL, "pos", "ret")
    held = portfolio.holdings(portfolio.cohorts(named, calendar, QUANTILES), HOLDING)
    return portfolio.daily_portfolio(held, returns, calendar)


def _cost_grid(spark, sf_dir):
    return shown(portfolio.cost_grid(_daily(spark, sf_dir), COSTS))


def _performance(spark, sf_dir):
    rows = _quantile_returns(spark, sf_dir)
    market = rows.where(F.col("portfolio") != portfolio.LONG_SHORT).groupBy("label_date").agg(F.avg("ret").alias("market"))
    days = _calendar(spark, sf_dir).select(F.col("cal_date").alias("label_date"), "pos")
    series = stored(rows.join(market, "label_date").join(days, "label_date").select("portfolio", "pos", "ret", "market"))
    out = performance.performance(series, ["portfolio"], PERIODS, benchmark="market")
    return shown(out.withColumn("log_growth", _finite("log_growth")))


def _exposure(spark, sf_dir):
    return shown(portfolio.volatility_exposure(preds(spark, sf_dir), QUANTILES))


GROUPED = f"""{sql.PREDS},
grouped AS (SELECT *, (place - 1) * {QUANTILES} // n + 1 AS q FROM ranked),
returns AS MATERIALIZED (
  SELECT label_date, 'q' || q AS portfolio, count(*) AS n, avg(y_true) AS ret FROM grouped GROUP BY label_date, q
  UNION ALL
  SELECT label_date, 'long_short', count(*) FILTER (q IN (1, {QUANTILES})), avg(y_true) FILTER (q = {QUANTILES}) - avg(y_true) FILTER (q = 1)
  FROM grouped GROUP BY label_date)"""
_SOFAR = "(PARTITION BY portfolio ORDER BY label_date ROWS UNBOUNDED PRECEDING)"
_LOG_WEALTH = f"CASE WHEN min(ret) OVER {_SOFAR} > -1 THEN sum(ln(greatest(1 + ret, 1e-300))) OVER {_SOFAR} END"
HELD = f"""{GROUPED}, {sql.CAL},
cohorts AS (
  SELECT c.pos, split_part(sample_id, ':', 1) AS ts_code, 1.0::DOUBLE / count(*) OVER (PARTITION BY label_date) AS w
  FROM grouped JOIN cal c ON c.cal_date = label_date WHERE q = {QUANTILES}),
spread AS (SELECT h, pos, ts_code, w, unnest(range(0, h)) AS j FROM cohorts, (SELECT unnest([{", ".join(map(str, HOLDING))}]) AS h)),
held AS MATERIALIZED (SELECT h, pos + j AS pos, ts_code, sum(w / h) AS w FROM spread GROUP BY ALL),
moved AS (
  SELECT coalesce(a.h, b.h) AS h, coalesce(a.pos, b.pos + 1) AS pos, coalesce(a.ts_code, b.ts_code) AS ts_code,
         coalesce(a.w, 0.0) AS w, coalesce(b.w, 0.0) AS before
  FROM held a FULL JOIN held b ON b.h = a.h AND b.ts_code = a.ts_code AND b.pos + 1 = a.pos),
ahead AS (SELECT b.ts_code, c.pos, lead(close) OVER ({sql.SYM}) / close - 1 AS ret FROM bars b JOIN cal c ON c.cal_date = b.date),
daily AS MATERIALIZED (
  SELECT h AS holding, c.cal_date AS date, count(*) FILTER (w > 0) AS names, count(*) FILTER (w > 0 AND before > 0) AS kept,
         sum(abs(w - before)) / 2 AS turnover, sum(w * coalesce(ret, 0.0)) AS gross
  FROM moved m JOIN cal c ON c.pos = m.pos LEFT JOIN ahead r ON r.ts_code = m.ts_code AND r.pos = m.pos GROUP BY h, c.cal_date)"""

# --- baselines and health --------------------------------------------------------------------


def _naive(spark, sf_dir):
    rows = baselines.naive_forecasts(supplier_panel(spark, sf_dir), HORIZON, WINDOW)
    return shown(rows)


def _ridge(spark, sf_dir):
    panel = _features(spark, sf_dir).withColumn("y", future_return("close", HORIZON))
    panel = stored(panel.select(*KEYS, *RIDGE_FEATURES, "y"))
    year, sample = F.year(DATE), F.concat_ws(":", SYMBOL, F.col(DATE).cast("string"))
    grams = baselines.gram_matrices(panel, RIDGE_FEATURES, "y", year)
    return shown(baselines.forecast(panel, baselines.leave_one_out(grams, RIDGE_ALPHA), RIDGE_FEATURES, year, sample, DATE, "y"))


def _lines(spark, sf_dir) -> DataFrame:
    """Order lines as bars with repeated keys; prices of small lots and volumes of returned lots are missing."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias(SYMBOL), F.to_date("l_shipdate").alias(DATE),
        F.when(F.col("l_quantity") >= 5, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("volume"),
    )


def _health(spark, sf_dir):
    return shown(health.panel_health(_lines(spark, sf_dir), ["price", "volume"]))


def _health_by_sketch(spark, sf_dir):
    """Whether the sketches' keys lie within a tenth of the exact ones, or 3, for every period."""
    rows = _lines(spark, sf_dir)
    quick = health.panel_health(rows, [], exact=False).select("level", "period", F.col("keys").alias("estimate"))
    exact = health.panel_health(rows, []).select("level", F.coalesce("period", F.lit("1970-01-01").cast("date")).alias("period"), "rows", "keys")
    quick = quick.withColumn("period", F.coalesce("period", F.lit("1970-01-01").cast("date")))
    near = F.abs(F.col("estimate") - F.col("keys")) <= F.greatest(F.lit(3.0), F.col("keys") * 0.1)
    return shown(exact.join(quick, ["level", "period"]).select("level", "period", "rows", near.alias("near")))


HEALTH = """keyed AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ts_code, CAST(l_shipdate AS DATE) AS day, count(*) AS n,
         count(*) FILTER (l_quantity < 5) AS no_price, count(*) FILTER (l_returnflag = 'R') AS no_volume FROM lineitem GROUP BY ALL),
health AS (
  SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(month) = 0 THEN 'month' ELSE 'all' END AS level, coalesce(day, month) AS period,
         CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(n) AS BIGINT) - count(*) AS repeated,
         sum(no_price) / sum(n) AS price_missing, sum(no_volume) / sum(n) AS volume_missing
  FROM (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month FROM keyed) GROUP BY GROUPING SETS ((), (month), (month, day)))"""


def _register() -> dict[str, tuple[Query, str]]:
    r = sql.r
    found: dict[str, tuple[Query, str]] = {}
    found["R1_panel_health"] = (
        _health,
        f"WITH {HEALTH} SELECT level, period, rows, keys, repeated, {r('price_missing')} AS price_missing, {r('volume_missing')} AS volume_missing FROM health",
    )
    found["R1_health_by_sketch"] = (
        _health_by_sketch,
        f"WITH {HEALTH} SELECT level, coalesce(period, DATE '1970-01-01') AS period, rows, TRUE AS near FROM health",
    )
    found["R2_split_summary"] = (_split_summary, f"WITH {sql.LABELLED} SELECT split, {_SUMMARY} FROM metadata GROUP BY split")
    found["R3_fold_ranges"] = (
        _fold_ranges,
        f"WITH {sql.CAL}, {RANGES} SELECT fold, role, first_pos, last_pos, a.cal_date AS first_date, b.cal_date AS last_date "
        "FROM ranges JOIN cal a ON a.pos = first_pos JOIN cal b ON b.pos = last_pos",
    )
    found["R3_walk_forward"] = (_walk_forward, f"WITH {IN_FOLDS} SELECT fold, role, sample_id, sequence_end_date, label_date FROM in_folds")
    found["R3_fold_summary"] = (_fold_summary, f"WITH {IN_FOLDS} SELECT fold, role, {_SUMMARY} FROM in_folds WHERE whole GROUP BY fold, role")
    found["R4_market_states"] = (
        lambda s, d: shown(_states(s, d), ["state", "first_date", "last_date", "days"]),
        f"WITH {sql.RETS}, {STATES} SELECT state, first_date, last_date, days FROM islands",
    )
    found["R4_scores_by_state"] = (
        _scores_by_state,
        f"WITH {sql.PREDS}, {STATES}, dated AS (SELECT year(label_date) AS year, coalesce(state, 'none') AS state, ic, rank_ic "
        "FROM ics ASOF LEFT JOIN islands ON label_date >= first_date) "
        f"SELECT year, state, count(*) AS days, {r('avg(ic)')} AS ic, {r('stddev_pop(ic)')} AS ic_std, {r('avg(rank_ic)')} AS rank_ic, "
        f"{r('stddev_pop(rank_ic)')} AS rank_ic_std, {r('avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END)')} AS rank_ic_positive "
        "FROM dated GROUP BY GROUPING SETS ((year, state), (year), (state), ())",
    )
    found["R5_quantile_returns"] = (
        _wealth,
        f"WITH {GROUPED} SELECT label_date, portfolio, n, {r('ret')} AS ret, {r('w')} AS log_wealth FROM (SELECT *, {_LOG_WEALTH} AS w FROM returns)",
    )
    found["R5_monotonicity"] = (
        _monotonicity,
        f"WITH {GROUPED}, means AS (SELECT CAST(substr(portfolio, 2) AS INTEGER) AS q, avg(ret) AS m FROM returns WHERE portfolio <> 'long_short' GROUP BY q), "
        "steps AS (SELECT m > lag(m) OVER (ORDER BY q) AS up FROM means) "
        f"SELECT count(*) FILTER (up) AS rising, count(up) AS steps, count(*) FILTER (up) = count(up) AS monotone, (SELECT {r('corr(q, m)')} FROM means) AS correlation FROM steps",
    )
    found["R6_daily_portfolio"] = (
        lambda s, d: shown(_daily(s, d)),
        f"WITH {HELD} SELECT holding, date, names, kept, {r('turnover')} AS turnover, {r('gross')} AS gross FROM daily",
    )
    net = "(gross - cost * turnover)"
    found["R6_cost_grid"] = (
        _cost_grid,
        f"WITH {HELD} SELECT holding, cost, count(*) AS days, {r('avg(turnover)')} AS turnover, {r('avg(gross)')} AS gross, {r(f'avg({net})')} AS net, "
        f"{r(f'stddev_pop({net})')} AS net_std, {r(f'avg(CASE WHEN {net} > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_ratio "
        f"FROM daily, (SELECT unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in COSTS)}]) AS cost) GROUP BY holding, cost",
    )
    root = f"sqrt({float(PERIODS)})"
    found["R7_performance"] = (
        _performance,
        f"WITH {GROUPED}, market AS (SELECT label_date, avg(ret) AS market FROM returns WHERE portfolio <> 'long_short' GROUP BY label_date), "
        f"path AS (SELECT portfolio, label_date, ret, market, sum(ln(greatest(1 + ret, 1e-300))) OVER {_SOFAR} AS wealth FROM returns JOIN market USING (label_date)), "
        f"peaks AS (SELECT *, greatest(max(wealth) OVER {_SOFAR}, 0) AS peak FROM path) "
        f"SELECT portfolio, count(*) AS n, {r('avg(ret)')} AS mean, {r(f'stddev_samp(ret) * {root}')} AS volatility, {r(f'avg(ret) / stddev_samp(ret) * {root}')} AS sharpe, "
        f"{r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_ratio, {r(f'avg(ret - market) / stddev_samp(ret - market) * {root}')} AS information_ratio, "
        f"{r('exp(least(min(wealth - peak), 0)) - 1')} AS max_drawdown, {r('CASE WHEN min(ret) > -1 THEN arg_max(wealth, label_date) END')} AS log_growth FROM peaks GROUP BY portfolio",
    )
    found["R7_volatility_exposure"] = (
        _exposure,
        f"WITH {GROUPED} SELECT label_date, n, {r('t')} AS top, {r('b')} AS bottom, {r('(t - b) / nullif(s, 0)')} AS tilt FROM (SELECT label_date, count(*) AS n, "
        f"avg(sqrt(pred_risk)) FILTER (q = {QUANTILES}) AS t, avg(sqrt(pred_risk)) FILTER (q = 1) AS b, stddev_pop(sqrt(pred_risk)) AS s FROM grouped GROUP BY label_date)",
    )
    past = f"(close / {sql.lag('close', HORIZON)} - 1)"
    risk = sql.std("ret", WINDOW)
    found["R8_naive_forecasts"] = (
        _naive,
        f"WITH {sql.BARS}, plain AS (SELECT *, close / {sql.lag('close')} - 1 AS ret FROM bars), "
        f"made AS (SELECT ts_code || ':' || CAST(date AS VARCHAR) AS sample_id, date AS label_date, {sql.ahead_ret(HORIZON)} AS y_true, "
        f"{risk} * {risk} AS pred_risk, {sql.full('avg', 'ret', WINDOW)} * {float(HORIZON)} AS a, {past} AS b, -{past} AS c FROM plain) "
        + " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, sample_id, label_date, {r('y_true')} AS y_true, {r('pred_risk')} AS pred_risk, {r(x)} AS y_pred FROM made"
            for rule, x in (("mean", "a"), ("momentum", "b"), ("reversal", "c"))
        ),
    )
    x1, x2 = (sql.base_columns((5,), (5,))[c] for c in RIDGE_FEATURES)
    sums = "count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(y) AS sy, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab, sum(a * y) AS say, sum(b * y) AS sby, sum(y * y) AS syy"
    names = ("n", "sa", "sb", "sy", "saa", "sbb", "sab", "say", "sby", "syy")
    cov = lambda xy, x, y: f"({xy} / n - {x} / n * {y} / n)"
    found["R9_ridge_forecasts"] = (
        _ridge,
        f"WITH {sql.FREE_RETS}, f AS MATERIALIZED (SELECT ts_code, date, year(date) AS part, {x1} AS a, {x2} AS b, {sql.ahead_ret(HORIZON)} AS y FROM rets), "
        f"parts AS MATERIALIZED (SELECT part, {sums} FROM f WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL GROUP BY part), "
        f"rest AS (SELECT p.part, {', '.join(f'(SELECT sum({c}) FROM parts) - p.{c} AS {c}' for c in names)} FROM parts p), "
        f"m AS (SELECT part, sa / n AS ma, sb / n AS mb, sy / n AS my, {cov('saa', 'sa', 'sa')} AS vaa, {cov('sbb', 'sb', 'sb')} AS vbb, {cov('sab', 'sa', 'sb')} AS vab, "
        f"{cov('say', 'sa', 'sy')} AS vay, {cov('sby', 'sb', 'sy')} AS vby, {cov('syy', 'sy', 'sy')} AS vyy FROM rest), "
        f"u AS (SELECT *, vab / sqrt(vaa * vbb) AS rho, vay / sqrt(vaa) AS ra, vby / sqrt(vbb) AS rb, 1 + {RIDGE_ALPHA} AS d FROM m), "
        "c AS (SELECT *, (ra * d - rho * rb) / (d * d - rho * rho) / sqrt(vaa) AS ka, (rb * d - rho * ra) / (d * d - rho * rho) / sqrt(vbb) AS kb FROM u) "
        f"SELECT ts_code || ':' || CAST(date AS VARCHAR) AS sample_id, date AS label_date, {r('my - ka * ma - kb * mb + ka * a + kb * b')} AS y_pred, {r('y')} AS y_true, "
        f"{r('vyy - 2 * (ka * vay + kb * vby) + ka * ka * vaa + 2 * ka * kb * vab + kb * kb * vbb')} AS pred_risk FROM f LEFT JOIN c USING (part)",
    )
    return found


_FOUND = _register()
QUERIES: dict[str, Query] = {name: query for name, (query, _) in _FOUND.items()}
ORACLES: dict[str, str] = {name: oracle for name, (_, oracle) in _FOUND.items()}
