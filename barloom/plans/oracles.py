"""DuckDB SQL for every registered query that SQL can express, written independently of the Spark
code: plain windows, joins and, for the recursive indicators, recursive CTEs over the row number."""

from __future__ import annotations

import math

ORDER_KEY = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
SYM = "PARTITION BY ts_code ORDER BY date"

BARS = f"""lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ts_code, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice / l_quantity AS price, *
  FROM lineitem),
raw AS (
  SELECT ts_code, date,
         first(price ORDER BY {ORDER_KEY}) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY {ORDER_KEY}) AS close,
         sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lines GROUP BY ts_code, date),
bars AS MATERIALIZED (
  SELECT *, lag(close) OVER ({SYM}) AS pre_close, row_number() OVER ({SYM}) AS rn FROM raw)"""

MEMBER_YEARS = """member_years AS (
  SELECT year(min(l_shipdate)) + 1 AS a, year(max(l_shipdate)) AS b FROM lineitem)"""

SNAPS = """yearly AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS con_code, year(CAST(l_shipdate AS DATE)) AS y,
         sum(l_extendedprice) AS sales FROM lineitem GROUP BY 1, 2),
levels AS (SELECT y, avg(sales) AS lvl FROM yearly GROUP BY y),
firsts AS (
  SELECT year(CAST(l_shipdate AS DATE)) - 1 AS y, min(CAST(l_shipdate AS DATE)) AS trade_date
  FROM lineitem GROUP BY 1),
snaps AS (
  SELECT '399300.SZ' AS index_code, f.trade_date, a.con_code
  FROM yearly a JOIN levels l USING (y) JOIN firsts f USING (y) WHERE a.sales > l.lvl)"""

# intervals from any snapshot table ``snaps``, for the years with constituents
SPANS = f"""{MEMBER_YEARS},
placed AS (
  SELECT DISTINCT index_code, trade_date AS snap,
         CASE WHEN year(trade_date) = (SELECT a - 1 FROM member_years) AND month(trade_date) >= 11
              THEN year(trade_date) + 1
              ELSE year(trade_date) END AS period
  FROM snaps),
spans AS (
  SELECT *, lead(snap) OVER (PARTITION BY index_code, period ORDER BY snap) AS next_in,
         lead(snap) OVER (PARTITION BY index_code ORDER BY snap) AS next_any,
         lead(period) OVER (PARTITION BY index_code ORDER BY snap) AS next_period
  FROM placed WHERE period BETWEEN (SELECT a FROM member_years) AND (SELECT b FROM member_years)),
days AS (
  SELECT index_code, snap, snap AS start_date,
         coalesce(next_in - 1, make_date(period, 12, 31)) AS end_date FROM spans
  UNION ALL
  SELECT index_code, snap, snap + 1, next_any - 1 FROM spans WHERE next_period = period + 1),
intervals AS (
  SELECT d.index_code, s.con_code AS symbol, d.start_date, d.end_date
  FROM days d JOIN snaps s ON s.index_code = d.index_code AND s.trade_date = d.snap)"""
INTERVALS = f"{SNAPS},\n{SPANS}"

UNIVERSE = f"""{BARS}, {INTERVALS},
panel AS MATERIALIZED (
  SELECT b.*, EXISTS (SELECT 1 FROM intervals i
                      WHERE i.symbol = b.ts_code AND b.date BETWEEN i.start_date AND i.end_date)
              AS in_csi300
  FROM bars b)"""

CAL = """cal AS (
  SELECT d AS cal_date, row_number() OVER (ORDER BY d) - 1 AS pos
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem))"""


EXACT = ("open", "high", "low", "close", "volume", "pre_close", "bars.close")


def r(x: str) -> str:
    """Round for hashing: absolute for ordinary values, coarser for very large ones.

    Bar columns stay as they are: one division or a sum of whole numbers is exact everywhere, while
    rounding a short decimal can meet a tie."""
    if x in EXACT:
        return x
    x = f"CAST({x} AS DOUBLE)"
    return (
        f"CASE WHEN abs({x}) < 1e3 THEN round({x}, 6) WHEN abs({x}) < 1e6 THEN round({x}, 3) "
        f"WHEN abs({x}) < 1e9 THEN round({x}, 0) ELSE round({x}, -4) END + 0.0"
    )


def rd(x: str, digits: int) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def over(n: int) -> str:
    return f"OVER ({SYM} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {over(n)} >= {n} THEN {agg}({x}) {over(n)} END)"


def std(x: str, n: int, agg: str = "stddev_samp") -> str:
    return (
        f"(CASE WHEN count({x}) {over(n)} >= {n} THEN CASE WHEN max({x}) {over(n)} = min({x}) {over(n)} "
        f"THEN 0.0 ELSE {agg}({x}) {over(n)} END END)"
    )


def safe(a: str, b: str) -> str:
    return f"(({a}) / (abs({b}) + 1e-12))"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SYM})"


def zscore(x: str, n: int) -> str:
    s = std(x, n)
    return f"(CASE WHEN {s} = 0 THEN 0.0 ELSE ({x} - {full('avg', x, n)}) / ({s} + 1e-12) END)"


def listed(columns: dict[str, str], digits: int | None = None) -> str:
    show = (lambda v: rd(v, digits) if v not in EXACT else v) if digits else r
    return ", ".join(f"{show(sql)} AS {name}" for name, sql in columns.items())


def picked(
    ctes: str,
    columns: dict[str, str],
    source: str,
    keys: str = "ts_code, date",
    digits: int | None = None,
) -> str:
    body = listed(columns, digits)
    return f"WITH RECURSIVE {ctes} SELECT {keys}, {body} FROM {source}"


# --- base features ---------------------------------------------------------------------------

def _rets(source: str, clipped: bool = True) -> str:
    value = "greatest(-0.2, least(0.2, raw_ret))" if clipped else "raw_ret"
    return f"""rets AS MATERIALIZED (
  SELECT *, CASE WHEN ret_1 < 0 THEN ret_1 ELSE 0.0 END AS loss
  FROM (SELECT *, CASE WHEN raw_ret IS NOT NULL THEN {value} END AS ret_1
        FROM (SELECT *, close / {lag('close')} - 1 AS raw_ret FROM {source})))"""


RETS = f"{BARS},\n{_rets('bars')}"
FREE_RETS = f"{BARS},\n{_rets('bars', False)}"


def base_columns(price=(5, 10, 20), vol=(5, 10, 20)) -> dict[str, str]:
    out = {
        "ret_1": "ret_1",
        "log_ret_1": f"ln(close / {lag('close')})",
        "oc_ratio": safe("close - open", "open"),
        "hl_ratio": safe("high - low", "close"),
        "co_gap": safe("open - pre_close", "pre_close"),
    }
    for w in price:
        low, high = full("min", "low", w), full("max", "high", w)
        out[f"ret_{w}"] = f"close / {lag('close', w)} - 1"
        out[f"ma_ratio_{w}"] = safe("close", full("avg", "close", w)) + " - 1"
        out[f"price_pos_{w}"] = safe(f"close - {low}", f"{high} - {low}")
    for w in vol:
        mean = full("avg", "ret_1", w)
        out[f"volatility_{w}"] = std("ret_1", w)
        out[f"volume_ma_ratio_{w}"] = safe("volume", full("avg", "volume", w)) + " - 1"
        out[f"sharpe_like_{w}"] = safe(mean, std("ret_1", w))
        out[f"sortino_like_{w}"] = safe(mean, std("loss", w))
        out[f"drawdown_{w}"] = safe("close", full("max", "close", w)) + " - 1"
    return out


def base_query(names: list[str]) -> str:
    available = base_columns()
    return picked(RETS, {n: available[n] for n in names}, "rets")


# --- calendar --------------------------------------------------------------------------------


def _cyclic(name: str, position: str, period: float) -> dict[str, str]:
    angle = f"({2 * math.pi!r} * ({position}) / {float(period)!r})"
    return {f"{name}_sin": f"sin({angle})", f"{name}_cos": f"cos({angle})"}


CALENDAR = {
    **_cyclic("dow", "isodow(date) - 1", 5),
    **_cyclic("month", "month(date) - 1", 12),
    **_cyclic("doy", "dayofyear(date)", 365),
    **_cyclic("dom", "day(date) - 1", 31),
    "is_month_start": "CASE WHEN day(date) = 1 THEN 1 ELSE 0 END",
    "is_month_end": "CASE WHEN date = last_day(date) THEN 1 ELSE 0 END",
    "is_quarter_start": "CASE WHEN day(date) = 1 AND month(date) IN (1, 4, 7, 10) THEN 1 ELSE 0 END",
    "is_quarter_end": "CASE WHEN date = last_day(date) AND month(date) IN (3, 6, 9, 12) THEN 1 ELSE 0 END",
    "is_year_start": "CASE WHEN day(date) = 1 AND month(date) = 1 THEN 1 ELSE 0 END",
    "is_year_end": "CASE WHEN day(date) = 31 AND month(date) = 12 THEN 1 ELSE 0 END",
    "gap_days": f"greatest(coalesce(date - {lag('date')}, 1), 1)",
}
WEEKLY = {
    **_cyclic("dow", "isodow(date) - 1", 7),
    **_cyclic("month", "month(date)", 12),
    **_cyclic("doy", "dayofyear(date)", 365.25),
}

# --- window indicators -----------------------------------------------------------------------

INDICATOR_INPUT = f"""{BARS},
priced AS (
  SELECT *, (high + low + close) / 3.0 AS tp, close - {lag('close')} AS step,
         coalesce(((close - low) - (high - close)) / nullif(high - low, 0) * volume, 0.0) AS mfv
  FROM bars),
flows AS (
  SELECT *, CASE WHEN tp > {lag('tp')} THEN 1.0 WHEN tp < {lag('tp')} THEN -1.0 ELSE 0.0 END
            * tp * volume AS flow,
         100.0 * (close - {full('min', 'low', 14)})
            / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0) AS k
  FROM priced),
inp AS MATERIALIZED (
  SELECT *, greatest(flow, 0.0) AS gain, greatest(-flow, 0.0) AS lost,
         {full('avg', 'tp', 20)} AS tp_mean
  FROM flows)"""


def _mean_deviation(n: int) -> str:
    terms = ["abs(tp - tp_mean)", *[f"abs({lag('tp', i)} - tp_mean)" for i in range(1, n)]]
    return f"(({' + '.join(terms)}) / {n})"


_MID, _BAND = full("avg", "close", 20), f"2.0 * {std('close', 20, 'stddev_pop')}"
_POS, _NEG = full("sum", "gain", 14), full("sum", "lost", 14)
INDICATORS = {
    "roc_10": f"100.0 * (close - {lag('close', 10)}) / {lag('close', 10)}",
    "willr_14": f"-100.0 * ({full('max', 'high', 14)} - close) / nullif({full('max', 'high', 14)} - {full('min', 'low', 14)}, 0)",
    "stoch_k_14": "k",
    "stoch_d_14": full("avg", "k", 3),
    "cci_20": f"(tp - tp_mean) / nullif(0.015 * {_mean_deviation(20)}, 0)",
    "bb_h": f"{_MID} + {_BAND}",
    "bb_l": f"{_MID} - {_BAND}",
    "bb_m": _MID,
    "bb_width": safe(f"2.0 * {_BAND}", _MID),
    "bb_pos": safe(f"close - ({_MID} - {_BAND})", f"2.0 * {_BAND}"),
    "obv": f"sum(CASE WHEN step < 0 THEN -volume ELSE volume END) OVER ({SYM} ROWS UNBOUNDED PRECEDING)",
    "cmf_20": f"{full('sum', 'mfv', 20)} / nullif({full('sum', 'volume', 20)}, 0)",
    "mfi_14": f"CASE WHEN {_NEG} = 0 AND {_POS} > 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {_POS} / nullif({_NEG}, 0)) END",
    "er_10": f"abs(close - {lag('close', 10)}) / nullif({full('sum', 'abs(step)', 10)}, 0)",
}


def indicator_query(names: list[str], digits: int | None = None) -> str:
    # the typical price mean is a column, so nested windows never occur
    source = "(SELECT *, " + ", ".join(f"{INDICATORS[n]} AS out_{n}" for n in names) + " FROM inp)"
    return picked(INDICATOR_INPUT, {n: f"out_{n}" for n in names}, source, digits=digits)


# --- recursive indicators --------------------------------------------------------------------

_NEXT = "FROM {0} p JOIN {1} b ON b.ts_code = p.ts_code AND b.rn = p.rn + 1"

MOVES = f"""
moves AS MATERIALIZED (
  SELECT ts_code, date, rn, high, low, close,
         greatest(coalesce(close - {lag('close')}, 0), 0) AS g,
         greatest(coalesce({lag('close')} - close, 0), 0) AS l,
         greatest(high - low, coalesce(abs(high - {lag('close')}), 0),
                  coalesce(abs(low - {lag('close')}), 0)) AS tr,
         high - {lag('high')} AS up, {lag('low')} - low AS down
  FROM bars)"""
CHANGES = f"{BARS},{MOVES}"

RSI_PART = f"""{MOVES},
rec_rsi(ts_code, rn, ag, al) AS (
  SELECT ts_code, rn, CAST(g AS DOUBLE), CAST(l AS DOUBLE) FROM moves WHERE rn = 1
  UNION ALL
  SELECT b.ts_code, b.rn, b.g / 14 + p.ag * 13 / 14, b.l / 14 + p.al * 13 / 14
  {_NEXT.format('rec_rsi', 'moves')}),
rsi AS (SELECT ts_code, rn, CASE WHEN rn < 14 THEN NULL WHEN al = 0 THEN 100.0
               ELSE 100.0 - 100.0 / (1.0 + ag / al) END AS rsi_14 FROM rec_rsi)"""
RSI = f"{BARS},{RSI_PART}"

MACD = f"""{BARS},
rec(ts_code, rn, f, s, sig) AS (
  SELECT ts_code, rn, close, close, CAST(NULL AS DOUBLE) FROM bars WHERE rn = 1
  UNION ALL
  SELECT ts_code, rn, nf, ns, CASE WHEN rn < 26 THEN NULL WHEN rn = 26 THEN nf - ns
                                   ELSE 0.2 * (nf - ns) + 0.8 * sig END
  FROM (SELECT b.ts_code, b.rn, b.close * 2 / 13 + p.f * 11 / 13 AS nf,
               b.close * 2 / 27 + p.s * 25 / 27 AS ns, p.sig {_NEXT.format('rec', 'bars')})),
macd AS (SELECT ts_code, rn, CASE WHEN rn >= 26 THEN f - s END AS macd,
                CASE WHEN rn >= 34 THEN sig END AS macd_signal,
                CASE WHEN rn >= 34 THEN f - s - sig END AS macd_hist FROM rec)"""


def _atr(n: int) -> str:
    return f"""{CHANGES},
rec(ts_code, rn, atr) AS (
  SELECT ts_code, {n}, avg(tr) FROM moves WHERE rn <= {n} GROUP BY ts_code HAVING count(*) = {n}
  UNION ALL
  SELECT b.ts_code, b.rn, (p.atr * {n - 1} + b.tr) / {n} {_NEXT.format('rec', 'moves')})"""


ADX = f"""{CHANGES},
dm AS MATERIALIZED (
  SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pdm,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mdm FROM moves WHERE rn >= 2),
rec(ts_code, rn, t, p, m) AS (
  SELECT ts_code, rn, CAST(tr AS DOUBLE), CAST(pdm AS DOUBLE), CAST(mdm AS DOUBLE) FROM dm WHERE rn = 2
  UNION ALL
  SELECT b.ts_code, b.rn, b.tr / 14 + p.t * 13 / 14, b.pdm / 14 + p.p * 13 / 14,
         b.mdm / 14 + p.m * 13 / 14 {_NEXT.format('rec', 'dm')}),
dx AS MATERIALIZED (
  SELECT ts_code, rn, 100.0 * abs(p / t - m / t) / nullif(p / t + m / t, 0) AS dx FROM rec WHERE rn >= 15),
rec2(ts_code, rn, adx) AS (
  SELECT ts_code, 28, avg(dx) FROM dx WHERE rn <= 28 GROUP BY ts_code HAVING count(dx) = 14
  UNION ALL
  SELECT b.ts_code, b.rn, (p.adx * 13 + b.dx) / 14 {_NEXT.format('rec2', 'dx')})"""

SUPERTREND = f"""{_atr(10)},
bands AS MATERIALIZED (
  SELECT m.ts_code, m.rn, m.close, (m.high + m.low) / 2 + 3.0 * rec.atr AS u,
         (m.high + m.low) / 2 - 3.0 * rec.atr AS l
  FROM moves m JOIN rec USING (ts_code, rn)),
st(ts_code, rn, u, l, d) AS (
  SELECT ts_code, rn, u, l, 1.0 FROM bands WHERE rn = 10
  UNION ALL
  SELECT ts_code, rn,
         CASE WHEN held AND d < 0 THEN least(u, pu) ELSE u END,
         CASE WHEN held AND d > 0 THEN greatest(l, pl) ELSE l END, d
  FROM (SELECT b.ts_code, b.rn, b.u, b.l, p.u AS pu, p.l AS pl,
               b.close <= p.u AND b.close >= p.l AS held,
               CASE WHEN b.close > p.u THEN 1.0 WHEN b.close < p.l THEN -1.0 ELSE p.d END AS d
        {_NEXT.format('st', 'bands')}))"""

KDJ = f"""{BARS},
rsv AS MATERIALIZED (
  SELECT ts_code, rn, 100.0 * (close - lo) / nullif(hi - lo, 0) AS v
  FROM (SELECT *, {full('min', 'low', 9)} AS lo, {full('max', 'high', 9)} AS hi FROM bars) WHERE rn >= 9),
rec(ts_code, rn, k, d) AS (
  SELECT ts_code, rn, v, CAST(NULL AS DOUBLE) FROM rsv WHERE rn = 9
  UNION ALL
  SELECT ts_code, rn, k, CASE WHEN rn < 11 THEN NULL WHEN rn = 11 THEN k ELSE k / 3 + d * 2 / 3 END
  FROM (SELECT b.ts_code, b.rn, b.v / 3 + p.k * 2 / 3 AS k, p.d {_NEXT.format('rec', 'rsv')})),
kdj AS (SELECT ts_code, rn, CASE WHEN rn >= 11 THEN k END AS k, CASE WHEN rn >= 13 THEN d END AS d FROM rec)"""


def recursive_query(
    ctes: str, joined: str, columns: dict[str, str], digits: int | None = None
) -> str:
    body = listed(columns, digits)
    return (
        f"WITH RECURSIVE {ctes} SELECT bars.ts_code, bars.date, {body} "
        f"FROM bars LEFT JOIN {joined} j ON j.ts_code = bars.ts_code AND j.rn = bars.rn"
    )


# --- cross-section ---------------------------------------------------------------------------

DAY = "PARTITION BY date"


def cs_rank(x: str, pct: bool = True) -> str:
    """Average rank by counting, not by a rank function."""
    order = f"OVER ({DAY} ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    first = f"rank() OVER ({DAY} ORDER BY {x} NULLS LAST)"
    mean = f"({first} + count({x}) {order}) / 2.0"
    scaled = f"({mean}) / count({x}) OVER ({DAY})" if pct else mean
    return f"CASE WHEN {x} IS NOT NULL THEN {scaled} END"


def cs_z(x: str) -> str:
    s = f"(CASE WHEN max({x}) OVER ({DAY}) = min({x}) OVER ({DAY}) AND count({x}) OVER ({DAY}) > 1 THEN 0.0 ELSE stddev_samp({x}) OVER ({DAY}) END)"
    z = f"({x} - avg({x}) OVER ({DAY})) / ({s} + 1e-12)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {s} = 0 THEN 0.0 ELSE {z} END"


UNIVERSE_RETS = f"{UNIVERSE},\n{_rets('panel')}"
FREE_UNIVERSE_RETS = f"{UNIVERSE},\n{_rets('panel', False)}"


# --- targets ---------------------------------------------------------------------------------


def ahead_std(x: str, h: int) -> str:
    w = f"OVER ({SYM} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return (
        f"CASE WHEN count({x}) {w} = {h} THEN CASE WHEN max({x}) {w} = min({x}) {w} THEN 0.0 "
        f"ELSE stddev_pop({x}) {w} END END"
    )


def ahead_ret(h: int) -> str:
    return f"lead(close, {h}) OVER ({SYM}) / close - 1"


# --- samples ---------------------------------------------------------------------------------

SPLITS = {"train": (1995, 1998), "evaluate": (1999, 1999), "test": (2000, 2001)}
LENGTH, STRIDE, MAX_SKIP, MAX_GAPS = 10, 3, 12, 9
TARGETS = ("y_ret_1", "y_risk_vol_1", "y_ret_5", "y_risk_vol_5")


def split_case(date: str) -> str:
    arms = " ".join(
        f"WHEN year({date}) BETWEEN {a} AND {b} THEN '{name}'" for name, (a, b) in SPLITS.items()
    )
    return f"CASE {arms} END"


LABELLED = f"""{UNIVERSE_RETS},
scored AS (
  SELECT *, CASE WHEN in_csi300 THEN ret_1 END AS member_ret FROM rets),
labelled AS MATERIALIZED (
  SELECT *, {ahead_ret(1)} AS y_ret_1, CAST({ahead_std('ret_1', 1)} AS FLOAT) AS y_risk_vol_1,
         {ahead_ret(5)} AS y_ret_5, CAST({ahead_std('ret_1', 5)} AS FLOAT) AS y_risk_vol_5,
         {cs_rank('member_ret')} AS ret_1_cs_rank, {cs_z('member_ret')} AS ret_1_cs_z
  FROM scored),
{CAL},
placed_rows AS (
  SELECT l.*, c.pos, row_number() OVER (PARTITION BY l.ts_code ORDER BY l.date) - 1 AS idx
  FROM labelled l LEFT JOIN cal c ON c.cal_date = l.date),
steps AS (SELECT *, pos - lag(pos) OVER ({SYM}) - 1 AS skipped FROM placed_rows),
windows AS MATERIALIZED (
  SELECT *, lag(date, {LENGTH - 1}) OVER ({SYM}) AS start_date,
         idx >= {LENGTH - 1} AND (idx - {LENGTH - 1}) % {STRIDE} = 0 AS is_anchor,
         max(skipped) OVER st <= {MAX_SKIP}
           AND sum(CASE WHEN skipped > 0 THEN 1 ELSE 0 END) OVER st <= {MAX_GAPS}
           AND sum(CASE WHEN skipped IS NULL OR skipped < 0 THEN 1 ELSE 0 END) OVER st = 0 AS gap_ok
  FROM steps
  WINDOW st AS ({SYM} ROWS BETWEEN {LENGTH - 2} PRECEDING AND CURRENT ROW)),
dated AS MATERIALIZED (
  SELECT w.* EXCLUDE (y_ret_1, y_risk_vol_1, y_ret_5, y_risk_vol_5),
         c1.cal_date AS label_date_1, c5.cal_date AS label_date_5,
         CASE WHEN b1.ts_code IS NOT NULL THEN w.y_ret_1 END AS y_ret_1,
         CASE WHEN b1.ts_code IS NOT NULL THEN w.y_risk_vol_1 END AS y_risk_vol_1,
         CASE WHEN b5.ts_code IS NOT NULL THEN w.y_ret_5 END AS y_ret_5,
         CASE WHEN b5.ts_code IS NOT NULL THEN w.y_risk_vol_5 END AS y_risk_vol_5
  FROM windows w
  LEFT JOIN cal c1 ON c1.pos = w.pos + 1 LEFT JOIN cal c5 ON c5.pos = w.pos + 5
  LEFT JOIN raw b1 ON b1.ts_code = w.ts_code AND b1.date = c1.cal_date
  LEFT JOIN raw b5 ON b5.ts_code = w.ts_code AND b5.date = c5.cal_date),
metadata AS MATERIALIZED (
  SELECT concat_ws(':', ts_code, strftime(start_date, '%Y%m%d'), strftime(date, '%Y%m%d')) AS sample_id,
         ts_code, idx - {LENGTH - 1} AS start_idx, idx AS end_idx,
         start_date AS sequence_start_date, date AS sequence_end_date, label_date_5 AS label_date,
         y_ret_1, y_risk_vol_1, y_ret_5, y_risk_vol_5,
         coalesce(ret_1_cs_rank, 0.0) AS ret_1_cs_rank, coalesce(ret_1_cs_z, 0.0) AS ret_1_cs_z,
         ret_1_cs_rank IS NOT NULL AS has_rank, ret_1_cs_z IS NOT NULL AS has_z, {split_case('date')} AS split
  FROM dated WHERE is_anchor AND gap_ok AND y_ret_5 IS NOT NULL AND {split_case('date')} IS NOT NULL)"""

# --- predictions -----------------------------------------------------------------------------

PREDS = f"""{RETS},
preds AS MATERIALIZED (
  SELECT ts_code || ':' || CAST(date AS VARCHAR) AS sample_id, date AS label_date,
         floor((close / {lag('close', 5)} - 1) * 20) / 21 AS y_pred, {ahead_ret(5)} AS y_true,
         {std('ret_1', 20)} * {std('ret_1', 20)} AS pred_risk
  FROM rets),
done AS MATERIALIZED (SELECT * FROM preds WHERE y_pred IS NOT NULL AND y_true IS NOT NULL),
good AS MATERIALIZED (
  SELECT label_date, count(*) AS n FROM done GROUP BY label_date
  HAVING count(*) >= 20 AND stddev_pop(y_pred) >= 1e-12 AND stddev_pop(y_true) >= 1e-12),
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY label_date ORDER BY y_pred)
             + count(*) OVER (PARTITION BY label_date ORDER BY y_pred)) / 2.0 AS pr,
         (rank() OVER (PARTITION BY label_date ORDER BY y_true)
             + count(*) OVER (PARTITION BY label_date ORDER BY y_true)) / 2.0 AS tr,
         row_number() OVER (PARTITION BY label_date ORDER BY y_pred, md5(sample_id), sample_id) AS place
  FROM done JOIN good USING (label_date)),
ics AS (
  SELECT label_date, count(*) AS n,
         covar_pop(y_pred, y_true) / (stddev_pop(y_pred) * stddev_pop(y_true)) AS ic,
         covar_pop(pr, tr) / (stddev_pop(pr) * stddev_pop(tr)) AS rank_ic,
         greatest(CAST(floor(count(*) * 0.2) AS BIGINT), 1) AS k,
         avg(y_true) FILTER (place > n - greatest(floor(n * 0.2), 1))
           - avg(y_true) FILTER (place <= greatest(floor(n * 0.2), 1)) AS spread
  FROM ranked GROUP BY label_date),
losses AS (
  SELECT label_date, count(*) AS n,
         avg(0.5 * (ln(v) + (y_true - y_pred) * (y_true - y_pred) / v)) AS nll_loss,
         avg((y_pred - y_true) * (y_pred - y_true)) AS mse_loss,
         CASE WHEN count(*) < 2 OR var_pop(y_pred) < 1e-8 OR var_pop(y_true) < 1e-8 THEN 0.0
              ELSE -covar_pop(y_pred, y_true) / sqrt(var_pop(y_pred) * var_pop(y_true) + 1e-8)
         END AS rank_loss,
         avg(v) AS pred_var_mean, min(v) AS pred_var_min, max(v) AS pred_var_max,
         avg(sqrt(v)) AS pred_std_mean, avg(y_pred) AS pred_return_mean,
         stddev_pop(y_pred) AS pred_return_std
  FROM (SELECT *, CASE WHEN pred_risk IS NOT NULL THEN greatest(pred_risk, 1e-4) END AS v FROM done)
  GROUP BY label_date),
report AS (SELECT *, nll_loss AS base_loss, nll_loss + 0.5 * mse_loss + 0.1 * rank_loss AS loss FROM losses)"""
