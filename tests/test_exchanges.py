"""Bars, panel and feature base are spread by symbol once; what is stored and loaded stays the same."""

import datetime as dt
import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from barloom.config import FeatureConfig, PanelBuildConfig
from barloom.functions.staging import read_by, stored_by
from barloom.functions.windows import prior
from barloom.operators import cross_section
from barloom.operators.membership import flag_membership
from barloom.operators.ranking import join_on
from barloom.operators.samples import sample_tensors, with_row_index
from barloom.operators.scaling import feature_base
from barloom.operators.zscores import add_rolling_zscores
from barloom.plans import catalog
from barloom.plans import panel as build
from barloom.plans.dataset_build import _plainly_valid, layout_of, share_of, write_features
from barloom.plans.panel import panel_features
from barloom.sources.sales_panel import panel_with_universe, raw_bars, supplier_panel

CFG = FeatureConfig((3,), (3,), (5,), add_ta_features=False, add_extended_ta_features=False)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def bars_of(spark, symbols=("A", "B", "C"), days=12, extra=()):
    rows = []
    for k, s in enumerate(symbols):
        for i in range(days):
            close = 10.0 + k + math.sin(i * (k + 2))
            rows.append((s, dt.date(2020, 12, 25) + dt.timedelta(i), close - 0.1, close + 0.3, close - 0.4, close, 100.0 + i, close - 0.05, True))
    rows += extra
    return spark.createDataFrame(rows, "ts_code string, date date, open double, high double, low double, close double, volume double, pre_close double, in_csi300 boolean")


def quietly(*args):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return panel_features(*args)[0]


def test_bars_share_one_exchange_by_symbol(no_broadcast, tmp_path):
    lines = [(o, n, 5, 1 + o % 3, float(1 + n), 10.0 * (1 + o + n), dt.datetime(2020, 1, 1 + o % 9)) for o in range(60) for n in range(2)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    lines = no_broadcast.createDataFrame([*lines, (99, 1, 5, None, 2.0, 8.0, None)], schema)
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    bars = supplier_panel(no_broadcast, str(tmp_path))
    assert plan_of(bars).count("Exchange ") == 1
    assert plan_of(add_rolling_zscores(bars, ["close"], (3,))).count("Exchange ") == 1
    whole = raw_bars(lines, F.col("l_suppkey"))
    key = lambda rows: sorted(map(str, rows))
    assert key(bars.drop("pre_close").collect()) == key(whole.collect())


def test_ranks_meet_the_bars_after_one_exchange(no_broadcast):
    found = [line for line in plan_of(quietly(bars_of(no_broadcast), CFG)).splitlines() if "Exchange hashpartitioning(ts_code" in line or "coalesce(ts_code" in line]
    assert len(found) == 1 and "date" not in found[0]


def test_bars_without_symbol_or_date_keep_their_ranks(no_broadcast):
    odd = [
        (s, d, x, x + 0.2, x - 0.2, x, 50.0, x - 0.1, True)
        for s, d, x in ((None, dt.date(2020, 12, 26), 7.0), (None, dt.date(2020, 12, 27), 8.0), ("A", None, 9.0), ("B", None, 9.5))
    ]
    df = bars_of(no_broadcast, extra=odd)
    rows = quietly(df, CFG).select("ts_code", "date", "close", "ret_1", "ret_1_cs_rank").collect()
    assert len(rows) == df.count()
    for r in rows:
        peers = [p.ret_1 for p in rows if p.date == r.date and p.ret_1 is not None]
        if r.ret_1 is None:
            assert r.ret_1_cs_rank is None
        else:
            below, same = sum(p < r.ret_1 for p in peers), sum(p == r.ret_1 for p in peers)
            assert r.ret_1_cs_rank == pytest.approx((below + (same + 1) / 2) / len(peers))


def test_both_ways_of_joining_ranks_agree(spark, monkeypatch):
    df = bars_of(spark)
    near = sorted(map(str, quietly(df, CFG).collect()))
    monkeypatch.setattr(build, "_beside", lambda df, ranks, tasks: join_on(df, ranks, ["ts_code", "date"], "left"))
    assert sorted(map(str, quietly(df, CFG).collect())) == near


def test_feature_base_is_written_from_the_tasks_that_fill_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("barloom.plans.dataset_build.ROWS_PER_FOLDER", 10)
    df = bars_of(spark, [f"S{k}" for k in range(20)]).withColumn("close", F.when(F.dayofmonth("date") != 28, F.col("close")))
    path = str(tmp_path / "base.parquet")
    shares = write_features(df, ["close", "volume"], {"close": (10.0, 2.0)}, path)
    stored = spark.read.parquet(path)
    assert shares > 1 and stored.where(F.col("share") != share_of(shares)).isEmpty()
    wanted = with_row_index(feature_base(df, ["close", "volume"], {"close": (10.0, 2.0)}))
    key = lambda rows: sorted(map(str, rows))
    assert key(stored.select(*wanted.columns).collect()) == key(wanted.collect())
    # a task's rows lie in one share, so a symbol's year lies in one file and a file in one task
    tasks = stored.select(F.regexp_extract(F.input_file_name(), "part-([0-9]+)-", 1).alias("task"), "share").distinct()
    assert tasks.groupBy("task").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("fault, plain", [(None, True), ("x", False), ("x_mask", False), ("nan", False), ("side", False), ("none", False), ("unreached", False)])
def test_only_rows_without_gaps_pass_without_building_tensors(spark, fault, plain):
    x = {"x": None, "nan": math.nan}.get(fault, 1.0)
    features = spark.createDataFrame([("A", 0, 0.5, 1), ("A", 1, x, None if fault == "x_mask" else 1)], "ts_code string, idx int, x float, x_mask byte")
    side = None if fault == "side" else 0.5
    start = 7 if fault == "unreached" else 0
    usable = spark.createDataFrame([("A", start, start + 1, side, 1.0)], "ts_code string, start_idx int, end_idx int, s double, s_mask float")
    assert _plainly_valid(features, usable.where(F.lit(fault != "none")), ["x"], ["s"]) is plain


def test_membership_leaves_the_bars_where_they_lie(no_broadcast):
    bars = bars_of(no_broadcast).drop("in_csi300").repartition(3, "ts_code")
    schema = "symbol string, start_date date, end_date date"
    spans = no_broadcast.createDataFrame([("A", dt.date(2020, 12, 26), dt.date(2020, 12, 28)), ("C", dt.date(2021, 1, 2), dt.date(2030, 1, 1))], schema)
    flagged = flag_membership(bars, spans, "in_x", 3)
    assert plan_of(flagged).count("Exchange hashpartitioning(ts_code") == plan_of(bars).count("Exchange hashpartitioning(ts_code") == 1
    key = lambda rows: sorted(map(str, rows))
    assert key(flagged.collect()) == key(flag_membership(bars, spans, "in_x").collect())


def test_bars_stored_by_symbol_need_no_exchange(no_broadcast):
    df = bars_of(no_broadcast, extra=[(None, dt.date(2020, 12, 26), 7.0, 7.2, 6.8, 7.0, 50.0, 6.9, True)])
    kept = stored_by(df, "ts_code", "date", 3)
    key = lambda rows: sorted(map(str, rows))
    assert key(kept.select(*df.columns).collect()) == key(df.collect())
    assert "Exchange " not in plan_of(add_rolling_zscores(kept, ["close"], (3,)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        spread = panel_features(kept, CFG, spread=3)[0]
    near = lambda t: key([tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r) for r in t.collect()])
    assert near(spread) == near(quietly(df, CFG).select(*spread.columns))


@pytest.mark.parametrize("twice", [False, True])
def test_one_group_for_a_date_gives_the_ranks_and_moments_of_the_wide_way(spark, monkeypatch, twice):
    day, more = dt.date(2021, 1, 4), dt.date(2021, 1, 5)
    rows = [(f"S{k}", day, 0.1, float(k % 5), None if k % 3 else 2.0 + k, True) for k in range(40)]
    rows += [("S0", more, 1.0, None, None, True), ("S1", more, 2.0, None, 5.0, False), ("S0", None, 3.0, 4.0, 5.0, True), (None, None, 5.0, 4.0, None, True)]
    df = spark.createDataFrame(rows * (1 + twice), "ts_code string, date date, same double, tied double, gaps double, in_csi300 boolean")
    columns = ["same", "tied", "gaps"]

    def found():
        ranks, moments = cross_section.cross_tables(df, columns)
        key = lambda t: {str(r[:2]) if t is ranks else str(r[0]): tuple(r[2:] if t is ranks else r[1:]) for r in t.collect()}
        return key(ranks), key(moments)

    near = found()
    monkeypatch.setattr(cross_section, "WIDEST", 0)
    wide = found()
    assert wide[1].keys() == near[1].keys()
    for own, other in zip(near[1].values(), (wide[1][k] for k in near[1])):
        for a, b in zip(own, other):
            assert a == b if a is None or b is None else a == pytest.approx(b, rel=1e-12)
    assert near[1][str(day)][1] == 0.0
    known = {k: v for k, v in near[0].items() if any(x is not None for x in v)}
    assert all(wide[0][k] == v for k, v in known.items()) and len(known) >= 43


def test_members_values_are_not_stored(spark, monkeypatch):
    monkeypatch.setattr(cross_section, "rank_by_date", None)
    seen = []
    keep = cross_section.stored
    monkeypatch.setattr(cross_section, "stored", lambda df: seen.append(df.schema) or keep(df))
    df = bars_of(spark)
    cross_section.cross_tables(df, ["close", "open"])
    (schema,) = seen
    assert {f.dataType.simpleString() for f in schema.fields[2:-1]} == {"int"}


def test_shuffles_are_released_once_the_feature_base_is_written(spark, tmp_path, monkeypatch):
    path, seen = tmp_path / "base.parquet", []
    monkeypatch.setattr("barloom.plans.dataset_build.release", lambda _: seen.append((path / "_SUCCESS").exists()))
    write_features(bars_of(spark), ["close"], {"close": (10.0, 2.0)}, str(path))
    assert seen == [True]


def _near(df):
    return sorted(str([round(x, 9) + 0.0 if isinstance(x, float) else x for x in r]) for r in df.collect())


def _odd_bars(spark):
    return bars_of(spark, days=30, extra=[(s, d, 7.0, 7.2, 6.8, 7.0, 50.0, 6.9, True) for s, d in ((None, dt.date(2020, 12, 26)), (None, dt.date(2020, 12, 27)), ("A", None))])


def test_stored_bars_are_not_exchanged_for_their_ranks(no_broadcast):
    kept = stored_by(bars_of(no_broadcast), "ts_code", "date", 3)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        plan = plan_of(panel_features(kept, CFG, spread=3)[0]).splitlines()
    union = next(i for i, line in enumerate(plan) if "Union" in line)
    assert not any("Exchange hash" in line for line in plan[:union])
    sent = [line for line in plan if "Exchange hash" in line]
    assert len(sent) == 1 and "(ts_code" in sent[0] and "Bucketed: true" in "".join(plan)


@pytest.mark.parametrize("widest", [1 << 18, 2])
def test_features_of_stored_bars_equal_those_of_plain_ones(spark, monkeypatch, widest):
    cfg = FeatureConfig((3,), (3,), (5,), add_time_features=False, add_extended_ta_features=False)
    df, seen = _odd_bars(spark), []
    want = quietly(df, cfg)
    kept, store = stored_by(df, "ts_code", "date", 3), cross_section.stored
    monkeypatch.setattr(cross_section, "WIDEST", widest)
    monkeypatch.setattr(cross_section, "stored", lambda df: seen.append(df.schema) or store(df))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        got = panel_features(kept, cfg, spread=3)[0]
    assert got.columns == want.select(*got.columns).columns and _near(got) == _near(want.select(*got.columns))
    assert len(seen) == 2 and ("rsi_14" in seen[1].names) != ("rsi_14" in seen[0].names)
    if widest > 2:
        assert {f.dataType.simpleString() for s in seen for f in s.fields[2:-1]} == {"int"}


def test_ranks_sent_by_symbol_are_the_same(spark):
    chance = random.Random(7)
    value = lambda: chance.choice([None, 0.0, 1.0, chance.random()])
    days = [dt.date(2021, 1, 4), dt.date(2021, 1, 5), None]
    rows = [(None if k == 7 else f"S{k}", day, *[value() for _ in range(4)], k % 4 > 0) for k in range(30) for day in days]
    df = spark.createDataFrame(rows, "ts_code string, date date, a double, b double, c double, d double, in_csi300 boolean")
    plain, sent = (cross_section.cross_tables(df, ["a", "b", "c", "d"], **kw)[0] for kw in ({}, {"tasks": 3}))
    assert sent.rdd.getNumPartitions() == 3
    key = lambda t: sorted(map(str, t.collect()))
    assert key(sent) == key(plain) and len(key(plain)) > 60


def test_the_close_before_is_not_stored(spark, tmp_path, monkeypatch):
    rows = [(o, 1, 5, 1 + o % 3, float(1 + o % 2), 10.0 * (1 + o), dt.datetime(2020 + o % 2, 1, 1 + o % 9)) for o in range(60)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    monkeypatch.setattr(catalog, "stored_by", lambda df, *args: seen.append(df.columns) or stored_by(df, *args))
    monkeypatch.setattr(catalog, "_quiet_features", lambda panel, cfg, **kw: (panel, []))
    bars, wanted = catalog.default_features(spark, str(tmp_path)), panel_with_universe(spark, str(tmp_path))
    assert bars.columns == wanted.columns and _near(bars) == _near(wanted)
    assert "pre_close" in bars.columns and "pre_close" not in seen[0]


def test_the_panel_block_does_not_exchange_its_bars(spark, tmp_path, monkeypatch):
    rows = [(o, 1, 5, 1 + o % 3, float(1 + o % 2), 10.0 * (1 + o), dt.datetime(2020 + o % 2, 1, 1 + o % 9)) for o in range(60)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    whole, shown = catalog._panel_block(spark, str(tmp_path)), []
    plain, _ = catalog._quiet_features(catalog.universe_panel(spark, str(tmp_path)), catalog.SMALL)
    wanted = catalog.shown(plain, [c for c in whole.columns])
    assert _near(whole) == _near(wanted) and whole.count() == plain.count() > 0
    monkeypatch.setattr(catalog, "_quiet_features", lambda panel, cfg, **kw: shown.append((panel, kw)) or panel_features(panel, cfg, **kw))
    catalog._panel_block(spark, str(tmp_path))
    assert shown[0][1]["spread"] and "Exchange hash" not in plan_of(shown[0][0].withColumn("before", prior("close", 2)))


def test_wide_rows_stay_in_their_buckets(no_broadcast, tmp_path, monkeypatch):
    spark = no_broadcast
    monkeypatch.setattr("barloom.plans.dataset_build.ROWS_PER_FOLDER", 200)
    df = bars_of(spark, [f"S{k}" for k in range(20)], days=30).unionByName(bars_of(spark, [None]))
    df.write.parquet(str(tmp_path / "bars.parquet"))
    config = PanelBuildConfig(str(tmp_path / "bars.parquet"), str(tmp_path), CFG, (1,))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        build.build_processed_panel(spark, config)
    panel, targets, _ = build.load_processed_panel(spark, config)
    buckets = build.panel_buckets(spark, config)
    key = lambda t: sorted(map(str, t.collect()))
    assert key(panel) == key(spark.read.parquet(config.processed_path).select(*panel.columns))
    names = ["ret_1", "close_z5"]
    assert "Exchange hash" not in plan_of(with_row_index(feature_base(panel, names, {})))
    layout, path = layout_of(panel, buckets), str(tmp_path / "base.parquet")
    assert layout.given and layout.shares > 1 and layout.buckets == buckets
    assert write_features(panel, names, {}, path, layout) == layout.shares
    plain = spark.read.parquet(path)
    kept = read_by(plain, path, "ts_code", "date", buckets, ("year", "share"))
    assert key(kept) == key(plain.select(*kept.columns)) and kept.count() == df.count()
    assert kept.where(F.col("share") != share_of(layout.shares)).isEmpty()
    some = "sample_id string, ts_code string, start_idx int, end_idx int, label_date date, y_ret_5 double, y_risk_vol_5 double"
    found = spark.createDataFrame([(f"{s}{i}", s, i, i + 3, dt.date(2021, 1, 1), 0.1, 0.2) for s in ("S1", "S5", "S9") for i in range(0, 20, 2)], some)
    monkeypatch.setattr("barloom.operators.samples.CHUNK_ROWS", 6)
    own = sample_tensors(kept, found, names, sequence_length=4, buckets=buckets)
    assert key(own) == key(sample_tensors(plain, found, names, sequence_length=4)) and own.count() == 30
    assert [line for line in plan_of(own).splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" not in line] == []
