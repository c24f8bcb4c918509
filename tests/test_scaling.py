"""What is stored, exchanged and computed twice stays narrow, and the ways for large groups give the same rows."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.config import FeatureConfig
from barloom.operators import batches, cross_section, portfolio, ranking, recursions
from barloom.operators.zscores import add_rolling_zscores
from barloom.plans import catalog
from barloom.plans.panel import panel_features
from fixtures import three_symbols


def _sorted_rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def written(monkeypatch):
    """Columns of the stages that an operator stores."""
    seen = []
    for module in (cross_section, ranking):
        keep = module.stored
        monkeypatch.setattr(module, "stored", lambda df, keep=keep: (seen.append(df.columns), keep(df))[1])
    return seen


def _wide(spark):
    chance = random.Random(3)
    days = [datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), None]
    value = lambda: chance.choice([None, float("nan"), -0.0, 0.0, 1.0, chance.random()])
    rows = [(chance.choice([None, *map(str, range(40))]), days[min(i // 30, 2)], i % 5 != 0, value(), value()) for i in range(80)]
    return spark.createDataFrame(rows, "ts_code string, date date, in_csi300 boolean, a double, b double")


@pytest.mark.parametrize("pct", [True, False])
def test_dates_wider_than_one_task_rank_alike(spark, monkeypatch, pct):
    df = _wide(spark).cache()
    # a row without any value is only in the frame of the narrow way
    found = lambda: _sorted_rows(cross_section.rank_by_date(df, ["a", "b"], pct=pct).where("a_cs_rank is not null or b_cs_rank is not null"))
    narrow = found()
    monkeypatch.setattr(cross_section, "WIDEST", 17)  # two of the three dates are wider
    assert found() == narrow and len(narrow) > 20


def test_panel_features_store_the_members_candidates_only(spark, written):
    panel, _ = three_symbols(spark)
    out, _ = panel_features(panel, FeatureConfig((3,), (3,), (5,), add_ta_features=False, add_extended_ta_features=False))
    assert written == [["ts_code", "date", "in_csi300", "ret_1"]]
    assert out.count() == panel.count()


def test_helpers_of_an_order_are_not_written(spark, written):
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([(f"s{i}", day, float(i % 3)) for i in range(9)], "sample_id string, label_date date, y double")
    places = [r._position for r in ranking.positions_in_group(df, ["label_date"], "y", "sample_id").collect()]
    assert sorted(places) == list(range(1, 10))
    assert batches.date_batches(df, 4, shuffle=True).count() == batches.date_batches(df, 4, shuffle=False).count() == 9
    assert not {"_tie", "_order"} & {c for columns in written for c in columns}


def _bars(spark):
    chance = random.Random(5)
    first, rows = datetime.date(2024, 1, 1), []
    for code, n in ((None, 30), ("a", 1), ("b", 70), ("c", 25), ("d", 140), ("e", 26)):
        close = 10.0
        for i in range(n):
            close = 10.0 if i == 9 else close * chance.uniform(0.95, 1.05)
            day = None if code == "c" and i == 24 else first + datetime.timedelta(i)
            rows.append((code, day, close + 0.2, close - chance.random(), None if chance.random() < 0.03 else close))
    chance.shuffle(rows)
    return spark.createDataFrame(rows, "ts_code string, date date, high double, low double, close double")


def test_recursions_in_blocks_equal_each_symbol_alone(spark, monkeypatch):
    groups = [*recursions.TA_GROUPS, *recursions.EXTENDED_GROUPS]
    names = [c for g in groups for c in recursions.COLUMNS[g]]
    df = _bars(spark)
    wanted = df.toPandas().sort_values("date", na_position="last").fillna({"ts_code": "-"})
    alone = []
    for code, bars in wanted.groupby("ts_code"):
        prices = [bars[c].reset_index(drop=True).astype("float64") for c in ("high", "low", "close")]
        columns = [pd.Series(x) for g in groups for x in recursions._KERNELS[g](*prices)]
        alone += [(code, str(day), *values) for day, *values in zip(bars["date"], *columns)]
    known = {row[:2]: np.array(row[2:], float) for row in alone}
    for block in (1 << 15, 7):
        monkeypatch.setattr(recursions, "BLOCK", block)
        got = recursions.add_recursive(df, groups).select(F.coalesce("ts_code", F.lit("-")), F.col("date").cast("string"), *names).collect()
        assert len(got) == len(known)
        for row in got:
            values = np.array([np.nan if x is None else x for x in row[2:]], float)
            assert np.allclose(values, known[row[0], str(row[1])], rtol=1e-12, atol=1e-12, equal_nan=True)


def test_holdings_read_their_cohorts_once(spark):
    bought = spark.createDataFrame([(3, "x", 0.5), (3, "y", 0.5), (4, "x", 1.0)], "pos int, ts_code string, weight double")
    held = portfolio.holdings(bought, [2])
    assert "Union" not in held._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.pos, r.ts_code): (r.weight, r.before) for r in held.collect()}
    assert found == {
        (3, "x"): (0.25, 0.0), (3, "y"): (0.25, 0.0), (4, "x"): (0.75, 0.25), (4, "y"): (0.25, 0.25),
        (5, "x"): (0.5, 0.75), (5, "y"): (0.0, 0.25), (6, "x"): (0.0, 0.5),
    }


def test_bars_are_computed_once_for_both_formats(spark, monkeypatch, tmp_path):
    rows = [(i % 3 + 1, i % 2 + 1, i, 1, 2.0 + i, 10.0 * i, datetime.date(2024, 1, 1 + i)) for i in range(12)]
    schema = "l_suppkey long, l_linenumber long, l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    sources, write = [], catalog.write_table
    monkeypatch.setattr(catalog, "write_table", lambda df, *args: (sources.append(df.inputFiles()), write(df, *args))[1])
    assert catalog.QUERIES["S2_write_csv_and_parquet"](spark, str(tmp_path)).count() == 24
    assert sum(any("lineitem.parquet" in f for f in files) for files in sources) == 1


def test_rows_without_a_symbol_are_no_history_of_the_next_one(spark):
    rows = [(code, datetime.date(2024, 1, 1 + i), float(i * i + k)) for k, code in enumerate((None, "a", "b")) for i in range(4)]
    df = spark.createDataFrame(rows, "ts_code string, date date, x double").coalesce(1)
    found = {(r.ts_code, r.date.day): r.x_z3 for r in add_rolling_zscores(df, ["x"], (3,)).collect()}
    assert all((z is None) == (day < 3) for (_, day), z in found.items()) and len(found) == 12
