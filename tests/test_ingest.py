import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import membership as m
from barloom.operators.trade_calendar import open_days
from barloom.plans.index_panel import index_panel
from barloom.sources import tables, vendors

D = dt.date


def snapshots(spark, rows, code="399300.SZ"):
    return spark.createDataFrame(
        [(code, day, symbol) for day, symbol in rows], "index_code string, trade_date date, con_code string"
    )


def test_index_names(spark):
    assert m.resolve_index(spark, " HS300 ") == ("csi300", "399300.SZ")
    assert m.resolve_index(spark, "中证500") == ("csi500", "000905.SH")
    assert m.resolve_index(spark, "123456.sz") == ("123456_sz", "123456.SZ")
    for bad in ("", "nikkei"):
        with pytest.raises(Exception, match="not a known index"):
            m.resolve_index(spark, bad)
    df = spark.createDataFrame([("sse50",), ("nikkei",)], "name string")
    rows = {r.name: r.membership_column for r in m.resolve_index_names(df, "name", strict=False).collect()}
    assert rows == {"sse50": "in_sse50", "nikkei": None}
    with pytest.raises(Exception, match="not a known index"):
        m.resolve_index_names(df, "name").collect()


def test_periods_and_single_snapshot(spark):
    (period,) = m.query_periods(spark, 2023, 2023).collect()
    assert (period.period_start, period.period_end) == (D(2022, 11, 1), D(2023, 12, 31))
    (row,) = m.snapshot_intervals(snapshots(spark, [(D(2023, 1, 3), "000001.SZ")]), 2023, 2023).collect()
    assert (row.start_date, row.end_date) == (D(2023, 1, 3), D(2023, 12, 31))


def test_carry_over_and_its_loss(spark):
    rows = [(D(2020, 6, 1), "A"), (D(2021, 2, 1), "B"), (D(2023, 2, 1), "C")]
    out = m.snapshot_intervals(snapshots(spark, rows), 2020, 2023).collect()
    spans = sorted((r.symbol, r.start_date, r.end_date) for r in out)
    assert spans == [
        ("A", D(2020, 6, 1), D(2020, 12, 31)),
        ("A", D(2020, 6, 2), D(2021, 1, 31)),  # carried to the day before the next snapshot
        ("B", D(2021, 2, 1), D(2021, 12, 31)),  # nothing in 2022, so no carry
        ("C", D(2023, 2, 1), D(2023, 12, 31)),
    ]
    table = m.snapshot_intervals(snapshots(spark, rows), 2020, 2023)
    valid, issues = m.check_intervals(table)
    assert not valid and [r.issue for r in issues.orderBy("end_date").collect()] == [
        "OVERLAP between 2020-12-31 and 2020-06-02", "GAP between 2021-12-31 and 2023-02-01",
    ]
    empty, none = m.check_intervals(table.limit(0))
    assert not empty and none.isEmpty()
    text = snapshots(spark, rows).withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    assert m.snapshot_intervals(text, 2020, 2023).exceptAll(table).isEmpty()


def test_overlapping_intervals_never_duplicate_a_bar(spark):
    bars = spark.createDataFrame(
        [("A", D(2020, 6, d)) for d in (1, 5, 9)] + [("B", D(2020, 6, 5))], "ts_code string, date date"
    )
    spans = spark.createDataFrame(
        [("x", "A", D(2020, 6, 1), D(2020, 6, 5)), ("x", "A", D(2020, 6, 3), D(2020, 6, 6))],
        "index_code string, symbol string, start_date date, end_date date",
    )
    out = m.flag_membership(bars, spans, "in_x").orderBy("ts_code", "date").collect()
    assert [r.in_x for r in out] == [True, True, False, False]


def test_rebalance_dates_are_third_wednesdays(spark):
    rows = m.rebalance_intervals(spark, 2020, 2021).orderBy("start_date").collect()
    assert [r.start_date for r in rows] == [D(2019, 12, 18), D(2020, 6, 17), D(2020, 12, 16), D(2021, 6, 16), D(2021, 12, 15)]
    assert rows[0].end_date == D(2020, 6, 16) and rows[-1].end_date == D(2021, 12, 31)


def test_daily_bars_and_index_panel(spark):
    bar = ("000001.SZ", "20230103", 10.0, 10.5, 9.8, 10.2, 10.0, 0.2, 2.0, 1000, 10200)
    schema = (
        "ts_code string, trade_date string, open double, high double, low double, close double, "
        "pre_close double, change double, pct_chg double, vol long, amount long"
    )
    hot = spark.createDataFrame([bar], schema).crossJoin(spark.range(500)).drop("id")
    other = spark.createDataFrame([(bar[0], "20230104", *bar[2:])], schema)
    out = index_panel(
        snapshots(spark, [(D(2023, 1, 3), "000001.SZ")], "000905.SH"), [hot, other], "csi500", 2023, 2023
    )
    rows = out.orderBy("date").collect()
    assert [(r.date, r.volume, r.in_csi500) for r in rows] == [
        (D(2023, 1, 3), 1000, True), (D(2023, 1, 4), 1000, True),
    ]
    assert "in_csi300" not in out.columns
    with pytest.raises(ValueError, match="at least one"):
        vendors.daily_bars([])


def test_text_bars(spark):
    raw = spark.createDataFrame([("2024-01-02", "20240102093500000", "1.5", "")], "date string, time string, open string, volume string")
    row = vendors.text_minute_bars(raw, "sh.600008", 5).first()
    assert (row.code, row.frequency, row.open, row.volume) == ("sh.600008", "5min", 1.5, None)
    assert row.time == dt.datetime(2024, 1, 2, 9, 35)
    assert vendors.text_daily_bars(raw, "x").first().frequency == "d"


def test_reading_and_writing(spark, tmp_path):
    df = spark.createDataFrame([("A", D(2024, 1, 2), 1.5), ("B", D(2024, 1, 3), 2.5)], "ts_code string, date date, close double")
    path = f"{tmp_path}/bars.parquet"
    assert tables.write_table(df, path, "parquet")
    assert tables.read_panel(spark, "bars.parquet", ["close"], raw_dir=str(tmp_path)).columns == ["close"]
    one = tables.symbol_bars(tables.read_panel(spark, path), "A", "2024-01-01", "2024-12-31")
    assert tables.write_table(one, f"{tmp_path}/one", "csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/one").collect()
    assert [(r.ts_code, r.close) for r in back] == [("A", "1.5")]
    assert not tables.write_table(df.limit(0), f"{tmp_path}/none", "csv", skip_empty=True)
    with pytest.raises(ValueError, match="orc"):
        tables.write_table(df, path, "orc")
    with pytest.raises(ValueError, match="a .parquet"):
        tables.read_panel(spark, "bars.csv")
    with pytest.raises(FileNotFoundError):
        tables.read_panel(spark, f"{tmp_path}/nothing.parquet")


def test_calendar_normalisation(spark):
    rows = [("SSE", "2024-01-03", 1), ("SSE", "2024-01-02", 1), ("SSE", "2024-01-02", 1), ("SSE", "2024-01-06", 0), ("SSE", None, 1)]
    df = spark.createDataFrame(rows, "exchange string, cal_date string, is_open int")
    assert sorted(r.cal_date for r in open_days(df).collect()) == [D(2024, 1, 2), D(2024, 1, 3)]
    assert open_days(df.select("cal_date")).count() == 3
    with pytest.raises(ValueError):
        open_days(df.drop("cal_date"))
    changes = m.constituent_changes(
        snapshots(spark, [(D(2020, 1, 2), "A"), (D(2020, 1, 2), "B"), (D(2021, 1, 4), "B"), (D(2021, 1, 4), "C")]),
        F.lit(D(2020, 1, 2)), F.lit(D(2021, 1, 4)),
    )
    assert sorted((r.symbol, r.change) for r in changes.collect()) == [("A", "removed"), ("C", "added")]


def test_integers_take_declared_widths(spark):
    from barloom.operators.contract import compact_types

    df = spark.createDataFrame([("a", 7, 300, 1.5), ("b", None, -2, None)], "ts_code string, n long, m long, x double")
    out = compact_types(df, {"n": "byte", "m": "short"})
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["string", "tinyint", "smallint", "float"]
    assert sorted(map(tuple, out.collect())) == [("a", 7, 300, 1.5), ("b", None, -2, None)]
    with pytest.raises(Exception, match="m does not fit byte: 300"):
        compact_types(df, {"m": "byte"}).collect()
    with pytest.raises(ValueError):
        compact_types(df, {"x": "byte"})
