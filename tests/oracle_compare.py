"""Run registered queries beside their DuckDB SQL and compare rows, order aside.

python tests/oracle_compare.py SF_DIR [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    return value


def rows_of(names, rows):
    """Column names sorted, rows with their values in that order, rows sorted."""
    order = sorted(range(len(names)), key=names.__getitem__)
    tidy = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(tidy, key=lambda row: [(v is None, str(v)) for v in row])


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, name, query, oracle, sf_dir):
    """None when equal, otherwise a short account of the difference."""
    result = con.execute(oracle)
    expected_names, expected = rows_of([d[0] for d in result.description], result.fetchall())
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    if names != expected_names:
        return f"columns {names} vs {expected_names}"
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    different = [(a, b) for a, b in zip(got, expected) if a != b]
    if different:
        return f"{len(different)} of {len(got)} rows differ, e.g. {names}\n   {different[0][0]}\n   {different[0][1]}"
    return None


def main(sf_dir, prefixes):
    from pyspark.sql import SparkSession

    import __spark_entry__ as driver

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf_dir), driver.oracle_sql(), 0
    for name, query in driver.queries().items():
        if prefixes and prefixes[0].startswith("-") and name in [p[1:] for p in prefixes]:
            continue
        if prefixes and not prefixes[0].startswith("-") and not name.startswith(tuple(prefixes)):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
