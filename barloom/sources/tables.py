"""Reading panels and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.config import DATE, SYMBOL

FORMATS = ("csv", "parquet")


def read_panel(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    raw_dir: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read a parquet table; a bare file name is looked up in ``raw_dir``."""
    if not path.endswith(".parquet"):
        raise ValueError(f"{path} is not a .parquet")
    if "/" not in path and raw_dir:
        path = f"{raw_dir.rstrip('/')}/{path}"
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        df = reader.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"nothing at {path}") from error
        raise
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", skip_empty: bool = False) -> bool:
    """Write as csv (with header) or parquet. Returns False when an empty frame was skipped."""
    if fmt not in FORMATS:
        raise ValueError(f"cannot write {fmt}; formats are {FORMATS}")
    if skip_empty and df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return True


def symbol_bars(df: DataFrame, code: str, start: str, end: str) -> DataFrame:
    """One symbol's bars in an inclusive date range; both filters reach the scan."""
    return df.where((F.col(SYMBOL) == code) & F.col(DATE).between(F.lit(start), F.lit(end)))
