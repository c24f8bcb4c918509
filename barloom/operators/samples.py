"""Sequence samples: enumeration, gap tolerance, label dates, metadata rows and their tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL, SequenceConfig, YearSplits, target_horizon, target_mask
from barloom.functions.windows import per_symbol, prior
from barloom.operators.scaling import split_of


def with_row_index(df: DataFrame) -> DataFrame:
    """0-based position of a row in its symbol's history."""
    return df.withColumn("idx", F.row_number().over(per_symbol()) - 1)


def one_exchange(calendar: DataFrame) -> DataFrame:
    """Refuse a calendar that has a day twice, which would repeat samples."""
    if calendar.groupBy("cal_date").count().where(F.col("count") > 1).take(1):
        raise ValueError("the calendar has a day twice; give the days of one exchange")
    return calendar


def with_calendar_position(df: DataFrame, calendar: DataFrame) -> DataFrame:
    # one row per open day of one exchange
    days = F.broadcast(one_exchange(calendar).select(F.col("cal_date").alias(DATE), "pos"))
    return df.join(days, DATE, "left")


def is_anchor(seq: SequenceConfig) -> Column:
    """Rows that end a window of full length starting on a multiple of the stride."""
    start = F.col("idx") - (seq.sequence_length - 1)
    return (start >= 0) & (F.pmod(start, F.lit(seq.start_interval)) == 0)


def gap_tolerated(seq: SequenceConfig) -> Column:
    """Whether the window ending here skips at most the allowed trading days.

    Needs ``pos``. Every step must join two calendar days in increasing order.
    """
    if seq.sequence_length == 1:
        return F.lit(True)
    steps = per_symbol().rowsBetween(-(seq.sequence_length - 2), 0)
    skipped = F.col("_skipped")
    return (
        (F.count_if(skipped.isNull() | (skipped < 0)).over(steps) == 0)
        & (F.max(skipped).over(steps) <= seq.max_missing_trade_days_per_gap)
        & (F.count_if(skipped > 0).over(steps) <= seq.max_missing_gaps)
    )


def with_sample_windows(df: DataFrame, calendar: DataFrame, seq: SequenceConfig) -> DataFrame:
    """Row index, window start date and the two conditions a window end must meet."""
    placed = with_row_index(with_calendar_position(df, calendar))
    placed = placed.withColumn("_skipped", F.col("pos") - prior("pos") - 1)
    return placed.withColumns(
        {
            "is_anchor": is_anchor(seq),
            "gap_ok": gap_tolerated(seq),
            "start_date": prior(DATE, seq.sequence_length - 1),
        }
    ).drop("_skipped")


def bar_exists_at(h: int) -> Column:
    """Whether the symbol has a bar exactly h trading days ahead, by a range frame on ``pos``."""
    order = Window.partitionBy(SYMBOL).orderBy("pos").rangeBetween(h, h)
    return F.col("pos").isNotNull() & (F.count("pos").over(order) > 0)


def with_labels(df: DataFrame, calendar: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Label date per horizon, targets nulled where the label is unusable, and 0/1 masks.

    A label needs its date in the calendar, a bar of the symbol on that date and a known target.
    The value itself is the row's own target, which counts rows, not trading days.
    """
    horizons = sorted({h for t in targets if (h := target_horizon(t)) is not None})
    out, calendar = df, one_exchange(calendar)
    for h in horizons:
        ahead = F.broadcast(  # one row per open day
            calendar.select((F.col("pos") - h).alias("pos"), F.col("cal_date").alias(f"label_date_{h}"))
        )
        out = out.join(ahead, "pos", "left")
    out = out.withColumns({f"_bar_{h}": bar_exists_at(h) for h in horizons})
    usable = {}
    for t in targets:
        h = target_horizon(t)
        known = F.col(t).isNotNull() & F.col(f"_bar_{h}") if h is not None else F.lit(False)
        usable[t] = F.when(known, F.col(t).cast("double"))
    masks = {target_mask(t): v.isNotNull().cast("float") for t, v in usable.items()}
    kept = [F.col(c) for c in out.columns if c not in usable and not c.startswith("_bar_")]
    return out.select(*kept, *[v.alias(c) for c, v in {**usable, **masks}.items()])


def sample_metadata(
    df: DataFrame,
    calendar: DataFrame,
    seq: SequenceConfig,
    splits: YearSplits,
    targets: Sequence[str],
    label_column: str,
    cross_columns: Sequence[str] = (),
    strict_splits: bool = False,
) -> DataFrame:
    """One row per usable sample with its split (by end date; other years are dropped).

    ``strict_splits`` also requires window start and label date to fall into the same split.
    """
    cross_columns = [c for c in cross_columns if c not in targets]
    source = df.select(SYMBOL, DATE, *targets, *cross_columns)
    rows = with_labels(with_sample_windows(source, calendar, seq), calendar, targets)
    rows = rows.where(F.col("is_anchor") & F.col("gap_ok") & F.col(label_column).isNotNull())
    label_date = F.col(f"label_date_{target_horizon(label_column)}")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    out = rows.select(
        F.concat_ws(":", SYMBOL, day("start_date"), day(DATE)).alias("sample_id"),
        SYMBOL,
        (F.col("idx") - (seq.sequence_length - 1)).alias("start_idx"),
        F.col("idx").alias("end_idx"),
        F.col("start_date").alias("sequence_start_date"),
        F.col(DATE).alias("sequence_end_date"),
        label_date.alias("label_date"),
        *[c for t in targets for c in (t, target_mask(t))],
        *[
            c
            for x in cross_columns
            for c in (
                F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(x),
                F.col(x).isNotNull().cast("float").alias(f"{x}_mask"),
            )
        ],
        split_of(F.col(DATE), splits).alias("split"),
    ).where("split is not null")
    if strict_splits:
        for c in ("sequence_start_date", "label_date"):
            out = out.where(split_of(F.col(c), splits) == F.col("split"))
    return out


def split_counts(metadata: DataFrame, splits: YearSplits) -> DataFrame:
    """Samples per split; a split without samples shows 0."""
    names = [(n,) for n in splits.as_dict()]
    known = metadata.sparkSession.createDataFrame(names, "split string")
    counted = metadata.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))
    return known.join(counted, "split", "left").fillna(0, ["samples"])


# --- tensors ---------------------------------------------------------------------------------


def usable_samples(metadata: DataFrame, y_return: str = "y_ret_5", y_risk: str = "y_risk_vol_5") -> DataFrame:
    """Samples whose two regression targets are both known."""
    missing = sorted({"start_idx", "end_idx", y_return, y_risk} - set(metadata.columns))
    if missing:
        raise ValueError(f"sample metadata lacks {missing}")
    return metadata.where(F.col(y_return).isNotNull() & F.col(y_risk).isNotNull())


CHUNK_ROWS = 256


def sample_tensors(
    features: DataFrame,
    metadata: DataFrame,
    feature_names: Sequence[str],
    cross_columns: Sequence[str] = (),
    y_return: str = "y_ret_5",
    y_risk: str = "y_risk_vol_5",
    sequence_length: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """x_seq (rows in order; features then masks), x_cs, x_cs_mask, y_return, y_risk, label_date.

    Feature rows bring their ``idx``, or are numbered here. A symbol's history is cut into chunks of ``CHUNK_ROWS`` rows and a sample belongs to the chunk it
    starts in. A wide feature row is sent to the chunks whose samples may contain it, about once
    instead of once per overlapping window, and everything after that stays inside (symbol, chunk).
    ``buckets`` is the number of buckets by symbol in which the feature rows are stored. They stay there then, and the samples,
    which are narrow, come to them; a symbol's rows meet its chunks, whose number the calendar bounds.
    """
    names = [*feature_names, *[f"{c}_mask" for c in feature_names]]
    missing = [c for c in names if c not in features.columns]
    if missing:
        raise ValueError(f"the feature base lacks {sorted(missing)}")
    kept = usable_samples(metadata, y_return, y_risk)
    if sequence_length is None:
        longest = kept.agg(F.max(F.col("end_idx") - F.col("start_idx")).alias("n")).first()
        sequence_length = (longest["n"] or 0) + 1

    chunk = lambda idx: F.floor(idx / F.lit(CHUNK_ROWS)).cast("int")
    earliest = F.greatest(F.col("idx") - (sequence_length - 1), F.lit(0))
    rows = (features if "idx" in features.columns else with_row_index(features)).select(
        SYMBOL,
        "idx",
        F.array(*[F.col(c).cast("float") for c in names]).alias("x"),
        F.explode(F.sequence(chunk(earliest), chunk(F.col("idx")))).alias("chunk"),
    )
    cs = [c for c in cross_columns if c in metadata.columns]
    floats = lambda cols: F.array(*[F.col(c).cast("float") for c in cols]).cast("array<float>")
    sample = F.struct(
        "start_idx",
        "end_idx",
        "sample_id",
        floats(cs).alias("x_cs"),
        floats([f"{c}_mask" for c in cs]).alias("x_cs_mask"),
        F.col(y_return).cast("float").alias("y_return"),
        F.col(y_risk).cast("float").alias("y_risk"),
        "label_date",
    )
    # at most CHUNK_ROWS samples start in a chunk
    spans = (kept.repartition(buckets, SYMBOL) if buckets else kept).groupBy(SYMBOL, chunk(F.col("start_idx")).alias("chunk")).agg(
        F.collect_list(sample).alias("samples")
    )
    inside = F.filter("samples", lambda s: F.col("idx").between(s["start_idx"], s["end_idx"]))
    if buckets:
        # a range instead of an equality: only the symbol decides where rows meet
        theirs = spans.withColumnsRenamed({SYMBOL: "__symbol", "chunk": "__chunk"})
        met = rows.join(theirs, (F.col(SYMBOL) == F.col("__symbol")) & F.col("chunk").between(F.col("__chunk"), F.col("__chunk")))
    else:
        met = rows.join(spans, [SYMBOL, "chunk"])
    placed = met.select(SYMBOL, "chunk", "idx", "x", F.explode(inside).alias("sample"))
    stacked = placed.groupBy(SYMBOL, "chunk", F.col("sample.start_idx").alias("start_idx")).agg(
        F.first("sample").alias("sample"),
        F.sort_array(F.collect_list(F.struct("idx", "x"))).alias("rows"),
    )
    kept_fields = ("x_cs", "x_cs_mask", "y_return", "y_risk", "label_date")
    return stacked.select(
        "sample.sample_id",
        F.transform("rows", lambda r: r["x"]).alias("x_seq"),
        *[f"sample.{f}" for f in kept_fields],
    )


def assert_valid_tensors(tensors: DataFrame) -> DataFrame:
    """Raise on an empty set or on a null inside any tensor."""
    bad_seq = F.exists("x_seq", lambda r: F.exists(r, lambda v: v.isNull() | F.isnan(v)))
    bad_flat = [F.exists(c, lambda v: v.isNull() | F.isnan(v)) for c in ("x_cs", "x_cs_mask")]
    row = tensors.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad_seq | bad_flat[0] | bad_flat[1]).alias("bad")
    ).first()
    if not row["n"]:
        raise ValueError("no sample has both targets")
    if row["bad"]:
        raise ValueError(f"{row['bad']} samples have gaps in their tensors")
    return tensors
