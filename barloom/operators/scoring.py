"""Scoring a prediction table: ``label_date, sample_id, y_pred, y_true, pred_risk``.

Everything is an aggregate over the whole cross-section of a date; ranks and places come from
``ranking``, which spreads a date over tasks by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.staging import stored
from barloom.operators.ranking import positions_in_group, with_average_rank

DAY = "label_date"
MIN_GROUP_SIZE = 20
FLAT = 1e-12


def _correlation(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _scorable(x: str = "y_pred", y: str = "y_true", min_size: int = MIN_GROUP_SIZE, finite: bool = True) -> Column:
    """Dates with enough rows, variation in both columns and, if asked for, only finite values."""
    enough = (F.count(F.lit(1)) >= min_size) & (F.stddev_pop(x) >= FLAT) & (F.stddev_pop(y) >= FLAT)
    for c in (x, y) if finite else ():
        enough = enough & F.bool_and(F.abs(c) < float("inf"))
    return enough


def complete(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("y_pred").isNotNull() & F.col("y_true").isNotNull())


def date_ic(preds: DataFrame, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Pearson correlation of prediction and target per date."""
    return scored_days(complete(preds), min_size, ic=_correlation("y_pred", "y_true"))


def with_ranks(preds: DataFrame) -> DataFrame:
    """Average ranks of prediction and target inside each date; null for null."""
    table = stored(preds)
    ranked = with_average_rank(table, [DAY], "y_pred", "pred_rank")
    return with_average_rank(ranked, [DAY], "y_true", "true_rank").drop("pred_rank_of", "true_rank_of")


def date_rank_ic(preds: DataFrame, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Spearman correlation per date: Pearson of the average ranks."""
    ranked = with_ranks(complete(preds))
    return scored_days(ranked, min_size, rank_ic=_correlation("pred_rank", "true_rank"))


def scored_days(rows: DataFrame, min_size: int, finite: bool = True, **metrics: Column) -> DataFrame:
    days = rows.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("n"),
        _scorable(min_size=min_size, finite=finite).alias("_ok"),
        *[metric.alias(name) for name, metric in metrics.items()],
    )
    return days.where("_ok").drop("_ok")


def _placed(rows: DataFrame, top_frac: float) -> DataFrame:
    """Adds ``_position`` by prediction and ``_k``, how many rows the top and the bottom have. ``rows`` are stored, as placing reads them twice."""
    placed = positions_in_group(stored(rows), [DAY], "y_pred", "sample_id")
    k = F.greatest(F.floor(F.col("_group_rows") * F.lit(top_frac)), F.lit(1)).cast("long")
    return placed.withColumn("_k", k)


def _spread() -> Column:
    """Means leave NaN targets out."""
    known = F.when(~F.isnan("y_true"), F.col("y_true"))
    top = F.when(F.col("_position") > F.col("_group_rows") - F.col("_k"), known)
    bottom = F.when(F.col("_position") <= F.col("_k"), known)
    return F.avg(top) - F.avg(bottom)


def date_spread(
    preds: DataFrame, top_frac: float = 0.2, min_size: int = MIN_GROUP_SIZE
) -> DataFrame:
    """Mean target of the k highest predictions minus that of the k lowest, k = max(int(n f), 1).

    Equal predictions are ordered by the md5 of the sample id.
    """
    rows = complete(preds).select(DAY, "sample_id", "y_pred", "y_true")
    return scored_days(_placed(rows, top_frac), min_size, False, k=F.first("_k"), spread=_spread())


def metric_summary(
    preds: DataFrame, top_frac: float = 0.2, min_size: int = MIN_GROUP_SIZE
) -> DataFrame:
    """One row: rank IC mean, deviation, ratio and positive share, IC mean, spread mean.

    Predictions are read once; ranks and places are columns of one frame with one row per sample, and
    all metrics of a date come from one aggregate. A date with non-finite values keeps its spread only; without a
    date that has a rank IC, everything is null.
    """
    rows = _placed(complete(preds).select(DAY, "sample_id", "y_pred", "y_true"), top_frac)
    finite = _scorable(min_size=min_size)
    days = scored_days(
        with_ranks(rows),
        min_size,
        False,
        rank_ic=F.when(finite, _correlation("pred_rank", "true_rank")),
        ic=F.when(finite, _correlation("y_pred", "y_true")),
        spread=_spread(),
    )
    rank_ic = F.col("rank_ic")
    mean, std, any_ic = F.avg(rank_ic), F.stddev_pop(rank_ic), F.count(rank_ic) > 0
    return days.agg(
        mean.alias("rank_ic_mean"),
        std.alias("rank_ic_std"),
        (mean / (std + F.lit(1e-8))).alias("rank_ic_ir"),
        F.avg((rank_ic > 0).cast("double")).alias("rank_ic_pos_ratio"),
        F.when(any_ic, F.avg("ic")).alias("ic_mean"),
        F.when(any_ic, F.avg("spread")).alias("top_bottom_spread"),
    )


# --- losses ----------------------------------------------------------------------------------


def clamped_variance(risk: Column, var_min: float = 1e-4) -> Column:
    return F.when(risk.isNotNull(), F.greatest(risk, F.lit(var_min)))


def gaussian_nll(pred: Column, target: Column, variance: Column) -> Column:
    error = target - pred
    return 0.5 * (F.log(variance) + error * error / variance)


def squared_error(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


def rank_ic_loss(x: str = "y_pred", y: str = "y_true", eps: float = 1e-8) -> Column:
    """Aggregate: minus the smoothed correlation; 0 for fewer than two rows or a flat column."""
    vx, vy = F.var_pop(x), F.var_pop(y)
    flat = (F.count(F.lit(1)) < 2) | (vx < eps) | (vy < eps)
    return F.when(flat, F.lit(0.0)).otherwise(-F.covar_pop(x, y) / F.sqrt(vx * vy + F.lit(eps)))


def loss_report(
    preds: DataFrame,
    by: Sequence[str] = (DAY,),
    loss_type: str = "gaussian_nll",
    alpha_rank: float = 0.0,
    alpha_mse: float = 0.0,
    var_min: float = 1e-4,
) -> DataFrame:
    """Loss terms and prediction monitors per batch (by default one batch per date), in one aggregate."""
    if loss_type not in ("gaussian_nll", "mse"):
        raise ValueError(f"Unsupported loss_type: {loss_type}")
    pred, target = F.col("y_pred"), F.col("y_true")
    rows = complete(preds).withColumn("_var", clamped_variance(F.col("pred_risk"), var_min))
    terms = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(gaussian_nll(pred, target, F.col("_var"))) if loss_type == "gaussian_nll" else F.first(F.lit(0.0))).alias("nll_loss"),
        F.avg(squared_error(pred, target)).alias("mse_loss"),
        (rank_ic_loss() if alpha_rank > 0 else F.first(F.lit(0.0))).alias("rank_loss"),
        F.avg("_var").alias("pred_var_mean"),
        F.min("_var").alias("pred_var_min"),
        F.max("_var").alias("pred_var_max"),
        F.avg(F.sqrt("_var")).alias("pred_std_mean"),
        F.avg(pred).alias("pred_return_mean"),
        F.stddev_pop(pred).alias("pred_return_std"),
    )
    base = F.col("nll_loss" if loss_type == "gaussian_nll" else "mse_loss")
    total = base + F.lit(alpha_mse) * F.col("mse_loss") + F.lit(alpha_rank) * F.col("rank_loss")
    return terms.withColumns({"base_loss": base, "loss": total})


# How each loss metric is rolled up over batches.
SAMPLE_MEAN_METRICS = (
    "loss", "base_loss", "nll_loss", "mse_loss",
    "pred_var_mean", "pred_std_mean", "pred_return_mean", "pred_return_std",
)
BATCH_MEAN_METRICS = ("rank_loss",)
MIN_METRICS = ("pred_var_min",)
MAX_METRICS = ("pred_var_max",)


def roll_up(batches: DataFrame, size: str = "n") -> DataFrame:
    """One row from per-batch metrics: sample-weighted means, plain batch means, extremes.
    A batch that lacks a metric does not weigh in its mean."""
    n = F.col(size)
    rules = {
        **{c: F.try_divide(F.sum(F.col(c) * n), F.sum(F.when(F.col(c).isNotNull(), n))) for c in SAMPLE_MEAN_METRICS},
        **{c: F.avg(c) for c in BATCH_MEAN_METRICS},
        **{c: F.min(c) for c in MIN_METRICS},
        **{c: F.max(c) for c in MAX_METRICS},
    }
    return batches.agg(*[rule.alias(c) for c, rule in rules.items() if c in batches.columns])


def prediction_profile(preds: DataFrame, inputs: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, extremes and positive share of target and prediction; null, NaN and infinity
    flags of the given input columns. Deviations use n - 1, as tensor libraries do by default."""
    aggs = []
    for c in ("y_true", "y_pred"):
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
            F.avg(((F.col(c) > 0) & ~F.isnan(c)).cast("double")).alias(f"{c}_pos_ratio"),
        ]
    for c in inputs:
        v = F.col(c)
        aggs += [
            F.bool_or(v.isNull()).alias(f"{c}_has_null"),
            F.bool_or(F.isnan(v)).alias(f"{c}_has_nan"),
            F.bool_or(F.abs(v) == float("inf")).alias(f"{c}_has_inf"),
        ]
    return preds.agg(*aggs)
