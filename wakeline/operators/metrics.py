"""Segmentation metrics, losses and training summaries over rows instead of tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import sigmoid

TINY = 1e-8


def sample_metrics(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, IoU and Dice of each sample, from cells (sample, logit, target)."""
    pred, true = sigmoid("logit") >= threshold, F.col("target") >= 0.5
    sums = cells.groupBy("sample").agg(F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"), F.count_if(~pred & true).alias("fn"), F.avg(pred.cast("double")).alias("pred_pos"), F.avg(true.cast("double")).alias("target_pos"))
    ratio = lambda top, bottom: top / (bottom + TINY)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("sample", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp + fn).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), "pred_pos", "target_pos")


def mean_metrics(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    names = ("precision", "recall", "iou", "dice", "pred_pos", "target_pos")
    return sample_metrics(cells, threshold).agg(*(F.avg(n).alias(n) for n in names))


def positive_weight(cells: DataFrame) -> DataFrame:
    """Negative over positive cells, at least 1; 1 where none is positive."""
    pos, neg = F.count_if(F.col("target") >= 0.5), F.count_if(F.col("target") < 0.5)
    return cells.agg(F.when(pos > 0, F.greatest(F.lit(1.0), F.try_divide(neg, pos))).otherwise(1.0).alias("pos_weight"))


def losses(cells: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Mean binary cross-entropy with logits, and soft Dice loss per sample."""
    x, y, p = F.col("logit"), F.col("target"), sigmoid("logit")
    bce = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    return cells.groupBy("sample").agg(F.avg(bce).alias("bce"), (1 - (2 * F.sum(p * y) + smooth) / (F.sum(p) + F.sum(y) + smooth)).alias("dice_loss"))


def clean_history(history: DataFrame) -> DataFrame:
    """Numbers from text, rows without an epoch dropped, by epoch."""
    numbers = {c: F.col(c).try_cast("double") for c in history.columns}
    return history.withColumns(numbers).where("epoch is not null").withColumn("epoch", F.col("epoch").cast("int")).orderBy("epoch")


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch of the highest validation IoU."""
    return history.agg(F.max_by("epoch", F.struct("val_iou", -F.col("epoch"))).alias("best_epoch"), F.max("val_iou").alias("best_val_iou"))
