"""Classification metrics as DataFrame operators.

They take any prediction table -- (label, prediction) and, for ROC, a
score -- so they work on a model's output and on stored predictions alike.
Zero denominators give 0 (the common library default).

ROC-AUC is exact: counts of positives and negatives per distinct score,
running negative counts in score order (``prefix_sums``: range-partitioned,
no one-task window), then

    AUC = sum_s pos_s * (neg_below_s + neg_s / 2) / (P * N)

which equals the pairwise (Mann-Whitney) definition with ties counted half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.operators.stats import prefix_sums


def _zdiv(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def confusion_counts(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(tn, fp, fn, tp) in one aggregation pass."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return pred.agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1 plus the confusion counts."""
    c = confusion_counts(pred, label, prediction)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    precision = _zdiv(tp, tp + fp)
    recall = _zdiv(tp, tp + fn)
    return c.select(
        "tn", "fp", "fn", "tp",
        _zdiv(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _zdiv(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    c = confusion_counts(pred, label, prediction)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    # class 1: positives as is; class 0: roles swapped
    per = {
        "0": (_zdiv(tn, tn + fn), _zdiv(tn, tn + fp), _zdiv(2 * tn, 2 * tn + fn + fp), tn + fp),
        "1": (_zdiv(tp, tp + fp), _zdiv(tp, tp + fn), _zdiv(2 * tp, 2 * tp + fp + fn), tp + fn),
    }
    n = tn + fp + fn + tp
    rows = []
    for cls, (pr, rc, f1, sup) in per.items():
        rows.append(F.struct(F.lit(cls).alias("class"), pr.alias("precision"), rc.alias("recall"), f1.alias("f1"), sup.cast("long").alias("support")))
    p0, r0, f0, s0 = per["0"]
    p1, r1, f1_, s1 = per["1"]
    rows.append(F.struct(F.lit("macro avg").alias("class"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                         ((f0 + f1_) / 2).alias("f1"), n.cast("long").alias("support")))
    rows.append(F.struct(F.lit("weighted avg").alias("class"), _zdiv(p0 * s0 + p1 * s1, n).alias("precision"),
                         _zdiv(r0 * s0 + r1 * s1, n).alias("recall"), _zdiv(f0 * s0 + f1_ * s1, n).alias("f1"),
                         n.cast("long").alias("support")))
    return c.select(F.inline(F.array(*rows)))


def score_histogram(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (map-side combined)."""
    y = F.col(label).cast("int")
    return pred.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )


def roc_auc(pred: DataFrame, label: str = "label", score: str = "score", num_partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half), one row. ``num_partitions``: tasks
    that order the scores (the session's shuffle partitions)."""
    h = prefix_sums(score_histogram(pred, label, score), ["score"], ["pos", "neg"], num_partitions=num_partitions)
    one = h.agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("__u"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
    )
    return one.select(
        F.col("n_pos").cast("long").alias("n_pos"),
        F.col("n_neg").cast("long").alias("n_neg"),
        F.try_divide(F.col("__u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("roc_auc"),
    )


def roc_points(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC curve points, one per distinct threshold (score >= t)."""
    h = score_histogram(pred, label, score).withColumn("neg_score", -F.col("score"))
    c = prefix_sums(h, ["neg_score"], ["pos", "neg"])
    return c.select(
        F.col("score").alias("threshold"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
    )


def roc_curve(pred: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """The ROC curve without the points that lie on the straight line
    between their neighbours; the area stays the same.

    A point between two steps of one direction is dropped (compared in whole
    numbers: dp1 * dn2 = dp2 * dn1). The next step stands in the next row
    of the range-sorted histogram; for a partition's last row it is the first row of the next
    partition, from a table of one row per partition that is broadcast.
    """
    from startlens.session import materialize

    h = score_histogram(pred, label, score).withColumn("neg_score", -F.col("score"))
    c = prefix_sums(h, ["neg_score"], ["pos", "neg"])
    n = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = materialize(c.repartitionByRange(n, "neg_score").sortWithinPartitions("neg_score").withColumn("__pid", F.spark_partition_id()), "roc")
    step = F.struct("pos", "neg")
    # each partition's first step, for the one before it (empty partitions have no row)
    firsts = c.groupBy("__pid").agg(F.min_by(step, "neg_score").alias("__first"))
    firsts = firsts.withColumn("__after", F.lead("__first").over(Window.orderBy("__pid"))).drop("__first")
    inside = Window.partitionBy("__pid").orderBy("neg_score")
    c = c.join(F.broadcast(firsts), "__pid").withColumn("__next", F.coalesce(F.lead(step).over(inside), F.col("__after")))
    bend = F.col("pos") * F.col("__next")["neg"] != F.col("__next")["pos"] * F.col("neg")
    return c.where(F.coalesce(bend, F.lit(True))).select(
        F.col("score").alias("threshold"),
        F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
        F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.col("pos_total").cast("double")).alias("tpr"),
    )


def majority_baseline(labels: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of always predicting the most frequent class."""
    y = F.col(label).cast("int")
    one = labels.agg(F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0"))
    return one.select(
        F.when(F.col("n1") >= F.col("n0"), 1).otherwise(0).alias("majority_class"),
        _zdiv(F.greatest("n1", "n0"), F.col("n1") + F.col("n0")).alias("baseline_accuracy"),
    )
