"""Binary evaluation: counts at a threshold, curves over all thresholds, areas.

Curves first shrink to one row per distinct score, then use range-partitioned
running totals, so a class of any size never sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import clip
from corpuslab.operators.ordering import running_totals, with_row_index

# Fixed value: distance kept from 0 and 1 before taking logarithms.
LOG_LOSS_MARGIN = 1e-14


def log_loss(rows: DataFrame, label: str, prob: str) -> DataFrame:
    p = clip(F.col(prob).cast("double"), LOG_LOSS_MARGIN, 1.0 - LOG_LOSS_MARGIN)
    y = F.col(label).cast("double")
    return rows.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def mean_squared_error(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    gap = F.col(label).cast("double") - F.col(prediction).cast("double")
    return rows.agg(F.avg(gap * gap).alias("mse"))


def counts_at(rows: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """tp, tn, fp, fn, n; a score equal to the threshold is negative. Labels must be 0 or 1."""
    y, yes = F.col(label).cast("double"), F.col(score) > threshold
    y = F.when(y.isin(0.0, 1.0), y).otherwise(F.raise_error(F.lit("label must be 0 or 1")))
    return rows.agg(
        F.count_if((y == 1.0) & yes).alias("tp"),
        F.count_if((y == 0.0) & ~yes).alias("tn"),
        F.count_if((y == 0.0) & yes).alias("fp"),
        F.count_if((y == 1.0) & ~yes).alias("fn"),
        F.count("*").alias("n"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision and recall from tp, tn, fp, fn; null where undefined."""
    return counts.select(
        "*",
        F.try_divide((F.col("tp") + F.col("tn")).cast("double"), "n").alias("accuracy"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"),
    )


def threshold_counts(rows: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """by, threshold, pos, neg, tp, fp, n_pos, n_neg for each distinct score.

    pos and neg are the rows at the score itself; tp and fp those at or above it.
    """
    by = list(by)
    yes = F.col(label).cast("double") == 1.0
    distinct = rows.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.count_if(yes).alias("pos"), F.count_if(~yes).alias("neg")
    )
    curve = running_totals(distinct, [F.desc("threshold")], {"tp": "pos", "fp": "neg"}, by)
    totals = curve.groupBy(*by).agg(F.max("tp").alias("n_pos"), F.max("fp").alias("n_neg"))
    if by:
        return curve.join(totals, by)
    return curve.select("*", totals.select("n_pos").scalar().alias("n_pos"), totals.select("n_neg").scalar().alias("n_neg"))


def f_measure(precision: Column, recall: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * precision * recall, b2 * precision + recall), F.lit(0.0))


def threshold_metrics(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and F0.5 at each threshold."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp").cast("double"), "n_pos")
    return curve.select(
        *by,
        "threshold",
        precision.alias("precision"),
        recall.alias("recall"),
        f_measure(precision, recall, 1.0).alias("f1"),
        f_measure(precision, recall, 0.5).alias("f05"),
    )


def roc_points(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return curve.select(
        *by,
        "threshold",
        F.try_divide(F.col("fp").cast("double"), "n_neg").alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), "n_pos").alias("tpr"),
    )


def areas(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Areas under the ROC and the precision-recall curve.

    A point's predecessor is the point minus its own row counts, so trapezoids
    need no neighbouring row. The precision-recall curve starts at recall 0 with
    the first precision.
    """
    before = F.col("tp") - F.col("pos")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    earlier = F.try_divide(before.cast("double"), before + F.col("fp") - F.col("neg"))
    roc = F.sum(F.col("neg") * (before + F.col("pos") / 2.0))
    pr = F.sum(F.col("pos") * (precision + F.coalesce(earlier, precision)) / 2.0)
    positives, negatives = F.max("n_pos"), F.max("n_neg")
    return curve.groupBy(*by).agg(
        F.try_divide(roc, positives.cast("double") * negatives).alias("roc_area"),
        F.try_divide(pr, positives).alias("pr_area"),
    )


def one_vs_rest_rows(scored: DataFrame, doc: str, label: str) -> DataFrame:
    """doc, class, hit, score: each class against the rest; a row fans out to its classes only."""
    pairs = F.arrays_zip("classes", "scores")
    flat = scored.select(doc, label, F.explode(pairs).alias("p"))
    return flat.select(
        doc,
        F.col("p.classes").alias("class"),
        (F.col(label) == F.col("p.classes")).cast("int").alias("hit"),
        F.col("p.scores").alias("score"),
    )


def macro_roc(curve: DataFrame, by: str) -> DataFrame:
    """fpr, tpr: the class curves averaged over the union of their false positive rates.

    Each class curve is a sum of steps and slopes. Their changes, added up over
    all classes and summed along the rate axis, give the average at every point
    directly, so points are never crossed with classes.
    """
    n_classes = curve.agg(F.count_distinct(by).cast("double").alias("k")).scalar()
    x = F.col("fp") / F.col("n_neg").cast("double")
    x_before = (F.col("fp") - F.col("neg")) / F.col("n_neg").cast("double")
    rise = F.col("pos") / F.col("n_pos").cast("double")
    slope = F.try_divide(rise, F.col("neg") / F.col("n_neg").cast("double"))

    def event(at: Column, jump: Column, turn: Column) -> Column:
        return F.struct(at.alias("x"), jump.alias("j"), turn.alias("s"), (turn * at).alias("sx"))

    none = F.lit(0.0)
    flat = F.col("neg") == 0
    events = F.array(
        event(x_before, none, F.when(flat, none).otherwise(slope)),
        event(x, F.when(flat, rise).otherwise(none), F.when(flat, none).otherwise(-slope)),
        event(none, none, none),
    )
    changes = curve.select(F.explode(events).alias("e")).select("e.*").groupBy("x").agg(
        F.sum("j").alias("j"), F.sum("s").alias("s"), F.sum("sx").alias("sx")
    )
    summed = running_totals(changes, [F.asc("x")], {"cj": "j", "cs": "s", "csx": "sx"})
    height = (F.col("cj") + F.col("x") * F.col("cs") - F.col("csx")) / n_classes
    return summed.select(F.col("x").alias("fpr"), height.alias("tpr"))


def area_between(points: DataFrame, x: str, y: str, name: str = "area") -> DataFrame:
    """Trapezoid area under a curve of distinct ``x``, joining each point to the next one."""
    numbered = with_row_index(points.select(x, y), F.asc(x))
    following = numbered.select((F.col("idx") - 1).alias("idx"), F.col(x).alias("_x2"), F.col(y).alias("_y2"))
    strip = (F.col("_x2") - F.col(x)) * (F.col(y) + F.col("_y2")) / 2.0
    return numbered.join(following, "idx").agg(F.sum(strip).alias(name))
