"""Multiclass, multilabel, ranking and regression evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.operators.curves import f_measure
from corpuslab.operators.features import classes_of


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """label, prediction, n."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame) -> DataFrame:
    """One row per label, one column per predicted class, 0 where nothing was counted."""
    columns = classes_of(counts, "prediction")
    cells = [F.coalesce(F.sum(F.when(F.col("prediction") == c, F.col("n"))), F.lit(0)).alias(f"as_{c}") for c in columns]
    return counts.groupBy("label").agg(*cells)


def confusion_shares(counts: DataFrame) -> DataFrame:
    """Adds the share of each cell in its label, and the share's z-score among the cells of its prediction.

    Windows run over the confusion table, classes by classes in size.
    """
    share = F.col("n") / F.sum("n").over(Window.partitionBy("label"))
    shared = counts.withColumn("share", share)
    column = Window.partitionBy("prediction")
    z = F.try_divide(F.col("share") - F.avg("share").over(column), F.stddev_samp("share").over(column))
    return shared.withColumn("z", z)


def label_metrics(counts: DataFrame) -> DataFrame:
    """Per label: support, tp, fp, fn, precision, recall, fpr, f1; labels never seen or never predicted get 0."""
    by_label = counts.groupBy("label").agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp")
    )
    by_prediction = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = by_label.join(by_prediction, "label", "full_outer").na.fill(0, ["support", "tp", "predicted"])
    total = counts.agg(F.sum("n").alias("t")).scalar()
    fp, fn = F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp")
    zero = F.lit(0.0)
    out = joined.select(
        "label",
        "support",
        "tp",
        fp.alias("fp"),
        fn.alias("fn"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp").cast("double"), "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(fp.cast("double"), total - F.col("support")), zero).alias("fpr"),
    )
    return out.withColumn("f1", f_measure(F.col("precision"), F.col("recall"), 1.0)).withColumn(
        "f05", f_measure(F.col("precision"), F.col("recall"), 0.5)
    )


def weighted_metrics(per_label: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, FPR and F1."""
    n = F.sum("support").cast("double")

    def mean(name: str) -> Column:
        return (F.sum(F.col("support") * F.col(name)) / n).alias(f"weighted_{name}")

    return per_label.agg(
        (F.sum("tp") / n).alias("accuracy"), mean("precision"), mean("recall"), mean("fpr"), mean("f1"), mean("f05")
    )


def metric_rows(per_label: DataFrame) -> DataFrame:
    """metric, label, value: the long form reports are exported in."""
    names = ["precision", "recall", "fpr", "f1"]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return per_label.select(F.col("label").cast("string").alias("label"), F.explode(cells).alias("c")).select(
        "c.metric", "label", "c.value"
    )


def _overlap(predicted: str, actual: str) -> Column:
    return F.size(F.array_intersect(predicted, actual)).cast("double")


def multilabel_metrics(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Document averages, micro averages, Hamming loss and subset accuracy."""
    both = _overlap(predicted, actual)
    p, a = F.size(predicted).cast("double"), F.size(actual).cast("double")
    zero = F.lit(0.0)
    n_labels = rows.select(F.explode(actual).alias("l")).agg(F.count_distinct("l").alias("n")).scalar()
    micro_p, micro_r = F.try_divide(F.sum(both), F.sum(p)), F.try_divide(F.sum(both), F.sum(a))
    return rows.agg(
        F.avg(F.coalesce(F.try_divide(both, p), zero)).alias("precision"),
        F.avg(F.coalesce(F.try_divide(both, a), zero)).alias("recall"),
        F.avg(F.coalesce(F.try_divide(2 * both, p + a), zero)).alias("f1"),
        F.avg(F.coalesce(F.try_divide(both, p + a - both), zero)).alias("accuracy"),
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        F.try_divide(2 * F.sum(both), F.sum(p) + F.sum(a)).alias("micro_f1"),
        (F.sum(p + a - 2 * both) / (F.count("*") * F.any_value(n_labels))).alias("hamming_loss"),
        F.avg(((both == p) & (both == a)).cast("double")).alias("subset_accuracy"),
    )


def multilabel_by_label(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Per label: precision, recall, f1."""
    flags = F.transform(
        F.array_union(predicted, actual),
        lambda x: F.struct(
            x.alias("label"), F.array_contains(predicted, x).alias("p"), F.array_contains(actual, x).alias("a")
        ),
    )
    flat = rows.select(F.explode(flags).alias("f")).select("f.*")
    tp = F.count_if(F.col("p") & F.col("a")).cast("double")
    out = flat.groupBy("label").agg(
        F.coalesce(F.try_divide(tp, F.count_if("p")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.count_if("a")), F.lit(0.0)).alias("recall"),
    )
    return out.withColumn("f1", f_measure(F.col("precision"), F.col("recall"), 1.0))


def ranking_metrics(recommended: DataFrame, relevant: DataFrame, user: str, item: str, cuts=(1, 3, 5)) -> DataFrame:
    """Precision and NDCG at each cut, and mean average precision.

    ``recommended`` holds user, item and rank from 1; ``relevant`` holds distinct
    user, item pairs. Both stay long: a user's relevant items are counted, never
    gathered. Users with recommendations count, with 0 where nothing is relevant.
    """
    needed = relevant.groupBy(user).agg(F.count("*").alias("n_relevant"))
    hits = recommended.join(relevant.select(user, item, F.lit(1).alias("hit")), [user, item], "left")
    order = Window.partitionBy(user).orderBy("rank")
    # A user's recommendations are a fixed number of rows.
    ranked = hits.select(user, "rank", F.coalesce("hit", F.lit(0)).alias("hit")).withColumn("_so_far", F.sum("hit").over(order))
    gain = F.lit(1.0) / F.log(F.col("rank") + 1.0)
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"_h{k}") for k in cuts]
    gains = [F.sum(F.when(F.col("rank") <= k, F.col("hit") * gain).otherwise(0.0)).alias(f"_g{k}") for k in cuts]
    precise = F.sum(F.col("hit") * F.col("_so_far") / F.col("rank")).alias("_precise")
    users = ranked.groupBy(user).agg(*sums, *gains, precise).join(needed, user, "left").na.fill(0, ["n_relevant"])

    def ideal(k: int) -> Column:
        terms = [F.when(F.col("n_relevant") >= i, F.lit(1.0) / F.log(F.lit(i + 1.0))).otherwise(0.0) for i in range(1, k + 1)]
        return sum(terms[1:], terms[0])

    zero = F.lit(0.0)
    return users.agg(
        *[F.avg(F.col(f"_h{k}") / k).alias(f"precision_at_{k}") for k in cuts],
        *[F.avg(F.coalesce(F.try_divide(F.col(f"_g{k}"), ideal(k)), zero)).alias(f"ndcg_at_{k}") for k in cuts],
        F.avg(F.coalesce(F.try_divide(F.col("_precise"), "n_relevant"), zero)).alias("map"),
    )


def regression_metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE, RMSE, MAE, R2 and explained variance in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    gap = y - p
    mse = F.avg(gap * gap)
    bias = F.avg(p) - F.avg(y)
    return rows.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        (F.var_pop(p) + bias * bias).alias("explained_variance"),
    )


def error_slice(rows: DataFrame, label: str, prediction: str, kind: str) -> DataFrame:
    """The true or false positives or negatives: kind is tp, tn, fp or fn."""
    want = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}[kind]
    return rows.where((F.col(label) == want[0]) & (F.col(prediction) == want[1]))


def error_kinds(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """The rows with kind: tp, tn, fp or fn, all in one pass."""
    right = F.col(label) == F.col(prediction)
    kind = F.when(right, F.when(F.col(label) == 1, "tp").otherwise("tn")).otherwise(F.when(F.col(label) == 0, "fp").otherwise("fn"))
    return rows.withColumn("kind", kind)
