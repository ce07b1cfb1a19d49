"""Class histograms, model metrics, comparison and error analysis.

Prediction rows are long: point_id, model, y_true, y_pred, confidence.  Every
metric derives from one count per (model, true, predicted), so the data is
read once and everything after it is a tiny table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import dbscan
from .neighbours import XYZ, nearest

_ALL = lambda: Window.partitionBy(F.lit(0))  # noqa: E731  (class tables only)


def class_histogram(points: DataFrame, label: str = "classification") -> DataFrame:
    c = points.groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("percentage", F.col("count") / F.sum("count").over(_ALL()) * 100)


def classified_summary(points: DataFrame, label: str = "classification") -> DataFrame:
    n, done = F.count(F.lit(1)), F.count(F.when(F.col(label) != 1, 1))
    return points.agg(done.alias("classified_count"), (done / n * 100).alias("classified_percentage"),
                      (n - done).alias("unclassified_count"), ((n - done) / n * 100).alias("unclassified_percentage"))


def height_by_class(points: DataFrame, label: str = "classification") -> DataFrame:
    return points.groupBy(F.col(label).alias("class_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Equal-width histogram; the top edge belongs to the last bin."""
    w = (high - low) / bins if high > low else 1.0
    b = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(w)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("lower", F.lit(low) + F.col("bin") * F.lit(w))


def merge_counts(parts: DataFrame) -> DataFrame:
    """Per-chunk class counts (chunk_id, class_id, count) to cloud totals."""
    t = parts.groupBy("class_id").agg(F.sum("count").cast("long").alias("count"))
    return t.withColumn("percentage", F.col("count") / F.sum("count").over(_ALL()) * 100)


def quality_score(summary: DataFrame, n_classes: Column, points_per_second: Column) -> DataFrame:
    score = (F.col("classified_percentage") * 0.4 + F.least(n_classes / 10, F.lit(1.0)) * 30
             + F.least(points_per_second / 200000, F.lit(1.0)) * 30)
    return summary.withColumn("overall_score", F.least(F.lit(100.0), score))


def quality_advice(classified_pct: Column, n_classes: Column) -> Column:
    tips = F.array(F.when(classified_pct < 50, "low_coverage"), F.when(classified_pct < 80, "partly_unclassified"),
                   F.when(n_classes < 5, "few_classes"), F.when(n_classes >= 10, "rich_classes"))
    some = F.filter(tips, lambda t: t.isNotNull())
    return F.when(F.size(some) == 0, F.array(F.lit("no_remarks"))).otherwise(some)


# ---- metrics --------------------------------------------------------------

def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, IoU and support per model and class of true or predicted."""
    t = conf.groupBy("model", F.col("y_true").alias("class_id")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))).alias("tp"))
    p = conf.groupBy("model", F.col("y_pred").alias("class_id")).agg(F.sum("n").alias("predicted"))
    m = t.join(p, ["model", "class_id"], "full").na.fill(0, ["support", "tp", "predicted"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    m = m.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support")),
                       "iou": ratio(F.col("tp"), F.col("predicted") + F.col("support") - F.col("tp"))})
    return m.withColumn("f1_score", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def model_metrics(conf: DataFrame) -> DataFrame:
    c = class_metrics(conf)
    return c.groupBy("model").agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1_score").alias("macro_f1"), (F.sum(F.col("f1_score") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.sum("support").cast("long").alias("n"))


def best_model(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("accuracy"), "model").limit(1).select("model", "accuracy")


def agreement(pred: DataFrame) -> DataFrame:
    """Share of points on which two models agree, for every ordered pair of models.

    Model answers of one point meet in one row (one column per model), so the
    pairs are counted without joining the points to themselves.
    """
    models = sorted(r[0] for r in pred.select("model").distinct().collect())  # a handful of names
    wide = pred.groupBy("point_id").pivot("model", models).agg(F.first("y_pred"))
    aggs = [F.avg((F.col(f"`{a}`") == F.col(f"`{b}`")).cast("double")).alias(f"{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models)]
    one = wide.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"{i}_{j}").alias("agreement"))
                     for i, a in enumerate(models) for j, b in enumerate(models)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def agreement_ratio(pred: DataFrame) -> DataFrame:
    """Share of points on which all models agree."""
    g = pred.groupBy("point_id").agg((F.min("y_pred") == F.max("y_pred")).alias("same"))
    return g.agg(F.avg(F.col("same").cast("double")).alias("agreement_ratio"), F.count(F.lit(1)).alias("n_samples"))


def class_winners(conf: DataFrame) -> DataFrame:
    """Best F1 per class (ties: first model by name)."""
    c = class_metrics(conf)
    top = c.groupBy("class_id").agg(F.max("f1_score").alias("f1_score"))
    return c.join(top, ["class_id", "f1_score"]).groupBy("class_id", "f1_score").agg(F.min("model").alias("winner"))


def class_table(conf: DataFrame) -> DataFrame:
    """F1 per class, one column per model."""
    return class_metrics(conf).groupBy("class_id").pivot("model").agg(F.first("f1_score"))


def top_confusions(conf: DataFrame, n: int = 10) -> DataFrame:
    k = conf.where(F.col("y_true") != F.col("y_pred")).groupBy("y_true", "y_pred").agg(F.sum("n").cast("long").alias("n"))
    return k.select(F.concat_ws("->", "y_true", "y_pred").alias("confusion"), "n").orderBy(F.desc("n"), "confusion").limit(n)


# ---- errors ---------------------------------------------------------------

_wrong = lambda: F.col("y_true") != F.col("y_pred")


def error_statistics(pred: DataFrame) -> DataFrame:
    w = _wrong()
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_samples"), F.count(F.when(w, 1)).alias("total_errors"), F.avg(w.cast("double")).alias("error_rate"),
        F.avg(F.when(~w, F.col("confidence"))).alias("mean_conf_correct"), F.avg(F.when(w, F.col("confidence"))).alias("mean_conf_errors"))


def errors_by_class(pred: DataFrame) -> DataFrame:
    g = pred.where(_wrong()).groupingSets([["model", "y_true"], ["model", "y_pred"]], "model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return g.select("model", F.when(F.col("y_true").isNotNull(), "true").otherwise("pred").alias("side"),
                    F.coalesce("y_true", "y_pred").alias("class_id"), "n")


def boundary_errors(points: DataFrame, pred: DataFrame, k: int = 10) -> DataFrame:
    """Errors whose k neighbours carry several true classes, versus one."""
    bad = pred.where(_wrong()).select("point_id").distinct()
    q = points.join(bad, "point_id", "left_semi")
    near = nearest(q, points, k, carry=("classification",), exclude_self=True)
    mixed = F.size(F.array_distinct("n_classification")) > 1
    s = near.agg(F.count(F.when(mixed, 1)).alias("boundary_errors"), F.count(F.when(~mixed, 1)).alias("interior_errors"), F.count(F.lit(1)).alias("total_errors"))
    return s.withColumn("boundary_error_ratio", F.when(F.col("total_errors") > 0, F.col("boundary_errors") / F.col("total_errors")).otherwise(F.lit(0.0)))


def confidence_errors(pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    w, low = _wrong(), F.col("confidence") < threshold
    n = lambda c: F.count(F.when(c, 1))
    rate = lambda c: F.coalesce(F.try_divide(n(w & c), n(c)), F.lit(0.0))
    return pred.groupBy("model").agg(n(w & low).alias("low_conf_errors"), n(w & ~low).alias("high_conf_errors"),
                                     rate(low).alias("low_conf_error_rate"), rate(~low).alias("high_conf_error_rate"))


def error_clusters(points: DataFrame, pred: DataFrame, radius: float = 5.0, min_errors: int = 3) -> DataFrame:
    """Spatial clusters of errors: size, centre and dominant classes.

    Density clusters instead of a greedy scan, so the result does not depend on
    the order of rows.
    """
    bad = pred.where(_wrong()).select("point_id", "y_true", "y_pred")
    e = points.select("point_id", *XYZ).join(bad, "point_id")
    c = dbscan(e, radius, min_errors, XYZ)
    base = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.avg(a).alias(f"center_{a}") for a in "xyz"])
    for col, name in (("y_true", "dominant_true_class"), ("y_pred", "dominant_pred_class")):
        m = c.groupBy("cluster", col).agg(F.count(F.lit(1)).alias("k"))
        best = m.groupBy("cluster").agg(F.max(F.struct("k", (-F.col(col)).alias("v"))).alias("b")).select("cluster", (-F.col("b.v")).alias(name))
        base = base.join(best, "cluster")
    return base
