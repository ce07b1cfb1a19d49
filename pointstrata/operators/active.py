"""Active learning: which points to label next, corrections, retraining sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import cut


def entropy(probabilities: Column) -> Column:
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - p * F.log(p + F.lit(1e-10)))


def margin(probabilities: Column) -> Column:
    s = F.sort_array(probabilities, asc=False)
    return s[0] - s[1]


def uncertain(pred: DataFrame, n: int, strategy: str = "least_confident", corrected: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """The n points to label next, with their ``score``; corrected points are left out."""
    if corrected is not None:
        pred = pred.join(corrected.select("point_id").distinct(), "point_id", "left_anti")
    has_probs = "probabilities" in pred.columns
    conf = F.col("confidence")
    score, asc = {
        "least_confident": (conf, True),
        "margin": (margin(F.col("probabilities")) if has_probs else conf, True),
        "entropy": (entropy(F.col("probabilities")) if has_probs else F.lit(1.0) - conf, not has_probs),
        "random": (hash_key(F.col("point_id"), seed).cast("double"), True),
    }[strategy]
    p = pred.withColumn("score", score)
    return p.orderBy(F.col("score").asc() if asc else F.col("score").desc(), "point_id").limit(n)


def diverse(pred: DataFrame, points: DataFrame, n: int, candidates: int | None = 1000, corrected: DataFrame | None = None) -> DataFrame:
    """Greedy farthest-point choice among the ``candidates`` least confident points (None: all).

    Each round is one pass over the candidates: the distance to the nearest
    chosen point, then the row that maximises it; ties go to the less confident.
    """
    if corrected is not None:
        pred = pred.join(corrected.select("point_id").distinct(), "point_id", "left_anti")
    c = uncertain(pred, candidates) if candidates else pred.withColumn("score", F.col("confidence"))
    c = cut(c.select("point_id", "score").join(points.select("point_id", "x", "y", "z"), "point_id"))
    order = F.struct("score", "point_id", "x", "y", "z")
    chosen = []
    while len(chosen) < n:
        rest = c
        if chosen:
            rest = c.where(~F.col("point_id").isin([r["point_id"] for r in chosen]))
            away = [sum(((F.col(a) - F.lit(r[a])) * (F.col(a) - F.lit(r[a])) for a in "xyz"), F.lit(0.0)) for r in chosen]
            far = F.least(*away) if len(away) > 1 else away[0]
            best = rest.agg(F.min(F.struct((-far).alias("far"), order.alias("row"))).alias("b")).select("b.row.*")
        else:
            best = rest.agg(F.min(order).alias("b")).select("b.*")
        row = best.first()
        if row["point_id"] is None:
            break
        chosen.append(row)
    return pred.sparkSession.createDataFrame([(i, r["point_id"]) for i, r in enumerate(chosen, 1)], "pick int, point_id bigint")


def latest(corrections: DataFrame) -> DataFrame:
    """Last label per point (by seq)."""
    return corrections.groupBy("point_id").agg(F.max_by("new_label", "seq").alias("new_label"))


def apply_corrections(points: DataFrame, corrections: DataFrame, label: str = "classification") -> DataFrame:
    return points.join(latest(corrections), "point_id", "left").withColumn(label, F.coalesce("new_label", label).cast("int")).drop("new_label")


def correction_log(pred: DataFrame, picks: DataFrame, session: str) -> DataFrame:
    """Correction rows for picked points (point_id, new_label)."""
    p = picks.join(pred.select("point_id", F.col("y_pred").alias("old_label"), F.col("confidence").alias("confidence_before")), "point_id")
    return p.select(F.lit(session).alias("session"), F.col("point_id").alias("seq"), "point_id", "old_label", "new_label", "confidence_before")


def correction_statistics(corrections: DataFrame) -> DataFrame:
    """Corrections by ``old->new``; totals on the row named ``all``."""
    key = F.concat_ws("->", "old_label", "new_label")
    g = corrections.withColumn("change", key).rollup("change").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("point_id").alias("unique_points"))
    return g.select(F.coalesce("change", F.lit("all")).alias("change"), "n", "unique_points")


def improvement(pred: DataFrame, corrections: DataFrame) -> DataFrame:
    """What the corrections are worth: wrong predictions fixed, gain, current accuracy."""
    j = pred.join(latest(corrections), "point_id", "left")
    truth = F.coalesce("new_label", "y_true")
    fixed = F.count(F.when(F.col("new_label").isNotNull() & (F.col("new_label") != F.col("y_pred")), 1))
    n = F.count(F.lit(1))
    return j.agg(F.count("new_label").alias("corrected_points"), fixed.alias("wrong_predictions_fixed"),
                 (fixed / n * 100).alias("potential_accuracy_gain"), (F.avg((truth == F.col("y_pred")).cast("double")) * 100).alias("current_accuracy"))


def retrain_set(points: DataFrame, corrections: DataFrame, factor: int = 5) -> DataFrame:
    """All points plus every corrected one ``factor`` more times."""
    done = apply_corrections(points, corrections)
    extra = done.join(corrections.select("point_id").distinct(), "point_id", "left_semi")
    extra = extra.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(factor)))).drop("_i")
    return done.unionByName(extra)


def save_session(corrections: DataFrame, path: str) -> None:
    corrections.write.mode("append").partitionBy("session").parquet(path)


def load_session(spark, path: str, session: str) -> DataFrame:
    return cut(spark.read.parquet(path).where(F.col("session") == session))
