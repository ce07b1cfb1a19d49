"""Models on ``pyspark.ml``: training sample, forest, tuning, ensembles, committees."""

from __future__ import annotations

import itertools
import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import cut
from .sampling import hash_sample_per_group


# ---- training data --------------------------------------------------------

def class_weights(df: DataFrame, label: str = "classification") -> DataFrame:
    """1/count per class, scaled so that the weights sum to the number of classes."""
    c = df.groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # classes only
    inv = F.lit(1.0) / F.col("n")
    return c.withColumn("weight", inv / F.sum(inv).over(w) * F.count(F.lit(1)).over(w))


def balanced_weights(df: DataFrame, label: str = "classification") -> DataFrame:
    """Adds ``weight`` = n / (classes * count of the class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0))
    c = c.withColumn("weight", F.sum("_n").over(w) / (F.count(F.lit(1)).over(w) * F.col("_n")))
    return df.join(F.broadcast(c.drop("_n")), label)


def balanced_sample(df: DataFrame, max_per_class: int = 50_000, min_per_class: int = 0, label: str = "classification", seed: int = 42) -> DataFrame:
    """At most / at least so many rows per class."""
    big = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_per_class)
    return hash_sample_per_group(df.join(F.broadcast(big.select(label)), label, "left_semi"), label, max_per_class, seed)


def stratified_split(df: DataFrame, fractions: tuple[float, float, float] = (0.7, 0.15, 0.15), label: str = "classification", seed: int = 42) -> DataFrame:
    """Adds ``part`` (train / val / test) with exact shares per class.

    The rank of a row inside its class is the count of all lower hash buckets
    plus its rank in its own bucket, so a class of any size is ranked without
    sorting it in one task.
    """
    h = df.withColumn("_h", hash_key(F.col("point_id"), seed)).withColumn("_b", F.shiftright("_h", 19))
    c = h.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_k"))
    below = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"_before": F.coalesce(F.sum("_k").over(below), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(label))}).drop("_k")
    h = h.join(c, [label, "_b"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", "point_id")) - 1
    h = h.withColumn("_r", rank / F.col("_n"))
    a, b = fractions[0], fractions[0] + fractions[1]
    part = F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "val").otherwise("test")
    return h.withColumn("part", part).drop("_h", "_b", "_before", "_n", "_r")


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """NULL / NaN features take the column mean."""
    return Imputer(inputCols=cols, outputCols=cols, strategy="mean").fit(df).transform(df)


# ---- models ---------------------------------------------------------------

def forest_pipeline(features: list[str], label: str = "classification", trees: int = 100, depth: int = 20, min_leaf: int = 2,
                    subset: str = "sqrt", seed: int = 42, weight: str | None = None) -> Pipeline:
    forest = RandomForestClassifier(featuresCol="scaled", labelCol="label_index", numTrees=trees, maxDepth=min(depth, 30),
                                    minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed)
    if weight:
        forest = forest.setWeightCol(weight)
    return Pipeline(stages=[*_prepare(features, label), forest])


def _prepare(features: list[str], label: str) -> list:
    return [StringIndexer(inputCol=label, outputCol="label_index", handleInvalid="keep", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)]


def second_pipeline(features: list[str], label: str = "classification", kind: str = "boosted", n_classes: int | None = None, seed: int = 42) -> Pipeline:
    """Second ensemble member: boosted trees one-vs-rest, or a small perceptron."""
    if kind == "perceptron":
        last = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label_index", layers=[len(features), 32, n_classes], maxIter=60, seed=seed)
    else:
        last = OneVsRest(featuresCol="scaled", labelCol="label_index",
                         classifier=GBTClassifier(maxIter=10, maxDepth=4, seed=seed, featuresCol="scaled", labelCol="label_index"))
    return Pipeline(stages=[*_prepare(features, label), last])


def labels_of(model: PipelineModel) -> list[int]:
    return [int(v) for s in model.stages if isinstance(s, StringIndexerModel) for v in s.labelsArray[0]]


def predict(model: PipelineModel, df: DataFrame, name: str = "forest") -> DataFrame:
    """point_id, model, y_pred, confidence and probabilities (class order of ``labels_of``)."""
    names = F.array(*[F.lit(v) for v in labels_of(model)])
    out = model.transform(df)
    probs = vector_to_array("probability") if "probability" in out.columns else F.array(F.lit(1.0))
    return out.select("point_id", F.lit(name).alias("model"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("y_pred"),
                      F.array_max(probs).alias("confidence"), probs.alias("probabilities"))


def importances(model: PipelineModel, features: list[str], spark, top: int | None = None) -> DataFrame:
    vals = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, (float(v) for v in vals)), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame(rows[:top] if top else rows, "feature string, importance double")


def cross_validate(df: DataFrame, features: list[str], folds: int = 5, grid: list[dict] | None = None, label: str = "classification",
                   seed: int = 42, parallelism: int = 2, **forest) -> DataFrame:
    """Accuracy per parameter set over hash folds: mean and deviation, best first."""
    df = df.withColumn("fold", F.pmod(hash_key(F.col("point_id"), seed), F.lit(folds)).cast("int"))
    prepared = Pipeline(stages=_prepare(features, label)).fit(df).transform(df).select("scaled", "label_index", "fold")
    rf = RandomForestClassifier(featuresCol="scaled", labelCol="label_index", seed=seed, **forest)
    maps = ParamGridBuilder().build() if not grid else [{getattr(rf, k): v for k, v in g.items()} for g in grid]
    cv = CrossValidator(estimator=rf, estimatorParamMaps=maps, numFolds=folds, foldCol="fold", parallelism=parallelism,
                        evaluator=MulticlassClassificationEvaluator(labelCol="label_index", metricName="accuracy"))
    m = cv.fit(prepared)
    rows = [(i, str(sorted((g or {}).items())), float(a), float(s)) for i, (g, a, s) in enumerate(zip(grid or [{}], m.avgMetrics, m.stdMetrics))]
    return df.sparkSession.createDataFrame(rows, "trial int, params string, mean_accuracy double, std_accuracy double").orderBy(F.desc("mean_accuracy"), "trial")


# fixed values: reference parameter names and their Spark counterparts
PARAM_NAMES = {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "max_features": "featureSubsetStrategy"}


def spaced(low: float, high: float, n: int, log: bool = False, integer: bool = False) -> list:
    """Evenly (or log-evenly) spaced grid values."""
    step = (lambda i: i / (n - 1)) if n > 1 else (lambda i: 0.0)
    vals = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * step(i)) if log else low + (high - low) * step(i) for i in range(n)]
    return [int(v + 1e-9) for v in vals] if integer else vals


def grid_search(space: dict[str, list]) -> list[dict]:
    names = list(space)
    return [{PARAM_NAMES.get(n, n): v for n, v in zip(names, combo)} for combo in itertools.product(*(space[n] for n in names))]


def random_search(space: dict[str, tuple | list], trials: int, seed: int = 42) -> list[dict]:
    """Seeded draws: (low, high) tuples are ranges, lists are choices."""
    rnd = random.Random(seed)
    out = []
    for _ in range(trials):
        one = {}
        for n, v in space.items():
            if isinstance(v, tuple):
                one[PARAM_NAMES.get(n, n)] = rnd.randint(*v) if all(isinstance(x, int) for x in v) else rnd.uniform(*v)
            else:
                one[PARAM_NAMES.get(n, n)] = rnd.choice(v)
        out.append(one)
    return out


def train(df: DataFrame, features: list[str], label: str = "classification", max_per_class: int = 50_000, min_per_class: int = 100,
          path: str | None = None, seed: int = 42, **forest) -> tuple[PipelineModel, DataFrame]:
    """Sample, split, fit, evaluate, optionally save; returns the model and test predictions."""
    # weights, scaling, fit and scores read the sample again and again: the cloud is read for it once
    sample = balanced_sample(df, max_per_class, min_per_class, label, seed).select("point_id", label, *features).na.drop(subset=features)
    data = cut(stratified_split(cut(sample), label=label, seed=seed))
    fit_on = balanced_weights(data.where("part = 'train'"), label)
    model = forest_pipeline(features, label, seed=seed, weight="weight", **forest).fit(fit_on)
    test = data.where("part = 'test'")
    scored = predict(model, test).join(test.select("point_id", F.col(label).alias("y_true")), "point_id")
    if path:
        model.write().overwrite().save(path)
    return model, scored


# ---- ensembles ------------------------------------------------------------

def hard_vote(pred: DataFrame) -> DataFrame:
    """Mode per point (ties: smallest class) with the share of models that agree."""
    c = pred.groupBy("point_id", "y_pred").agg(F.count(F.lit(1)).alias("k"))
    g = c.groupBy("point_id").agg(F.max(F.struct("k", (-F.col("y_pred")).alias("v"))).alias("b"), F.sum("k").alias("n"))
    return g.select("point_id", (-F.col("b.v")).cast("int").alias("y_pred"), (F.col("b.k") / F.col("n")).alias("confidence"))


def soft_vote(pred: DataFrame, first: str, second: str) -> DataFrame:
    """The surer model wins; on equality the first one."""
    return weighted_vote(pred, first, second, 1.0, 1.0, keep_max=True)


def weighted_vote(pred: DataFrame, first: str, second: str, w1: float = 0.5, w2: float = 0.5, keep_max: bool = False) -> DataFrame:
    """Winner by weight * confidence; confidence is the weighted mean (or the larger one)."""
    at = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    g = pred.groupBy("point_id").agg(at(first, "y_pred").alias("p1"), at(second, "y_pred").alias("p2"),
                                     at(first, "confidence").alias("c1"), at(second, "confidence").alias("c2"))
    a, b = F.col("c1") * w1, F.col("c2") * w2
    conf = F.greatest("c1", "c2") if keep_max else (a + b) / F.lit(w1 + w2)
    return g.select("point_id", F.when(b > a, F.col("p2")).otherwise(F.col("p1")).cast("int").alias("y_pred"), conf.alias("confidence"))


def mean_probabilities(pred: DataFrame) -> DataFrame:
    """Element-wise mean of the models' probability arrays."""
    e = pred.select("point_id", F.posexplode("probabilities").alias("i", "p")).groupBy("point_id", "i").agg(F.avg("p").alias("p"))
    return e.groupBy("point_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]).alias("probabilities"))


def committee(df: DataFrame, features: list[str], members: int = 5, label: str = "classification", seed: int = 42,
              base_trees: int = 50, tree_step: int = 20, base_depth: int = 15, depth_step: int = 2) -> list[PipelineModel]:
    """Forests on bootstrap samples; the copies of a row follow from its hash (Poisson weights).

    The hash is not the one that samples are drawn by: rows chosen for small
    values of that one would all get the same number of copies, or none.
    """
    out = []
    for i in range(members):
        u = F.shiftrightunsigned(F.xxhash64("point_id", F.lit(seed + i)), 11) / F.lit(float(1 << 53))
        # cumulative Poisson(1): number of copies of a row in a large bootstrap
        cum, k, p, copies = 0.0, 0, math.exp(-1), F.lit(6)
        bounds = []
        for k in range(6):
            cum += math.exp(-1) / math.factorial(k)
            bounds.append((cum, k))
        expr = None
        for c, k in bounds:
            expr = F.when(u < c, k) if expr is None else expr.when(u < c, k)
        boot = df.withColumn("bootstrap", expr.otherwise(copies).cast("double")).where("bootstrap > 0")
        out.append(forest_pipeline(features, label, base_trees + tree_step * i, base_depth + depth_step * i, seed=seed + i, weight="bootstrap").fit(boot))
    return out


def vote_entropy(pred: DataFrame, n: int) -> DataFrame:
    """Points on which the models disagree most."""
    c = pred.groupBy("point_id", "y_pred").agg(F.count(F.lit(1)).alias("k"))
    t = c.groupBy("point_id").agg(F.sum("k").alias("n"), F.collect_list("k").alias("ks"))  # one entry per model at most
    h = F.aggregate("ks", F.lit(0.0), lambda acc, k: acc - (k / F.col("n")) * F.log(k / F.col("n") + F.lit(1e-10)))
    return t.select("point_id", h.alias("disagreement")).orderBy(F.desc("disagreement"), "point_id").limit(n)
