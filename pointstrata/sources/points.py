"""Point tables: scan, subset, chunks, metadata, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import colour
from ..operators.sampling import hash_sample

POINTS = T.StructType([
    T.StructField("file_id", T.StringType()), T.StructField("chunk_id", T.LongType()),
    T.StructField("point_id", T.LongType(), False), T.StructField("x", T.DoubleType(), False),
    T.StructField("y", T.DoubleType(), False), T.StructField("z", T.DoubleType(), False),
    T.StructField("red", T.DoubleType()), T.StructField("green", T.DoubleType()), T.StructField("blue", T.DoubleType()),
    T.StructField("intensity", T.DoubleType()), T.StructField("classification", T.IntegerType(), False)])


def read(spark: SparkSession, path: str, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Parquet point table, optionally a hash sample of it."""
    df = spark.read.parquet(path)
    return hash_sample(df, sample, seed) if sample else df


def normalise(raw: DataFrame, unit: str = "file_id") -> DataFrame:
    """16-bit colours to [0, 1]; intensity over the maximum of its unit (file or chunk).

    The unit maximum is a map-side-combined aggregate joined back, so a large
    file is never gathered in one task.
    """
    top = raw.groupBy(unit).agg(F.max("intensity").alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col("intensity") / F.col("_top")).otherwise(F.col("intensity").cast("double"))
    return raw.join(top, unit).withColumns(
        {c: colour.from_uint16(F.col(c)) for c in ("red", "green", "blue")} | {"intensity": scaled}).drop("_top")


def subset(points: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Points inside inclusive bounds on any of x, y, z (pushed down to Parquet)."""
    for axis, (lo, hi) in bounds.items():
        points = points.where(F.col(axis).between(F.lit(float(lo)), F.lit(float(hi))))
    return points


def chunks(points: DataFrame, size: int, total: int | None = None) -> DataFrame:
    """Adds chunk number, first and last position and progress for dense ids."""
    total = points.count() if total is None else total
    c = F.floor(F.col("point_id") / F.lit(size)).cast("long")
    end = F.least((c + 1) * F.lit(size), F.lit(total))
    return points.withColumns({"chunk": c, "start_idx": c * F.lit(size), "end_idx": end, "progress": end / F.lit(total) * 100})


def metadata(points: DataFrame) -> DataFrame:
    """Per file: count, bounds and whether colours exist."""
    return points.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_points"), *[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))],
        (F.count("red") > 0).alias("has_rgb"))


def discover(spark: SparkSession, folder: str, patterns: tuple[str, ...] = ("*.las", "*.laz"), by: str = "size") -> DataFrame:
    """Files of several extensions with size, ordered by size (largest last) or name."""
    glob = "{" + ",".join(patterns) + "}"
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    f = f.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", (F.col("length") / (1024 * 1024)).alias("size_mb"))
    return f.orderBy("length", "name") if by == "size" else f.orderBy("name")


#: Rows of a tile that one task writes as one file.
TILE_FILE_ROWS = 250_000


def write_tiles(points: DataFrame, path: str, key: str = "tile_id") -> None:
    """Parquet by tile; rows are clustered by tile first, so a tile is one file.

    Only a tile of more than ``TILE_FILE_ROWS`` rows is spread over several writers
    (ids decide), so the number of files follows the tiles and the rows.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = points.groupBy(F.col(key).alias("_t")).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_FILE_ROWS)).alias("_f")).where(F.col("_f") > 1)
    salted = points.join(F.broadcast(full), F.col(key).eqNullSafe(F.col("_t")), "left")  # rows / TILE_FILE_ROWS tiles at most
    salted = salted.repartition(n, F.col(key), F.pmod(F.xxhash64("point_id"), F.coalesce("_f", F.lit(1)))).select(*points.columns)
    salted.sortWithinPartitions(key, "x", "y").write.mode("overwrite").partitionBy(key).parquet(path)


def replace_classes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Original columns with the class replaced by labels(point_id, new_class)."""
    return points.join(labels.select("point_id", "new_class"), "point_id").withColumn("classification", F.col("new_class")).select(*points.columns)


def scatter_classes(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of a part written into the whole cloud; everything else becomes 1."""
    return points.join(labels.select("point_id", "new_class"), "point_id", "left").withColumn(
        "classification", F.coalesce("new_class", F.lit(1)).cast("int")).select(*points.columns)
