"""Arriving chunks: classification per chunk, running class counts, corrections.

Every arriving file holds points of one chunk or of several, and a chunk may come
in several files.  Chunks are classified independently of each other, as the
batch plan does, from all points that have arrived, and a repeated micro-batch
leaves the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.classify import Config, classify_given_ground
from ..sources.points import POINTS


def chunk_stream(spark: SparkSession, folder: str, schema: StructType = POINTS, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


KEY = ("file_id", "chunk_id")


def classify_stream(chunks: DataFrame, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame] | None = None,
                    resume_from: int = 0) -> StreamingQuery:
    """Classifies arriving chunks into ``out``; ``classified`` reads the result.

    A chunk is known by its file and number and may arrive in parts: every
    trigger stores its points, and a chunk that got new ones is classified again
    from all its parts.  Both tables are partitioned by trigger, so a repeated
    trigger replaces its own rows and nothing else.  The checkpoint remembers
    finished files; ``resume_from`` skips lower chunk numbers as well.
    """
    plan = plan or (lambda df: classify_given_ground(df, Config()))

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.where(F.col("chunk_id") >= resume_from).select(*POINTS.names).write.mode("overwrite").parquet(f"{out}/points/trigger={number}")
        seen = spark.read.schema(StructType([*POINTS.fields, StructField("trigger", LongType())])).parquet(f"{out}/points")
        seen = seen.where(F.col("trigger") <= number)
        fresh = spark.read.schema(POINTS).parquet(f"{out}/points/trigger={number}")
        for k, key in enumerate(fresh.select(*KEY).distinct().orderBy(*KEY).collect()):  # the chunks of one trigger
            one = seen.select(*POINTS.names).where(F.col("file_id").eqNullSafe(F.lit(key["file_id"])) & (F.col("chunk_id") == key["chunk_id"]))
            top = one.agg(F.max("intensity")).first()[0] or 0.0
            scaled = one.withColumn("intensity", F.col("intensity") / F.lit(top)) if top > 0 else one
            plan(scaled).select(*POINTS.names, "new_class").write.mode("overwrite").parquet(f"{out}/classes/trigger={number}/part={k}")

    return (chunks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def classified(spark: SparkSession, out: str) -> DataFrame:
    """Rows of ``classify_stream``: of every chunk those of the last trigger that classified it."""
    rows = spark.read.option("basePath", f"{out}/classes").parquet(f"{out}/classes").drop("part")
    last = rows.groupBy(*KEY).agg(F.max("trigger").alias("_last"))
    same = F.lit(True)
    for c in KEY:
        same = same & rows[c].eqNullSafe(last[c])
    return rows.join(last, same & (rows["trigger"] == last["_last"]), "left_semi").drop("trigger")


def running_counts(chunks: DataFrame, label: str = "classification") -> DataFrame:
    """Class counts over everything seen so far; the state is one row per class."""
    return chunks.groupBy(F.col(label).alias("class_id")).agg(F.count(F.lit(1)).alias("count"))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drains what is available into an in-memory table (small results only)."""
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_folder(df: DataFrame, folder: str, checkpoint: str, key: str) -> DataFrame:
    """Drains an updating result into files; of every key the last row is returned."""
    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/trigger={number}")

    q = df.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = df.sparkSession.read.option("basePath", folder).parquet(folder)
    rest = [c for c in rows.columns if c not in (key, "trigger")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "trigger").alias("_r")).select(key, "_r.*")


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """Last label per point over a stream of corrections; state is one row per corrected point."""
    return corrections.groupBy("point_id").agg(F.max_by("new_label", "seq").alias("new_label"), F.count(F.lit(1)).alias("n_corrections"))
