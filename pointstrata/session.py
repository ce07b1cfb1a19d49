"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
#: Bytes of a measured table that may be sent to every task (less if the session allows less).
SMALL = 1 << 20


def measured_joins(spark: SparkSession) -> None:
    """Lets joins of this session be broadcast by measured sizes only, never by estimates.

    A file's size says little about its rows: a table of a few megabytes may
    unpack to hundreds, and exploded rows count once.  Chosen by estimate such
    tables go whole through the driver.  With adaptive execution the size of a
    shuffled side is known before the join is planned; hints stay in force.
    """
    static = spark.conf.get(STATIC)
    if static == "-1" or spark.conf.get("spark.sql.adaptive.enabled") != "true":
        return
    if spark.conf.get(MEASURED, None) is None:
        size = re.fullmatch(r"(\d+)([kmgt]?)b?", static.lower())
        spark.conf.set(MEASURED, str(min(SMALL, int(size[1]) << 10 * " kmgt".index(size[2] or " ")) if size else SMALL))
    spark.conf.set(STATIC, "-1")


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("pointstrata")
    for key, value in {
        **DEFAULTS,
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        **conf,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints.

    A cluster names a shared folder in ``spark.checkpoint.dir``.  Only when the
    session has none and runs in one process (tests, notebooks) a temporary one
    is set; executors on other machines could not see that.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not configured and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder, for files of one job."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a table in the checkpoint folder and read it back.

    The table survives the loss of executors, is computed in a single pass, and
    its size is known to the planner, so the next join is chosen by fact.
    """
    spark = df.sparkSession
    path = work_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
