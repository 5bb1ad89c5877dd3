"""Cut lineage through the shared checkpoint folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from folionaut.settings import FolioError

#: Spark's setting that shuffle files go at the end of a query.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a local session without one gets a fresh folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise FolioError("CONFIG_INVALID", "Set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="folionaut-checkpoint-")
    context.setCheckpointDir(folder)


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own, not yet made, on shared storage."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"


def durable(frame: DataFrame) -> DataFrame:
    """Compute once and keep the rows as a table on shared storage.

    A lost executor then costs no recomputation, and later reads take only the columns and row groups they need. What was
    shuffled to make them goes as soon as they are written, so that a query never needs room for all its shuffles at once.
    """
    spark = frame.sparkSession
    path = fresh_folder(spark)
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        # Ids are random hexadecimal digits, which only a coder of single symbols makes smaller.
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)
    return spark.read.schema(frame.schema).parquet(path)
