"""What every query of this subpackage needs from a session: shipped code, modest Arrow batches, a shared folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; long documents make larger rows, so batches are kept short.
BATCH_ROWS = 1000

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Give Python workers this package and keep Arrow batches small."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent.parent.parent
        folder = tempfile.mkdtemp(prefix="folionaut-llm-")
        context.addPyFile(shutil.make_archive(f"{folder}/folionaut_llm", "zip", home, "folionaut"))
        _SHIPPED.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only where the cluster names none (tests) is one made."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and context.getCheckpointDir():
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="folionaut-shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """Write rows once to the shared folder and read them from there: a cut of lineage that outlives executors."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
