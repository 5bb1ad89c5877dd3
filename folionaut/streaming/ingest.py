"""Watch a folder: each micro-batch of new files is indexed as one batch of the collection."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folionaut.plans.store import STREAM_BATCHES, Collection
from folionaut.sources.listing import describe_files

FILE_DDL = "path string, modificationTime timestamp, length bigint, content binary"


def watch_folder(collection: Collection, folder: str, checkpoint: str, files_per_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Start indexing. A batch that is replayed after a failure overwrites its own output, so nothing doubles."""
    # The same epoch of the same checkpoint always has the same batch id; other streams have others.
    first = STREAM_BATCHES + ((int.from_bytes(hashlib.sha256(checkpoint.encode()).digest()[:5], "big") >> 4) << 26)
    stream = (
        collection.spark.readStream.format("binaryFile").schema(FILE_DDL)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def index_batch(files: DataFrame, epoch: int) -> None:
        # The content is read again when the batch is indexed; nothing is held on the driver.
        collection.index(describe_files(files, folder), batch=first + epoch)

    writer = stream.writeStream.foreachBatch(index_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
