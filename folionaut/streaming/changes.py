"""What changed in a folder, from a stream of listings; and events of an outbox, each applied once.

*Listings.* Each scan of a folder is a set of rows (path, epoch, content_hash); a file that is gone has a row with a null
hash, as a listing is compared with the paths of the scan before (``listing_rows``). State is the last hash and epoch per
path, so a scan that is read again, or one that arrives late, changes nothing.

*Outbox.* Events (event_id, key, sequence, kind, payload) are delivered at least once and in any order. The table of
applied events is keyed by event id; the state of a key is its event of the highest sequence. A delete leaves a
tombstone that carries its sequence, so that an older upsert that is replayed later does not bring the key back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE_DDL = "path string, epoch bigint, change string, content_hash string"


class _LastHash(StatefulProcessor):
    """new, changed or deleted against the last scan seen; unchanged and replayed scans give no row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch bigint, content_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows), ignore_index=True).sort_values("epoch", kind="stable")
        epoch, known = self.last.get() if self.last.exists() else (None, None)
        out = []
        for at, given in zip(seen["epoch"].tolist(), seen["content_hash"].tolist()):
            given = None if pd.isna(given) else given
            if epoch is not None and at <= epoch:
                continue
            if given != known:
                change = "deleted" if given is None else ("new" if known is None else "changed")
                out.append((key[0], at, change, given))
            epoch, known = at, given
        if epoch is not None:
            self.last.update((epoch, known))
        if out:
            yield pd.DataFrame(out, columns=["path", "epoch", "change", "content_hash"])

    def close(self) -> None:
        pass


def changes(scans: DataFrame) -> DataFrame:
    """(path, epoch, change, content_hash) of a stream of (path, epoch, content_hash) rows. Keyed by path: no hot key."""
    keyed = scans.select("path", F.col("epoch").cast("bigint").alias("epoch"), "content_hash")
    return keyed.groupBy("path").transformWithStateInPandas(
        statefulProcessor=_LastHash(), outputStructType=CHANGE_DDL, outputMode="Append", timeMode="None"
    )


def listing_rows(listing: DataFrame, before: DataFrame, epoch: int) -> DataFrame:
    """One scan as rows of the stream: what is listed (path, content_hash), and what was known ``before`` and is not."""
    gone = before.select("path").distinct().join(listing.select("path"), "path", "left_anti").withColumn("content_hash", F.lit(None).cast("string"))
    return listing.select("path", "content_hash").unionByName(gone).withColumn("epoch", F.lit(epoch).cast("bigint"))


def newest_events(events: DataFrame) -> DataFrame:
    """The event of the highest (sequence, event_id) per key, tombstones included; repeated deliveries count once.

    A maximum needs no de-duplication before it, and partial maxima come before the shuffle, so a key with very many
    events costs a row per task.
    """
    columns = [c for c in events.columns if c != "key"]
    return events.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("sequence", "event_id")).alias("e")).select("key", "e.*")


def current_rows(state: DataFrame) -> DataFrame:
    """Keys that are there: their newest event is no tombstone."""
    return state.filter(F.col("kind") != "delete")


def applied_once(batch: DataFrame, applied: DataFrame) -> DataFrame:
    """Events of a micro-batch that were not applied before, each once."""
    return batch.dropDuplicates(["event_id"]).join(applied.select("event_id"), "event_id", "left_anti")


def apply_batch(folder: str, batch: DataFrame, batch_id: int) -> None:
    """For ``foreachBatch``: events of the batch that no other batch applied are written to the batch's own folder.

    A batch that is run again looks at the other batches alone and overwrites its own folder, so it writes the same rows.
    """
    spark = batch.sparkSession
    target = f"{folder}/batch={batch_id}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        others = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields) + ", batch bigint").parquet(folder)
        fresh = applied_once(batch, others.filter(F.col("batch") != batch_id))
    else:
        fresh = batch.dropDuplicates(["event_id"])
    fresh.write.mode("overwrite").parquet(target)
