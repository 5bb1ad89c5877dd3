"""Changed and deleted files in a stream, outbox events applied once, tombstones."""

import random

from pyspark.sql import functions as F

from folionaut.streaming import changes

SCANS = [
    [("a", "1"), ("b", "1"), ("c", "1")],
    [("a", "2"), ("b", "1"), ("d", "1")],
    [("a", "2"), ("c", "9"), ("d", "1")],
]


def plain_changes():
    before, out = {}, set()
    for epoch, scan in enumerate(SCANS):
        now = dict(scan)
        for path in before | now:
            if before.get(path) != now.get(path):
                kind = "deleted" if path not in now else ("new" if path not in before else "changed")
                out.add((path, epoch, kind, now.get(path)))
        before = now
    return out


def run_stream(spark, source, out, checkpoint):
    stream = spark.readStream.schema("path string, content_hash string, epoch bigint").option("maxFilesPerTrigger", 1).parquet(source)
    writer = changes.changes(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def test_changes_of_three_scans_and_a_replay(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    known = spark.createDataFrame([], "path string, content_hash string")
    for epoch, scan in enumerate(SCANS):
        listing = spark.createDataFrame(scan, "path string, content_hash string")
        changes.listing_rows(listing, known, epoch).coalesce(1).write.mode("append").parquet(source)
        run_stream(spark, source, out, checkpoint)
        known = listing
    # The second scan is delivered again.
    again = spark.createDataFrame(SCANS[1], "path string, content_hash string").withColumn("epoch", F.lit(1).cast("bigint"))
    again.coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, checkpoint)
    got = [tuple(r) for r in spark.read.parquet(out).select("path", "epoch", "change", "content_hash").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_changes()


def test_events_are_applied_once(spark, tmp_path):
    random_ = random.Random(1)
    events = [(n, random_.randint(0, 9), n, random_.choice(["upsert", "upsert", "delete"]), f"p{n}") for n in range(200)]
    delivered = events + random_.sample(events, 80)
    random_.shuffle(delivered)
    ddl = "event_id long, key long, sequence long, kind string, payload string"
    folder = f"{tmp_path}/applied"
    cuts = [delivered[:100], delivered[100:180], delivered[180:]]
    for number, part in enumerate(cuts):
        changes.apply_batch(folder, spark.createDataFrame(part, ddl), number)
    first = sorted(tuple(r) for r in spark.read.parquet(folder).collect())
    for number in (1, 2):  # batches that run again write what they wrote
        changes.apply_batch(folder, spark.createDataFrame(cuts[number], ddl), number)
    again = spark.read.parquet(folder)
    assert sorted(tuple(r) for r in again.collect()) == first
    assert sorted(r["event_id"] for r in again.collect()) == list(range(200))
    newest = {}
    for e in events:
        newest[e[1]] = e
    got = {r["key"]: (r["sequence"], r["kind"]) for r in changes.newest_events(spark.createDataFrame(delivered, ddl)).collect()}
    assert got == {k: (e[2], e[3]) for k, e in newest.items()}
    assert {r["key"] for r in changes.current_rows(changes.newest_events(again.drop("batch"))).collect()} == {k for k, e in newest.items() if e[3] != "delete"}
