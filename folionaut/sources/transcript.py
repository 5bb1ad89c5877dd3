"""Transcripts in JSON: timed segments to blocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folionaut.functions.text import let
from folionaut.sources.plaintext import block

OFFSETS = "struct<transcription:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>>"
SECONDS = "struct<segments:array<struct<text:string,start:double,end:double>>>"


def transcript_blocks(json: Column, millisecond_offsets: bool = False) -> Column:
    """Atomic blocks with times in milliseconds; null when the JSON or a time span is not valid."""

    def timed(text: Column, start: Column, end: Column) -> Column:
        return F.struct(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"), start.alias("start"), end.alias("end"))

    if millisecond_offsets:
        records = F.from_json(json, OFFSETS)["transcription"]
        spans = F.transform(
            F.filter(records, lambda s: s["offsets"].isNotNull()),
            lambda s: timed(s["text"], s["offsets"]["from"], s["offsets"]["to"]),
        )
    else:
        records = F.from_json(json, SECONDS)["segments"]
        spans = F.transform(
            records, lambda s: timed(s["text"], F.bround(s["start"] * 1000).cast("bigint"), F.bround(s["end"] * 1000).cast("bigint"))
        )

    def checked(said: Column) -> Column:
        wrong = F.exists(said, lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] < s["start"]))
        return F.when(
            ~wrong,
            F.transform(said, lambda s: block(s["text"], time_start_ms=s["start"], time_end_ms=s["end"], atomic=F.lit(True))),
        )

    return let(F.filter(spans, lambda s: s["text"] != ""), checked)


def duration_seconds(blocks: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(blocks, lambda b: b["time_end_ms"])), F.lit(0)) / 1000.0
