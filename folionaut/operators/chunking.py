"""Cut structured blocks into overlapping chunks.

Spark prepares, per document, what the packing needs (piece lengths, group starts, skipped
repeats); ``mapInArrow`` walks the pieces of one document after the other and emits its chunks.
A document is one row throughout, so no text is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.text import let, sentences, squeeze
from folionaut.settings import FolioError

BLOCK_TYPE = (
    "struct<text:string,is_heading:boolean,heading:string,section_path:string,page:int,slide:int,sheet:string,"
    "time_start_ms:bigint,time_end_ms:bigint,line_start:int,line_end:int,atomic:boolean>"
)
BLOCKS = f"array<{BLOCK_TYPE}>"

# Chunks handed back to Spark at a time.
CHUNKS_PER_BATCH = 2000

# Columns of a chunk as the packing emits them.
CHUNK_FIELDS = {
    "chunk_index": "int", "text": "string", "char_start": "bigint", "char_end": "bigint", "token_start": "bigint",
    "token_count": "bigint", "page_start": "int", "page_end": "int", "slide_start": "int", "slide_end": "int",
    "time_start_ms": "bigint", "time_end_ms": "bigint", "line_start": "int", "line_end": "int",
    "section_path": "string", "heading": "string", "document_length": "bigint",
}


class ApproximateTokens:
    """Four characters count as one token."""

    def count(self, text: str) -> int:
        return -(-len(text) // 4)

    def starts(self, text: str) -> list[int]:
        return list(range(0, len(text), 4))


class FileTokenizer:
    """Exact counts from a tokenizer.json file that every executor can read."""

    def __init__(self, path: str):
        self.path, self._loaded = path, None

    def __reduce__(self):
        return FileTokenizer, (self.path,)

    @property
    def _tokenizer(self):
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self.path)
        return self._loaded

    def count(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> list[int]:
        return [a for a, b in self._tokenizer.encode(text, add_special_tokens=False).offsets if b > a]


def pack(starts: list[int], ends: list[int], low: int, high: int, fits: Callable, overlaps: Callable | None):
    """Greedy runs of whole pieces between ``low`` and ``high``; yields (first, past the last)."""
    first = low
    while first < high:
        past = fits(first, high)
        yield first, past
        if past == high:
            return
        first = max(first + 1, overlaps(first, past) if overlaps else past)


def _range(values: list) -> tuple:
    known = [value for value in values if value is not None]
    return (min(known), max(known)) if known else (None, None)


def _document_chunks(blocks: list[dict], code: bool, tokenizer, size: int, overlap: int) -> list[dict]:
    text = "\n\n".join(block["text"] for block in blocks)
    exact = not isinstance(tokenizer, ApproximateTokens)
    starts, ends, owner, line, groups = [], [], [], [], [0]
    at = 0
    for number, block in enumerate(blocks):
        length = block["length"]
        if block["fresh"] and groups[-1] != len(starts):
            groups.append(len(starts))
        if not block["repeat"]:
            whole = block["atomic"] or tokenizer.count(text[at : at + length]) <= size
            pieces = block["pieces"] if code or not whole else [length]
            here = at
            for n, piece in enumerate(pieces):
                cuts = [0, piece]
                if not code and not whole and tokenizer.count(text[here : here + piece]) > size:
                    inner = tokenizer.starts(text[here : here + piece])
                    cuts = [0, *inner[size::size], piece]
                for a, b in zip(cuts, cuts[1:]):
                    starts.append(here + a)
                    ends.append(here + b)
                    owner.append(number)
                    line.append((block["line_start"] or 1) + n)
                here += piece + (1 if code else 0)
        at += length + 2
    groups.append(len(starts))

    if exact:

        def fits(first, high):
            past = first + 1
            while past < high and tokenizer.count(text[starts[first] : ends[past]]) <= size:
                past += 1
            return past

        def overlaps(first, past):
            back = past
            while back > first + 1 and tokenizer.count(text[starts[back - 1] : ends[past - 1]]) <= overlap:
                back -= 1
            return back
    else:

        def fits(first, high):
            return max(first + 1, bisect_right(ends, starts[first] + 4 * size, first, high))

        def overlaps(first, past):
            return bisect_left(starts, ends[past - 1] - 4 * overlap, first, past)

    out = []
    for low, high in zip(groups, groups[1:]):
        for first, past in pack(starts, ends, low, high, fits, overlaps if overlap else None):
            a, b = starts[first], ends[past - 1]
            part = text[a:b]
            if part.strip():
                inside = blocks[owner[first] : owner[past - 1] + 1]
                one, two = inside[0], inside[-1]
                pages, slides = _range([b["page"] for b in inside]), _range([b["slide"] for b in inside])
                out.append(
                    {
                        "chunk_index": len(out), "text": part, "char_start": a, "char_end": b,
                        "token_start": tokenizer.count(text[:a]) if exact else -(-a // 4),
                        "token_count": tokenizer.count(part) if exact else -(-len(part) // 4),
                        "page_start": pages[0], "page_end": pages[1], "slide_start": slides[0], "slide_end": slides[1],
                        "time_start_ms": one["time_start_ms"], "time_end_ms": two["time_end_ms"],
                        "line_start": line[first] if code else one["line_start"],
                        "line_end": line[past - 1] if code else two["line_end"],
                        "section_path": one["section_path"], "heading": one["heading"], "document_length": len(text),
                    }
                )
    return out


def full_text(blocks: Column) -> Column:
    """The document as its blocks joined by a blank line; chunk offsets refer to it."""
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def _prepared(blocks: Column, code: Column, short: int) -> Column:
    """What the packing needs to know of each block; blocks up to ``short`` characters are never cut."""
    keys = F.transform(
        blocks, lambda b: F.struct(squeeze(b["text"]).alias("norm"), b["section_path"].alias("section"))
    )
    none = F.struct(F.lit("").alias("norm"), F.lit(None).cast("string").alias("section"))

    def flags(bound: Column) -> Column:
        before = F.slice(F.concat(F.array(none), bound), 1, F.size(bound))
        return F.zip_with(
            bound,
            before,
            lambda now, last: F.struct(
                (~code & (now["norm"] != "") & (now["norm"] == last["norm"])).alias("repeat"),
                (~now["section"].eqNullSafe(last["section"])).alias("moved"),
            ),
        )

    def code_lines(text: Column) -> Column:
        parts = F.split(text, "\n", -1)
        kept = F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
        return F.transform(kept, F.length)

    def describe(block: Column, flag: Column) -> Column:
        text, atomic = block["text"], F.coalesce(block["atomic"], F.lit(False))
        anchors = "page slide time_start_ms time_end_ms line_start line_end section_path heading".split()
        return F.struct(
            text.alias("text"),
            F.length(text).alias("length"),
            atomic.alias("atomic"),
            *[block[name].alias(name) for name in anchors],
            flag["repeat"].alias("repeat"),
            (flag["repeat"] | F.coalesce(block["is_heading"], F.lit(False)) | flag["moved"]).alias("fresh"),
            F.when(code, code_lines(text))
            .when(atomic | (F.length(text) <= short), F.array(F.length(text)))
            .otherwise(F.transform(sentences(text), F.length))
            .alias("pieces"),
        )

    return F.zip_with(blocks, let(keys, flags), describe)


def chunk_documents(
    documents: DataFrame,
    size: int = 256,
    overlap: int = 64,
    tokenizer=None,
    blocks: str = "blocks",
    code: Column | None = None,
    keep: tuple[str, ...] = ("source_id",),
) -> DataFrame:
    """One row per chunk: the kept columns, index, text, spans and the anchors of its blocks."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise FolioError("CONFIG_INVALID", "chunk size must be positive and overlap smaller than the size")
    tokenizer = tokenizer or ApproximateTokens()
    code = F.lit(False) if code is None else code
    short = 4 * size if isinstance(tokenizer, ApproximateTokens) else 0
    prepared = documents.select(*keep, _prepared(F.col(blocks), code, short).alias("_blocks"), code.alias("_code"))
    kept = {name: prepared.schema[name].dataType for name in keep}

    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}

    def emit(batch: pa.RecordBatch, sources: list[int], found: list[dict]) -> pa.RecordBatch:
        same = [batch.column(name).take(pa.array(sources, pa.int64())) for name in keep]
        own = [pa.array([chunk[name] for chunk in found], types[kind]) for name, kind in CHUNK_FIELDS.items()]
        return pa.RecordBatch.from_arrays(same + own, names=[*keep, *CHUNK_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, found = [], []
            for row in range(batch.num_rows):
                parts = batch.column("_blocks")[row].as_py() or []
                chunks = _document_chunks(parts, batch.column("_code")[row].as_py(), tokenizer, size, overlap)
                sources += [row] * len(chunks)
                found += chunks
                if len(found) >= CHUNKS_PER_BATCH:
                    yield emit(batch, sources, found)
                    sources, found = [], []
            if found:
                yield emit(batch, sources, found)

    fields = [f"`{name}` {kind.simpleString()}" for name, kind in kept.items()]
    fields += [f"{name} {kind}" for name, kind in CHUNK_FIELDS.items()]
    chunks = prepared.mapInArrow(run, ", ".join(fields))
    return chunks.select(
        *keep,
        *[name for name in CHUNK_FIELDS if name != "document_length"],
        squeeze(F.col("text")).alias("normalized_text"),
        (F.col("token_start") + F.col("token_count")).alias("token_end"),
        (100.0 * F.col("char_start") / F.col("document_length")).alias("percent_position"),
    )
