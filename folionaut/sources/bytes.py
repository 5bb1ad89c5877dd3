"""From bytes to text: is it text at all, and in which encoding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of formats that are never text.
BINARY_STARTS = (
    b"\x7fELF", b"MZ", b"PK\x03\x04", b"\x1f\x8b", b"\x89PNG", b"GIF87a", b"GIF89a", b"\xff\xd8\xff", b"%PDF-",
    b"SQLite format 3\x00", b"RIFF", b"\xca\xfe\xba\xbe", b"\xfe\xed\xfa", b"\xcf\xfa\xed\xfe",
)
# Byte order marks and what they announce; the longer mark first.
MARKS = {
    b"\xff\xfe\x00\x00": "utf-32-le", b"\x00\x00\xfe\xff": "utf-32-be", b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be", b"\xef\xbb\xbf": "utf-8",
}

#: Control characters that text does not hold: all but tab, line feed, form feed and carriage return.
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]")


def _readings(data: bytes, longest_mark: int, last_resort: str | None):
    """Each way to read the bytes, the likeliest first: as a mark announces, as UTF-8, then in a one-byte encoding."""
    for mark, encoding in MARKS.items():
        if len(mark) <= longest_mark and data.startswith(mark):
            yield data[len(mark) :], encoding, "strict"
            if last_resort is None:
                return
    yield data, "utf-8", "strict"
    if last_resort is not None:
        yield data, last_resort, "replace"


def _first(readings) -> str | None:
    for data, encoding, errors in readings:
        try:
            return data.decode(encoding, errors)
        except UnicodeError:
            continue
    return None


def certain_text(data: bytes) -> str | None:
    """The text of a file that is surely Unicode text; None otherwise."""
    if any(map(data.startswith, BINARY_STARTS)):
        return None
    text = _first(_readings(data, longest_mark=4, last_resort=None))
    return text if text and not text.isspace() and not _CONTROL.search(text) else None


def any_text(data: bytes) -> str:
    """The text of a file that is known to be text, whatever its encoding."""
    return _first(_readings(data, longest_mark=3, last_resort="cp1252"))


def _column(content: Column, read) -> Column:
    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(lambda data: None if data is None else read(bytes(data)))

    return convert(content)


def sniffed_text(content: Column) -> Column:
    return _column(content, certain_text)


def decoded_text(content: Column) -> Column:
    return _column(content, any_text)
