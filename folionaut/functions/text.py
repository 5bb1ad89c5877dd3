"""Text column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never enter the keyword vocabulary.
STOP_WORDS = (
    "the and for with that this from have has are was were will would could should into "
    "your you our their its not"
).split()

# Fixed value: the shape of a vocabulary term.
TERM_PATTERN = r"[A-Za-z][A-Za-z0-9_-]{2,}"

# Every character at which a text is cut into lines.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# One sentence: up to a full stop, question or exclamation mark that white space or the end
# follows, or up to a line feed.
SENTENCE = r"(?Us).+?(?:[.!?](?=\s|\z)|\n|\z)"


def _fold_table() -> tuple[str, str]:
    """Single-mark Latin letters to their base letter; combining marks to nothing."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "s" if parts[0] == "\u017f" else parts[0]
        if len(parts) == 2 and unicodedata.combining(parts[1]) and base.isascii() and chr(code).lower() == chr(code):
            accented.append(chr(code))
            plain.append(base)
    accented.append("\u017f")
    plain.append("s")
    marks = "".join(chr(code) for code in range(0x0300, 0x0370))
    return "".join(accented) + marks, "".join(plain)


_FOLD_FROM, _FOLD_TO = _fold_table()
_HOST_FOLD = str.maketrans(
    dict(zip(_FOLD_FROM, _FOLD_TO)) | {mark: None for mark in _FOLD_FROM[len(_FOLD_TO):]}
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Lambda bodies are interpreted and do not share common sub-expressions, so a
    costly value used several times must be bound to a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO)


def tokens(text: Column) -> Column:
    """Index tokens: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def host_tokens(text: str) -> list[str]:
    """The same tokens for a query string on the driver."""
    return re.findall(r"[^\W_]+", text.lower().translate(_HOST_FOLD))


def query_phrases(query: str) -> list[tuple[str, ...]]:
    """A query is a bag of words; a word that the index tokenizer splits is a phrase."""
    phrases = (tuple(host_tokens(word)) for word in re.findall(r"\w+", query))
    return [phrase for phrase in phrases if phrase]


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def approximate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(4)).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def candidate_terms(text: Column) -> Column:
    """Distinct vocabulary terms in order of first appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), F.lower)
    return F.filter(F.array_distinct(found), lambda term: ~term.isin(STOP_WORDS))


def stable_id(*parts: Column) -> Column:
    """Deterministic 32-character id; the same input always gives the same id."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256), 1, 32)


def citation_label(filename: Column, page, page_end, slide, slide_end, line, line_end, ms, percent) -> Column:
    """Human-readable position: the most precise anchor that is known."""

    def span(prefix: str, start: Column, end: Column) -> Column:
        tail = F.when(end.isNotNull() & (end != start), F.concat(F.lit("-"), end.cast("string")))
        return F.when(
            start.isNotNull(),
            F.concat(filename, F.lit(f", {prefix}"), start.cast("string"), F.coalesce(tail, F.lit(""))),
        )

    seconds = F.floor(ms / 1000).cast("bigint")
    minutes = F.floor(seconds / 60).cast("bigint")
    clock = F.concat(
        filename, F.lit(", "), minutes.cast("string"), F.lit(":"),
        F.lpad((seconds - minutes * 60).cast("string"), 2, "0"),
    )
    share = F.concat(filename, F.lit(", ~"), F.bround(percent, 0).cast("int").cast("string"), F.lit("% through"))
    return F.coalesce(
        span("p.", page, page_end),
        span("slide ", slide, slide_end),
        span("lines ", line, line_end),
        F.when(ms.isNotNull(), clock),
        F.when(percent.isNotNull(), share),
        filename,
    )
