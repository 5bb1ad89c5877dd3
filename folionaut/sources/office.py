"""Office archives as columns: a small helper lists the units of a file, and column expressions make blocks of them.

A unit is a paragraph, a row of a sheet, or a record that other units refer to. ``UNITS`` is the same for all formats, so
the helper knows nothing of headings, sheets, slides or shared strings; these are array expressions, each linear in the file.
A file is one row. Null or broken content, a document type declaration, and contents beyond the limits give an error in
place of units; an archive without the expected members gives none.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass
from xml.parsers import expat

from pyspark.sql import Column
from pyspark.sql import functions as F

from folionaut.operators.chunking import BLOCK_TYPE, BLOCKS
from folionaut.settings import FolioError

# Limits against archives and tables that unpack without end.
MAX_UNPACKED = 512 * 1024 * 1024
MAX_REPEAT = 10_000
MAX_COLUMNS = 16_384

CELL = "struct<times:bigint,attributes:map<string,string>,text:string>"
UNITS = (
    "array<struct<member:string,part:int,part_name:string,kind:string,number:bigint,times:bigint,"
    f"attributes:map<string,string>,text:string,cells:array<{CELL}>>>"
)


@dataclass(frozen=True)
class Layout:
    """Which members of an archive are read, and which of their elements count. Names are without namespace."""

    members: str
    units: frozenset[str]
    texts: frozenset[str]  # elements whose characters are text
    cells: frozenset[str] = frozenset()
    marks: frozenset[str] = frozenset()  # elements inside a unit whose ``val`` becomes one of its attributes
    part: str = ""  # units count only inside this element, where one is named
    direct: bool = False  # units are children of a part, texts children of a cell
    between: str = ""  # between two texts of one unit


def _set(*names: str) -> frozenset[str]:
    return frozenset(names)


LAYOUTS = {
    "docx": Layout(r"word/document\.xml", _set("p"), _set("t"), marks=_set("pStyle")),
    "pptx": Layout(r"ppt/slides/slide(\d+)\.xml", _set("p"), _set("t")),
    "xlsx": Layout(r"xl/.*\.xml|xl/_rels/workbook\.xml\.rels", _set("row", "si", "sheet", "Relationship"), _set("t", "v"), cells=_set("c")),
    "odt": Layout(r"content\.xml", _set("p", "h"), _set("p", "h")),
    "odp": Layout(r"content\.xml", _set("p", "h"), _set("p", "h"), part="page"),
    "ods": Layout(
        r"content\.xml", _set("table-row"), _set("p"), cells=_set("table-cell", "covered-table-cell"), part="table", direct=True, between=" "
    ),
}


class _Walk:
    """One pass over one member. Open units and cells gather the characters of text elements below them."""

    def __init__(self, layout: Layout, member: str, place: int):
        self.layout, self.member, self.place = layout, member, place
        self.path: list[tuple[str, dict | None]] = []
        self.open: list[dict] = []
        self.parts: list[str | None] = []
        self.part, self.texts, self.counts, self.found = 0, 0, {}, []

    def start(self, name: str, attributes: dict) -> None:
        layout, name = self.layout, name.rpartition(":")[2]
        plain = {key.rpartition(":")[2]: value for key, value in attributes.items() if not key.startswith("xmlns")}
        above = self.path[-1][0] if self.path else ""
        if name == layout.part:
            self.part += 1
            self.parts.append(plain.get("name"))
            self.counts = {}
        row = None
        if name in layout.units and (self.parts or not layout.part) and (not layout.direct or above == layout.part):
            row = self._unit(name, plain)
        elif name in layout.cells and self.open:
            row = {"times": int(plain.get("number-columns-repeated", 1)), "attributes": plain, "text": []}
            self.open[-1].setdefault("cells", []).append(row)
        if row is not None:
            self.open.append(row)
        if name in layout.marks and self.open:
            self.open[-1]["attributes"].setdefault(name, next(iter(plain.values()), ""))
        if self._is_text(name, above):
            self.texts += 1
            if layout.between and self.open and self.open[-1]["text"]:
                self.open[-1]["text"].append(layout.between)
        self.path.append((name, row))

    def _unit(self, name: str, plain: dict) -> dict:
        times = int(plain.get("number-rows-repeated", 1))
        number = self.counts.get(name, 0) + 1
        self.counts[name] = number + times - 1
        row = {
            "member": self.member, "part": self.part if self.layout.part else self.place, "part_name": self.parts[-1] if self.parts else None,
            "kind": name, "number": number, "times": times, "attributes": plain, "text": [], "cells": [],
        }
        self.found.append(row)
        return row

    def _is_text(self, name: str, above: str) -> bool:
        return name in self.layout.texts and (not self.layout.direct or above in self.layout.cells)

    def end(self, name: str) -> None:
        name, row = self.path.pop()
        if self._is_text(name, self.path[-1][0] if self.path else ""):
            self.texts -= 1
        if row is not None:
            self.open.pop()
            row["text"] = "".join(row["text"])
        if name == self.layout.part:
            self.parts.pop()

    def characters(self, data: str) -> None:
        if self.texts:
            for row in self.open:
                row["text"].append(data)


def _refuse(*_) -> None:
    raise FolioError("EXTRACTION_FAILED", "document type declarations are not accepted")


def open_archive(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    if sum(info.file_size for info in archive.infolist()) > MAX_UNPACKED:
        raise FolioError("FILE_TOO_LARGE", "uncompressed contents exceed the limit")
    return archive


def member_units(archive: zipfile.ZipFile, layout: Layout, member: str, place: int = 1) -> list[dict]:
    walk, parser = _Walk(layout, member, place), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = walk.start, walk.end, walk.characters
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = _refuse
    with archive.open(member) as stream:
        parser.ParseFile(stream)
    return walk.found


def units(data: bytes, kind: str) -> list[dict]:
    """Units of all members that the format names: numbered members by their number, others by name."""
    layout, archive = LAYOUTS[kind], open_archive(data)
    matches = [m for m in (re.fullmatch(layout.members, name) for name in archive.namelist()) if m]
    matches.sort(key=lambda m: (int(m[1]) if m.re.groups else 0, m[0]))
    return [unit for place, match in enumerate(matches, 1) for unit in member_units(archive, layout, match[0], place)]


def _block(text: Column, **given: Column) -> Column:
    """A whole block; what isn't given is null or false."""
    values = {"text": text, "is_heading": F.lit(False), "atomic": F.lit(False), **given}
    fields = [field.split(":") for field in BLOCK_TYPE[len("struct<") : -1].split(",")]
    return F.struct(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def _filled(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the lambdas inside look at it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sectioned(paragraphs: Column, is_heading) -> Column:
    """Blocks of paragraphs; each stands under the last heading at or before it. Parts between headings are cut as slices."""
    places = F.sequence(F.lit(1), F.size(paragraphs) + 1)
    starts = F.filter(places, lambda i: (i == 1) | (i > F.size(paragraphs)) | F.coalesce(is_heading(F.try_element_at(paragraphs, i)), F.lit(False)))

    def section(start: Column, end: Column) -> Column:
        first = F.element_at(paragraphs, start)
        title = F.when(is_heading(first), first["text"])
        inside = F.slice(paragraphs, start, end - start)
        return F.transform(inside, lambda p: _block(p["text"], is_heading=is_heading(p), heading=title, section_path=title))

    sections = _once(starts, lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda start, at: section(start, F.element_at(s, at + 2))))
    blocks = F.when(F.size(paragraphs) > 0, F.flatten(sections)).otherwise(F.array().cast(BLOCKS))
    return F.filter(blocks, lambda b: _filled(b["text"]))


def word_blocks(found: Column) -> Column:
    return sectioned(found, lambda p: F.startswith(F.lower(F.coalesce(p["attributes"]["pStyle"], F.lit(""))), F.lit("heading")))


def text_blocks(found: Column) -> Column:
    return sectioned(found, lambda p: p["kind"] == "h")


def slide_blocks(found: Column) -> Column:
    """One block of each paragraph, under the number of its slide."""
    made = F.transform(
        found, lambda p: _block(p["text"], slide=p["part"], section_path=F.concat(F.lit("Slide "), p["part"].cast("string")), atomic=F.lit(True))
    )
    return F.filter(made, lambda b: _filled(b["text"]))


def _row(values: Column, sheet: Column, line: Column) -> Column:
    return _block(F.array_join(values, "\t"), sheet=sheet, section_path=sheet, line_start=line, line_end=line, atomic=F.lit(True))


def column_number(reference: Column) -> Column:
    """The column of a cell reference: A is 1, AA is 27; null without letters."""
    letters = F.split(F.regexp_extract(reference, "^[A-Z]+", 0), "")
    number = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0).cast("bigint"), lambda n, c: n * 26 + F.ascii(c) - 64)
    return F.when(number > 0, number)


def _placed(cells: Column, value) -> Column:
    """Values of a row with blanks for the columns that its references leave out."""

    def put(row: Column, cell: Column) -> Column:
        gap = F.greatest(F.lit(0), F.coalesce(column_number(cell["attributes"]["r"]) - 1 - F.size(row), F.lit(0))).cast("int")
        return F.concat(row, F.array_repeat(F.lit(""), gap), F.array(F.coalesce(value(cell), F.lit(""))))

    return F.aggregate(cells, F.array().cast("array<string>"), put)


def workbook_blocks(found: Column) -> Column:
    """Rows of sheets in the order of the workbook; shared strings by their place, truth values as True and False."""
    of = lambda kind, member: F.filter(found, lambda u: (u["kind"] == kind) & u["member"].rlike(member))
    shared = F.transform(of("si", r"^xl/sharedStrings\.xml$"), lambda u: u["text"])
    targets = F.map_from_entries(
        F.transform(of("Relationship", r"rels$"), lambda u: F.struct(u["attributes"]["Id"], u["attributes"]["Target"]))
    )
    sheets = F.transform(
        of("sheet", r"^xl/workbook\.xml$"), lambda u: F.struct(u["attributes"]["name"].alias("name"), targets[u["attributes"]["id"]].alias("target"))
    )

    def value(cell: Column, strings: Column) -> Column:
        kind, raw = cell["attributes"]["t"], cell["text"]
        string = F.try_element_at(strings, raw.try_cast("int") + 1)
        return F.when(kind == "s", string).when(kind == "b", F.when(raw == "1", "True").otherwise("False")).otherwise(raw)

    def rows(sheet: Column, strings: Column) -> Column:
        absolute = F.startswith(sheet["target"], F.lit("/"))
        member = F.when(absolute, F.ltrim(sheet["target"], F.lit("/"))).otherwise(F.concat(F.lit("xl/"), sheet["target"]))
        own = _once(member, lambda name: F.filter(found, lambda u: (u["kind"] == "row") & (u["member"] == name)))
        line = lambda u: F.coalesce(u["attributes"]["r"].try_cast("int"), u["number"].cast("int"))
        return F.transform(own, lambda u: _row(_placed(u["cells"], lambda c: value(c, strings)), sheet["name"], line(u)))

    made = _once(shared, lambda strings: F.flatten(F.transform(sheets, lambda sheet: rows(sheet, strings))))
    return F.filter(made, lambda b: _filled(b["text"]))


def _shown(cell: Column) -> Column:
    return F.when(cell["text"] != "", cell["text"]).otherwise(F.coalesce(cell["attributes"]["value"], F.lit("")))


def _shown_cells(unit: Column) -> Column:
    """Cells of a row up to the last that is not blank."""
    last = F.array_max(F.transform(unit["cells"], lambda c, i: F.when(_filled(_shown(c)), i + 1)))
    return F.slice(unit["cells"], F.lit(1), F.coalesce(last, F.lit(0)))


def spread_blocks(found: Column) -> Column:
    """Rows of OpenDocument tables. Blank cells at the end of a row say nothing; repeated rows and cells stand as often as told."""

    def rows(unit: Column) -> Column:
        values = F.flatten(F.transform(_shown_cells(unit), lambda c: F.array_repeat(_shown(c), c["times"].cast("int"))))
        lines = F.sequence(unit["number"], unit["number"] + unit["times"] - 1)
        return F.transform(lines, lambda n: _row(values, F.coalesce(unit["part_name"], F.lit("Sheet")), n))

    return F.flatten(F.transform(F.filter(found, lambda u: F.size(_shown_cells(u)) > 0), rows))


def too_large(found: Column, kind: Column) -> Column:
    """Whether a sheet repeats too much, or names columns that no sheet has, before anything is spread out."""

    def repeated(unit: Column) -> Column:
        cells = _shown_cells(unit)
        width = F.aggregate(cells, F.lit(0).cast("bigint"), lambda n, c: n + c["times"])
        return (width > MAX_COLUMNS) | ((F.size(cells) > 0) & (unit["times"] > MAX_REPEAT))

    far = lambda u: F.exists(u["cells"], lambda c: F.coalesce(column_number(c["attributes"]["r"]), F.lit(0)) > MAX_COLUMNS)
    return F.when(kind == "ods", F.exists(found, repeated)).when(kind == "xlsx", F.exists(found, far)).otherwise(F.lit(False))


BLOCKS_OF = {
    "docx": word_blocks, "pptx": slide_blocks, "xlsx": workbook_blocks, "odt": text_blocks, "odp": slide_blocks, "ods": spread_blocks,
}


def office_blocks(found: Column, kind: Column) -> Column:
    """Blocks of the units of a file, by its format; null for other kinds."""
    made = F.lit(None).cast(BLOCKS)
    for name, blocks in BLOCKS_OF.items():
        made = F.when(kind == name, blocks(found)).otherwise(made)
    return made
