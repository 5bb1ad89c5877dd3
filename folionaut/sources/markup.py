"""Blocks of HTML and Markdown. One small parser run per document inside Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folionaut.operators.chunking import BLOCKS
from folionaut.sources.plaintext import with_sections

# Element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = {"script", "style", "noscript", "head"}
HEADINGS = {f"h{n}" for n in range(1, 7)}
ENCLOSING = {"p", "pre", "li", "tr"}
PAGE_TYPE = f"struct<title:string,blocks:{BLOCKS}>"


class _Capture:
    """The text pieces of one open element."""

    def __init__(self, name: str, depth: int):
        self.name, self.depth, self.pieces = name, depth, []

    def text(self) -> str:
        return ("" if self.name == "pre" else " ").join(self.pieces)


class _PageReader(HTMLParser):
    """Collects the title and the outermost block elements in document order.

    An end tag closes the nearest open element of that name and all inside it; an end
    tag without one is ignored. Links become ``[text](target)``.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.buffer: list[str] = []
        self.captures: list[_Capture] = []
        self.links: list[tuple[int, str, list[str]]] = []
        self.found: list[_Capture] = []
        self.everything: list[str] = []
        self.title: list[str] | None = None

    def _piece(self, text: str) -> None:
        for capture in self.captures:
            capture.pieces.append(text)
        self.everything.append(text)

    def _flush(self) -> None:
        text = "".join(self.buffer).strip()
        self.buffer.clear()
        if not text:
            return
        if "title" in self.open and self.title is not None and not self.title_closed:
            self.title.append(text)
        if DROPPED.intersection(self.open):
            return
        if self.links:
            self.links[-1][2].append(text)
        else:
            self._piece(text)

    title_closed = False

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "title" and self.title is None:
            self.title = []
        if tag not in VOID:
            nested = ENCLOSING.intersection(self.open)
            self.open.append(tag)
            if (tag in HEADINGS or tag in ENCLOSING) and not nested and not DROPPED.intersection(self.open):
                capture = _Capture(tag, len(self.open))
                self.captures.append(capture)
                self.found.append(capture)
            target = dict(attrs).get("href")
            if tag == "a" and target is not None and not DROPPED.intersection(self.open):
                self.links.append((len(self.open), target, []))

    def handle_endtag(self, tag):
        self._flush()
        if tag in self.open:
            while True:
                last = self.open[-1]
                self._close(len(self.open))
                self.open.pop()
                if last == tag:
                    break

    def _close(self, depth: int) -> None:
        if self.open[-1] == "title":
            self.title_closed = True
        if self.links and self.links[-1][0] == depth:
            _, target, pieces = self.links.pop()
            text = f"[{' '.join(pieces)}]({target})"
            if self.links:
                self.links[-1][2].append(text)
            else:
                self._piece(text)
        self.captures = [c for c in self.captures if c.depth != depth]

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def finish(self) -> dict:
        self.close()
        self._flush()
        while self.open:
            self._close(len(self.open))
            self.open.pop()
        items = [
            (int(c.name[1]) if c.name in HEADINGS else 0, c.text(), c.name in ("pre", "tr")) for c in self.found if c.text()
        ]
        if not items and self.everything:
            items = [(0, " ".join(self.everything), False)]
        title = None if self.title is None else " ".join(self.title)
        return {"title": title, "blocks": with_sections(items)}


def read_page(html: str) -> dict:
    reader = _PageReader()
    reader.feed(html)
    return reader.finish()


def html_page(html: Column) -> Column:
    """struct<title, blocks> of a page."""

    @F.pandas_udf(PAGE_TYPE)
    def pages(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(page or "") for page in batch], columns=["title", "blocks"])

    return pages.asNondeterministic()(html)


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARKER = re.compile(r"^ {0,3}(?:>[ ]?|(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$))")
_DELIMITER_ROW = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML_START = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")


class _MarkdownReader:
    """Line states of Markdown: paragraph, fence, indented code, table, raw HTML, list and quote marks."""

    def __init__(self):
        self.items: list[tuple[int, str, bool]] = []
        self.paragraph: list[str] = []

    def end_paragraph(self, level: int = 0) -> None:
        text = "\n".join(line.strip() for line in self.paragraph).strip()
        self.paragraph = []
        if text:
            self.items.append((level, text, False))

    def atomic(self, lines: list[str]) -> None:
        text = "\n".join(lines).rstrip()
        if text.strip():
            self.items.append((0, text, True))

    def cells(self, row: str) -> None:
        for cell in re.split(r"(?<!\\)\|", row.strip().strip("|")):
            if cell.strip():
                self.items.append((0, cell.strip().replace("\\|", "|"), False))

    def read(self, lines: list[str]) -> list[tuple[int, str, bool]]:
        at = 0
        while at < len(lines):
            at = self.step(lines, at)
        self.end_paragraph()
        return self.items

    def step(self, lines: list[str], at: int) -> int:
        line = lines[at]
        fence = _FENCE.match(line)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            self.end_paragraph()
            indent = len(line) - len(line.lstrip(" "))
            closing = re.compile(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
            end = at + 1
            while end < len(lines) and not closing.match(lines[end]):
                end += 1
            self.atomic([re.sub(rf"^ {{0,{indent}}}", "", body) for body in lines[at + 1 : end]])
            return end + 1
        if not line.strip():
            self.end_paragraph()
            return at + 1
        if not self.paragraph and (line.startswith("    ") or line.startswith("\t")):
            end = at
            while end < len(lines) and (not lines[end].strip() or lines[end].startswith(("    ", "\t"))):
                end += 1
            self.atomic([re.sub(r"^(?: {4}|\t)", "", body) for body in lines[at:end]])
            return end
        heading = _ATX.match(line)
        if heading:
            self.end_paragraph()
            text = (heading[2] or "").strip().strip("#").strip() if (heading[2] or "").strip("# ") == "" else heading[2].strip()
            if text:
                self.items.append((len(heading[1]), text, False))
            return at + 1
        underline = _SETEXT.match(line)
        if underline and self.paragraph:
            self.end_paragraph(1 if underline[1][0] == "=" else 2)
            return at + 1
        if _RULE.match(line):
            self.end_paragraph()
            return at + 1
        if not self.paragraph and _HTML_START.match(line):
            end = at
            while end < len(lines) and lines[end].strip():
                end += 1
            self.atomic(lines[at:end])
            return end
        follows = lines[at + 1] if at + 1 < len(lines) else ""
        if not self.paragraph and "|" in line and "-" in follows and "|" in follows and _DELIMITER_ROW.match(follows):
            self.cells(line)
            end = at + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                self.cells(lines[end])
                end += 1
            return end
        marker = _MARKER.match(line)
        if marker:
            quote = marker[0].lstrip().startswith(">")
            if not quote or not self.paragraph:
                self.end_paragraph()
            inner = line[marker.end() :]
            end = at + 1
            body = [inner]
            width = marker.end()
            while end < len(lines):
                if quote and lines[end].lstrip().startswith(">"):
                    body.append(re.sub(r"^ {0,3}>[ ]?", "", lines[end]))
                elif not quote and (lines[end].startswith(" " * width) or (not lines[end].strip() and end + 1 < len(lines) and lines[end + 1].startswith(" " * width))):
                    body.append(lines[end][width:])
                elif lines[end].strip() and body[-1].strip() and not _MARKER.match(lines[end]) and not _ATX.match(lines[end]) and not _FENCE.match(lines[end]) and not _RULE.match(lines[end]):
                    body.append(lines[end])
                else:
                    break
                end += 1
            self.items.extend(_MarkdownReader().read(body))
            return end
        self.paragraph.append(line)
        return at + 1


def read_markdown(text: str) -> list[dict]:
    return with_sections(_MarkdownReader().read(re.split(r"\r\n|\n|\r", text)))


def markdown_blocks(text: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def blocks(batch: pd.Series) -> pd.Series:
        return batch.map(lambda value: None if value is None else read_markdown(value))

    return blocks.asNondeterministic()(text)
