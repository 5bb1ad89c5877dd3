"""EPUB: pages of a book in the order of its spine."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from folionaut.sources.markup import read_page
from folionaut.sources.office import Layout, member_units, open_archive

CONTAINER = "META-INF/container.xml"
_NAMED = Layout(r".*", frozenset({"rootfile", "item", "itemref"}), frozenset())


def book_blocks(data: bytes) -> list[dict]:
    """Blocks of all pages. A page without headings is named by its title, or by its place in the archive."""
    archive = open_archive(data)
    named = lambda member, kind: [u["attributes"] for u in member_units(archive, _NAMED, member) if u["kind"] == kind]
    package = named(CONTAINER, "rootfile")[0]["full-path"]
    places = {item["id"]: item["href"] for item in named(package, "item")}
    present, blocks = set(archive.namelist()), []
    for place in (places[step["idref"]] for step in named(package, "itemref")):
        member = posixpath.normpath(posixpath.join(posixpath.dirname(package), place.split("#")[0]))
        # A reference may be written with escapes where the member's name has none.
        page = read_page(archive.read(member if member in present else unquote(member)).decode("utf-8", errors="replace"))
        named_page = page["title"] or place
        blocks += [block | {"section_path": block["section_path"] or named_page} for block in page["blocks"]]
    return blocks
