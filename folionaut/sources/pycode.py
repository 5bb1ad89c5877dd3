"""What the syntax of a Python file states: declarations, imports, calls, references, bases.

The parser only observes one file; names are resolved over all files later, by joins.
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the source shown with an edge or a name; the lines given with them lead to the rest.
EVIDENCE = 240
SIGNATURE = 512
#: Files whose syntax a worker holds at once, and the characters of their texts beyond which it holds fewer.
FILES_AT_ONCE = 256
TEXT_AT_ONCE = 1 << 20

ENTITY_FIELDS = {
    "number": "int", "kind": "string", "name": "string", "qualified_name": "string", "scope": "string", "ordinal": "int",
    "line_start": "int", "line_end": "int", "signature": "string",
}
EDGE_FIELDS = {
    "kind": "string", "target_name": "string", "target_key": "string", "target_mode": "string", "line_start": "int",
    "line_end": "int", "position": "int", "evidence": "string", "owner_kind": "string", "owner_name": "string",
    "owner_ordinal": "int", "hint_kind": "string", "hint_name": "string", "hint_ordinal": "int",
}
IMPORT_FIELDS = {"alias": "string", "target": "string", "line": "int"}


def _ddl(fields: dict) -> str:
    return "array<struct<" + ",".join(f"{name}:{kind}" for name, kind in fields.items()) + ">>"


SYNTAX = {
    "status": "string", "entities": _ddl(ENTITY_FIELDS), "edges": _ddl(EDGE_FIELDS), "imports": _ddl(IMPORT_FIELDS),
}


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a plain name chain."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Observer(ast.NodeVisitor):
    def __init__(self, text: str, path: str, module_key: str):
        self.lines, self.path, self.module_key = text.splitlines(), path, module_key
        self.entities: list[dict] = []
        self.edges: list[dict] = []
        self.imports: list[dict] = []
        self.bindings: dict[str, str] = {}
        self.ordinals: Counter = Counter()
        self.owner = self._entity("module", "", None, 1, max(len(self.lines), 1), path)
        self.entities[0]["name"] = path

    def _entity(self, kind, name, owner, start, end, signature) -> int:
        scope = "" if owner is None else self.entities[owner]["qualified_name"]
        qualified = f"{scope}.{name}" if scope else name
        number = len(self.entities)
        self.entities.append(
            {
                "number": number, "kind": kind, "name": name, "qualified_name": qualified, "scope": scope,
                "ordinal": self.ordinals[kind, qualified], "line_start": start, "line_end": end,
                "signature": re.sub(r"\s+", " ", signature)[:SIGNATURE],
            }
        )
        self.ordinals[kind, qualified] += 1
        if owner is not None:
            self._edge(owner, "contains", qualified, start, end, hint=number)
        return number

    def _edge(self, owner, kind, key, start, end, mode="lexical", hint=None, position=0, name=None):
        evidence = re.sub(r"\s+", " ", " ".join(self.lines[start - 1 : end])).strip()[:EVIDENCE]
        self.edges.append(
            {
                "owner": owner, "kind": kind, "target_name": name or key, "target_key": key, "target_mode": mode, "hint": hint,
                "line_start": start, "line_end": end, "position": position, "evidence": evidence,
            }
        )

    def _at(self, kind, key, node):
        self._edge(self.owner, kind, key, node.lineno, node.end_lineno, position=node.col_offset)

    def _inside(self, owner: int, nodes) -> None:
        outer, self.owner = self.owner, owner
        for node in nodes:
            self.visit(node)
        self.owner = outer

    def _declare(self, kind, name, node, signature=None) -> int:
        text = signature if signature is not None else " ".join(self.lines[node.lineno - 1 : node.end_lineno])
        return self._entity(kind, name, self.owner, node.lineno, node.end_lineno, text)

    def _header(self, node) -> str:
        return " ".join(self.lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - 1)])

    def visit_ClassDef(self, node):
        number = self._declare("class", node.name, node, self._header(node))
        for base in node.bases:
            key = _dotted(base.value if isinstance(base, ast.Subscript) else base)
            if key:
                self._edge(number, "inherits", key, base.lineno, base.end_lineno, position=base.col_offset)
        self._inside(number, [*node.bases, *node.keywords, *node.body])
        for decorator in node.decorator_list:
            self.visit(decorator)

    def visit_FunctionDef(self, node):
        kind = "method" if self.entities[self.owner]["kind"] == "class" else "function"
        number = self._declare(kind, node.name, node, self._header(node))
        for decorator in node.decorator_list:
            self.visit(decorator)
        every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        every += [one for one in (node.args.vararg, node.args.kwarg) if one]
        outer, self.owner = self.owner, number
        for argument in every:
            self._declare("parameter", argument.arg, argument)
        hints = [a.annotation for a in every if a.annotation] + [d for d in [*node.args.defaults, *node.args.kw_defaults] if d]
        self.owner = outer
        self._inside(number, [*hints, *([node.returns] if node.returns else []), *node.body])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Assign(self, node):
        for target in node.targets:
            if isinstance(target, ast.Name):
                self._declare("variable", target.id, node)
            else:
                self.visit(target)
        self.visit(node.value)

    def visit_AnnAssign(self, node):
        if isinstance(node.target, ast.Name):
            self._declare("variable", node.target.id, node)
        for part in (node.annotation, node.value):
            if part:
                self.visit(part)

    def visit_Call(self, node):
        key = _dotted(node.func)
        if key:
            first, _, rest = key.partition(".")
            if rest and first in ("self", "cls"):
                scope = self.entities[self.owner]["scope"]
                self._edge(
                    self.owner, "calls", f"{scope}.{rest}" if scope else rest, node.lineno, node.end_lineno, position=node.col_offset
                )
            else:
                self._at("calls", key, node)
        self.generic_visit(node)

    def visit_Name(self, node):
        self._at("references", node.id, node)

    def visit_keyword(self, node):
        if node.arg:
            self._at("references", node.arg, node)
        self.visit(node.value)

    def _imported(self, node, alias, target, bound):
        """A module-level import binds its alias; one inside a function only declares a name there."""
        for kind in ("imports", "depends_on"):
            self._edge(self.owner, kind, target, node.lineno, node.end_lineno, mode="qualified", position=node.col_offset)
        if self.owner == 0:
            self.bindings[alias] = bound
            self.imports.append({"alias": alias, "target": target, "line": node.lineno})
        else:
            self._declare("variable", alias, node)

    def visit_Import(self, node):
        for name in node.names:
            first = name.name.split(".")[0]
            self._imported(node, name.asname or first, name.name, name.name if name.asname else first)

    def visit_ImportFrom(self, node):
        base = node.module or ""
        if node.level:
            package = self.module_key.split(".")
            if not self.path.endswith("__init__.py"):
                package = package[:-1]
            kept = package[: max(0, len(package) - node.level + 1)]
            base = ".".join([*kept, *([base] if base else [])])
        for name in node.names:
            target = f"{base}.{name.name}" if base else name.name
            self._imported(node, name.asname or name.name, target, target)


    def finish(self) -> list[dict]:
        """Edges with owner and hint written out; a free name that an import binds becomes the imported key."""
        declared = {entity["qualified_name"] for entity in self.entities}
        for edge in self.edges:
            for role in ("owner", "hint"):
                number = edge.pop(role)
                entity = {} if number is None else self.entities[number]
                edge[f"{role}_kind"], edge[f"{role}_name"] = entity.get("kind"), entity.get("qualified_name")
                edge[f"{role}_ordinal"] = entity.get("ordinal")
            first, dot, rest = edge["target_key"].partition(".")
            if edge["target_mode"] == "lexical" and first in self.bindings:
                around = edge["owner_name"].split(".") if edge["owner_name"] else []
                enclosing = (".".join([*around[:n], first]) for n in range(len(around) + 1))
                if declared.isdisjoint(enclosing):
                    edge["target_mode"], edge["target_key"] = "qualified", self.bindings[first] + dot + rest
        return self.edges


def observe(text: str, path: str, module_key: str) -> dict:
    try:
        tree = ast.parse(text)
        observer = _Observer(text, path, module_key)
        for node in tree.body:
            observer.visit(node)
        edges = observer.finish()
    except (SyntaxError, ValueError, RecursionError):
        return {"status": "parse_error", "entities": [], "edges": [], "imports": []}
    return {"status": "parsed", "entities": observer.entities, "edges": edges, "imports": observer.imports}


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of at most ``FILES_AT_ONCE`` texts, and of ``TEXT_AT_ONCE`` characters unless one text has more."""
    first, held = 0, 0
    for at, length in enumerate(pc.utf8_length(texts).to_pylist()):
        if at > first and (at - first == FILES_AT_ONCE or held + (length or 0) > TEXT_AT_ONCE):
            yield first, at
            first, held = at, 0
        held += length or 0
    if first < len(texts):
        yield first, len(texts)


def parse_python(files: DataFrame) -> DataFrame:
    """Files (source_id, path, module_key, text, ...) with the syntax columns in place of the text."""
    keep = [name for name in files.columns if name != "text"]
    ddl = [f"`{name}` {files.schema[name].dataType.simpleString()}" for name in keep]
    ddl += [f"{name} {kind}" for name, kind in SYNTAX.items()]
    simple = {"int": pa.int32(), "string": pa.string()}

    def struct(fields: dict) -> pa.DataType:
        return pa.list_(pa.struct([(name, simple[kind]) for name, kind in fields.items()]))

    types = {"status": pa.string(), "entities": struct(ENTITY_FIELDS), "edges": struct(EDGE_FIELDS), "imports": struct(IMPORT_FIELDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # What a syntax tree states is many times its text, so a batch is read in short pieces.
            for first, after in _pieces(whole.column("text")):
                batch = whole.slice(first, after - first)
                inputs = zip(*[batch.column(name).to_pylist() for name in ("text", "path", "module_key")])
                found = [observe(*row) for row in inputs]
                own = [pa.array([one[name] for one in found], kind) for name, kind in types.items()]
                yield pa.RecordBatch.from_arrays([batch.column(name) for name in keep] + own, names=[*keep, *types])

    return files.select(*keep, F.col("text")).mapInArrow(run, ", ".join(ddl))
