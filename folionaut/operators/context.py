"""What the syntax graph knows about search hits: names on their lines, edges of these names, imports of the file.

All hits are answered in one plan, whatever their number. Each list holds at most ``limit`` elements and says whether
there are more; ranks are bounded before anything is collected, so a name that very many others call costs a hit at most
``limit + 1`` rows in each direction. Hits may be as many as a table's rows, and look few to the planner, so no join is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folionaut.operators.durable import durable
from folionaut.operators.graph import BINDINGS
from folionaut.operators.spans import overlapping

# Edge kinds of a hit's context, states of a file whose graph can be shown.
KINDS = ("calls", "inherits", "implements", "references")
SHOWN = ("parsed", "truncated")

ENTITY = ("entity_id", "kind", "name", "qualified_name", "line_start", "line_end")
EDGE = ("relationship_id", "orientation", "kind", "from_id", "owner_name", "target_id", "target_name", "resolution", "source_id", "line_start")


def _first(rows: DataFrame, key: list[str], order: list, count: int, name: str = "place") -> DataFrame:
    """The first ``count`` rows per key, numbered from 1. Spark keeps that many per key and task before it shuffles."""
    numbered = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.filter(F.col(name) <= count)


def _listed(rows: DataFrame, place: str, fields: tuple[str, ...], limit: int, name: str) -> DataFrame:
    """Per hit the first ``limit`` rows as an array in order, and whether there are more."""
    inside = F.when(F.col(place) <= limit, F.struct(F.col(place).alias("_n"), *fields))
    array = F.transform(F.array_sort(F.collect_list(inside)), lambda x: x.dropFields("_n"))
    return rows.groupBy("hit").agg(array.alias(name), (F.max(place) > limit).alias(f"{name}_more"))


def entities_of_hits(hits: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(hit, place, entity columns): names whose lines overlap the hit, the shortest first, ``limit + 1`` at most."""
    named = known.filter(~F.col("kind").isin(*BINDINGS)).select("source_id", *ENTITY)
    spans = hits.select("hit", "source_id", F.col("line_start").alias("h_start"), F.col("line_end").alias("h_end"))
    pairs = overlapping(spans, named, "source_id", ("h_start", "h_end"), ("line_start", "line_end"))
    return _first(pairs, ["hit"], [F.col("line_end") - F.col("line_start"), "line_start", "entity_id"], limit + 1)


def edges_of_entities(wanted: DataFrame, resolved: DataFrame, limit: int) -> DataFrame:
    """(entity_id, turn, order columns, edge columns): the first ``limit + 1`` edges out of each wanted entity, and into it."""
    edges = resolved.filter(F.col("kind").isin(*KINDS)).select(*[c for c in EDGE if c != "orientation"])
    order = ["source_id", "line_start", "kind", "target_name", "relationship_id"]
    parts = []
    for turn, (orientation, end) in enumerate((("outgoing", "from_id"), ("incoming", "target_id"))):
        near = edges.withColumn("entity_id", F.col(end)).join(wanted.hint("merge"), "entity_id", "left_semi")
        # Each direction is kept by itself, so that what it shuffles has gone before the next one begins.
        parts.append(durable(_first(near, ["entity_id"], order, limit + 1, "nth").withColumns({"turn": F.lit(turn), "orientation": F.lit(orientation)})))
    return parts[0].unionByName(parts[1])


def graph_context(hits: DataFrame, files: DataFrame, known: DataFrame, resolved: DataFrame, limit: int) -> DataFrame:
    """One row per hit (hit, source_id, line_start, line_end) with what the graph says.

    ``files`` (source_id, status, language, parser_version) are those whose graph is valid for the indexed content. A hit
    of another file is ``pending_or_stale`` with empty lists. A hit without lines has the file's imports only.
    """
    # Bounded by the hits; three lists derive from it.
    entities = durable(entities_of_hits(hits, known, limit))
    shown = entities.filter(F.col("place") <= limit).select("hit", "place", "entity_id")
    edges = edges_of_entities(shown.select("entity_id").distinct(), resolved, limit)
    # Edges are ranked by their places alone; only those shown get their columns.
    met = shown.join(edges.select("entity_id", "turn", "nth", "relationship_id").hint("merge"), "entity_id")
    # An edge between two names of one hit is shown once, at the first of them.
    position = F.struct("place", "turn", "nth")
    once = met.groupBy("hit", "relationship_id").agg(F.min_by("entity_id", position).alias("entity_id"), F.min(position).alias("p"))
    ranked = durable(_first(once, ["hit"], ["p"], limit + 1).select("hit", "place", "entity_id", "p.turn", "p.nth"))
    ranked = durable(ranked.join(edges.hint("merge"), ["entity_id", "turn", "nth"]).select("hit", "place", *EDGE))
    imports = resolved.filter(F.col("kind") == "imports").join(hits.select("source_id").distinct().hint("merge"), "source_id", "left_semi")
    imports = _first(
        imports.select("source_id", "target_name", "target_id", "line_start", "relationship_id"), ["source_id"], ["line_start", "target_name", "relationship_id"], limit + 1
    )
    of_hits = hits.select("hit", "source_id").join(imports.hint("merge"), "source_id")
    lists = {
        "entities": _listed(entities, "place", ENTITY, limit, "entities"),
        "relationships": _listed(ranked, "place", EDGE, limit, "relationships"),
        "imports": _listed(of_hits, "place", ("target_name", "target_id", "line_start"), limit, "imports"),
    }
    about = files.select("source_id", "status", "language", "parser_version").withColumn("_valid", F.lit(True))
    found = hits.select("hit", "source_id").join(about.hint("merge"), "source_id", "left")
    for part in lists.values():
        found = found.join(part.hint("merge"), "hit", "left")
    valid = F.coalesce("_valid", F.lit(False))

    def array(name: str) -> Column:
        empty = F.array().cast(lists[name].schema[name].dataType)
        return F.when(valid, F.coalesce(name, empty)).otherwise(empty).alias(name)

    more = [(valid & F.coalesce(f"{name}_more", F.lit(False))).alias(f"{name}_more") for name in lists]
    truncated = valid & (F.col("status") == "truncated")
    for name in lists:
        truncated = truncated | (valid & F.coalesce(f"{name}_more", F.lit(False)))
    return found.select(
        "hit", (valid & F.col("status").isin(*SHOWN)).alias("available"),
        F.when(valid, F.col("status")).otherwise("pending_or_stale").alias("status"), "language", "parser_version",
        *[array(name) for name in lists], *more, F.coalesce(truncated, F.lit(False)).alias("truncated"),
    )
