"""Walks over resolved edges: neighbours, bounded traversal, whole reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folionaut.functions.names import normalize_name
from folionaut.operators.durable import durable
from folionaut.plans.requests import GraphRequest
from folionaut.settings import FolioError

# Direction and edge kinds of each named walk.
PRESETS = {
    "callers": ("incoming", ("calls",)),
    "callees": ("outgoing", ("calls",)),
    "dependencies": ("outgoing", ("depends_on",)),
    "inheritance": ("outgoing", ("inherits", "implements", "type_base")),
    "impact": ("incoming", ("calls", "references", "inherits", "implements", "type_base", "depends_on")),
}


def find_entities(known: DataFrame, request: GraphRequest) -> DataFrame:
    """Entities that the request names, in path and line order."""
    found = known
    if request.entity_id:
        found = found.filter(F.col("entity_id") == request.entity_id)
    if request.source_id:
        found = found.filter(F.col("source_id") == request.source_id)
    if request.symbol:
        symbol = normalize_name(F.lit(request.symbol))
        if request.action == "find":
            wanted = F.lower(symbol)
            found = found.filter(F.contains(F.lower("name"), wanted) | F.contains(F.lower("qualified_name"), wanted))
        else:
            module_name = F.concat_ws(".", "module_key", "qualified_name")
            found = found.filter((F.col("name") == symbol) | (F.col("qualified_name") == symbol) | (module_name == symbol))
    elif request.source_id and request.action != "find" and not request.entity_id:
        found = found.filter((F.col("kind") == "module") & (F.col("qualified_name") == ""))
    return found.orderBy("path", "line_start", "entity_id").limit(request.limit + 1)


def neighbours(resolved: DataFrame, frontier: DataFrame, direction: str, kinds: tuple[str, ...] | None) -> DataFrame:
    """Edges at the frontier (entity_id): outgoing whatever their target, incoming only when resolved to it."""
    edges = resolved.filter(F.col("observed_kind").isin(*kinds)) if kinds else resolved
    parts = []
    if direction in ("outgoing", "both"):
        out = edges.join(frontier.withColumnRenamed("entity_id", "from_id"), "from_id")
        parts.append(out.withColumn("at", F.col("from_id")).withColumn("orientation", F.lit("outgoing")).withColumn("next_id", F.col("target_id")))
    if direction in ("incoming", "both"):
        into = edges.join(frontier.withColumnRenamed("entity_id", "target_id"), "target_id")
        parts.append(into.withColumn("at", F.col("target_id")).withColumn("orientation", F.lit("incoming")).withColumn("next_id", F.col("from_id")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def traverse(known: DataFrame, resolved: DataFrame, request: GraphRequest) -> dict:
    """The answer to a graph request. All that reaches the driver is bounded by the request's limit."""
    matches = [row.asDict() for row in find_entities(known, request).collect()]
    shown = matches[: request.limit]
    answer = {"action": request.action, "candidates": shown, "entities": [], "relationships": [], "chains": [], "truncated": len(matches) > request.limit}
    if request.action == "find":
        return {**answer, "status": "ok"}
    if len(matches) != 1:
        return {**answer, "status": "ambiguous" if matches else "not_found"}
    direction, kinds = PRESETS.get(request.action, (request.direction, request.relationships))
    kinds = request.relationships if request.relationships is not None else kinds
    spark = known.sparkSession
    seed = matches[0]["entity_id"]
    visited, chains, edges = {seed: 0}, {seed: []}, {}
    level, truncated = [seed], False
    for _ in range(request.depth):
        frontier = spark.createDataFrame([(one, n) for n, one in enumerate(level)], "entity_id string, place int")
        step = neighbours(resolved, F.broadcast(frontier), direction, kinds)
        # Outgoing edges come first, each part in line order, entity after entity.
        ordered = step.orderBy(
            "place", F.desc("orientation"), F.when(F.col("orientation") == "incoming", F.col("source_id")), "line_start", "relationship_id"
        )
        rows = ordered.limit(request.limit + len(edges) + 1).collect()
        level = []
        for row in rows:
            if row["relationship_id"] in edges:
                continue
            if len(edges) >= request.limit:
                truncated = True
                break
            edges[row["relationship_id"]] = row.asDict()
            chain = chains[row["at"]] + [{"relationship_id": row["relationship_id"], "direction": row["orientation"]}]
            answer["chains"].append(chain)
            if row["next_id"] and row["next_id"] not in visited:
                visited[row["next_id"]] = len(visited)
                chains[row["next_id"]] = chain
                level.append(row["next_id"])
        if not level or truncated:
            break
    reached = known.filter(F.col("entity_id").isin(list(visited))).collect()
    answer["entities"] = sorted((row.asDict() for row in reached), key=lambda e: visited[e["entity_id"]])
    answer["relationships"] = list(edges.values())
    return {**answer, "status": "ok", "truncated": answer["truncated"] or truncated, "direction": direction, "kinds": kinds}


def reachable(resolved: DataFrame, seeds: DataFrame, direction: str, kinds: tuple[str, ...], depth: int) -> DataFrame:
    """(entity_id, depth) of everything within ``depth`` steps of the seeds; nothing is cut off.

    Each step joins the newest entities with the edges and leaves out those seen before. Steps are
    kept on shared storage, so the plan does not grow with the depth.
    """
    if depth < 1:
        raise FolioError("CONFIG_INVALID", "depth must be positive")
    near, far = ("from_id", "target_id") if direction == "outgoing" else ("target_id", "from_id")
    wanted = resolved.filter(F.col("kind").isin(*kinds) & F.col("target_id").isNotNull())
    links = durable(wanted.select(F.col(near).alias("entity_id"), F.col(far).alias("next_id")).distinct())
    newest = durable(seeds.select("entity_id").distinct().withColumn("depth", F.lit(0)))
    levels = [newest]
    for step in range(1, depth + 1):
        found = newest.join(links, "entity_id").select(F.col("next_id").alias("entity_id")).distinct()
        for level in levels:
            found = found.join(level.select("entity_id"), "entity_id", "left_anti")
        newest = durable(found.withColumn("depth", F.lit(step)))
        if newest.isEmpty():
            break
        levels.append(newest)
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    return seen


def context_of_chunks(chunks: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, entity_id, ...) innermost first: declared names whose lines overlap a chunk, at most ``limit + 1``."""
    from pyspark.sql import Window

    from folionaut.operators.graph import overlapping

    named = known.filter(~F.col("kind").isin("variable", "parameter")).select(
        "source_id", "entity_id", "kind", "qualified_name", F.col("line_start").alias("e_start"), F.col("line_end").alias("e_end")
    )
    spans = chunks.select("source_id", "chunk_id", "line_start", "line_end")
    pairs = overlapping(spans, named, "source_id", ("line_start", "line_end"), ("e_start", "e_end"))
    order = Window.partitionBy("chunk_id").orderBy(F.col("e_end") - F.col("e_start"), "e_start", "entity_id")
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit + 1)


def citations(spans: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Chunks that show each span: up to eight per key by chunk index, and whether there are more."""
    from folionaut.operators.fusion import ranked_per_group
    from folionaut.operators.graph import overlapping

    pairs = overlapping(
        spans.select(key, "source_id", "line_start", "line_end"),
        chunks.select("source_id", "chunk_index", F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end")),
        "source_id", ("line_start", "line_end"), ("c_start", "c_end"),
    )
    first = ranked_per_group(pairs, key, ("chunk_index",), 9, "place")
    return first.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("place") <= 8, F.col("chunk_index")))).alias("chunks"),
        (F.max("place") > 8).alias("chunks_truncated"),
    )
