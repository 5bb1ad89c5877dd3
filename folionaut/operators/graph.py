"""The syntax graph as tables: entities, observed edges, and their resolution by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folionaut.functions.names import family
from folionaut.functions.text import stable_id
from folionaut.operators.spans import overlapping

__all__ = ["BINDINGS", "current_sources", "entities", "observed_edges", "overlapping", "resolve"]

BINDINGS = ("variable", "parameter")


def entities(parsed: DataFrame) -> DataFrame:
    """One row per declared name, with the key under which other files may import it."""
    rows = parsed.select("source_id", "root_key", "path", "module_key", "language", F.inline("entities"))
    full = F.when(F.col("qualified_name") == "", F.col("module_key")).when(
        F.col("module_key") == "", F.col("qualified_name")
    ).otherwise(F.concat_ws(".", "module_key", "qualified_name"))
    return rows.withColumns(
        {
            "entity_id": stable_id(*[F.col(c) for c in ("source_id", "kind", "qualified_name", "ordinal")]),
            "full_key": full,
            "family": family(F.col("language")),
        }
    )


def observed_edges(parsed: DataFrame) -> DataFrame:
    """One row per observation, with the entity that makes it."""
    rows = parsed.select("source_id", "root_key", "module_key", "language", F.posexplode("edges").alias("edge_no", "e"))
    owner = [F.col("source_id"), F.col("e.owner_kind"), F.col("e.owner_name"), F.col("e.owner_ordinal")]
    hint = [F.col("source_id"), F.col("e.hint_kind"), F.col("e.hint_name"), F.col("e.hint_ordinal")]
    named = rows.withColumn("from_id", stable_id(*owner))
    return named.select(
        stable_id(F.col("from_id"), F.col("e.kind"), F.col("e.target_key"), F.col("e.line_start"), F.col("edge_no")).alias("relationship_id"),
        "source_id", "root_key", "module_key", "language", "from_id",
        *[F.col(f"e.{name}").alias(name) for name in ("owner_kind", "owner_name", "kind", "target_name", "target_key", "target_mode")],
        F.element_at(F.split("e.target_key", r"\."), -1).alias("target_leaf"),
        F.when(F.col("e.hint_kind").isNotNull(), stable_id(*hint)).alias("target_hint"),
        *[F.col(f"e.{name}").alias(name) for name in ("line_start", "line_end", "evidence")],
    )


def joined(scope: Column, name: Column) -> Column:
    return F.when(scope == "", name).otherwise(F.concat(scope, F.lit("."), name))


def scopes(name: Column) -> Column:
    """A qualified name, then each enclosing one, then the empty name of the file."""
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, F.size(parts) - n), ".")
    )


def _name_index(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per name: how many entities bear it, the first of them, and what kinds they are.

    A name borne by very many entities stays one row, so a join against it cannot multiply rows.
    """
    usable = F.col("kind") != "implementation"
    first = F.min(F.when(usable, F.struct("entity_id", "source_id", "kind")))
    return rows.groupBy(*key).agg(
        F.count_if(usable).alias("candidates"),
        first.alias("only"),
        F.count_if(usable & ~F.col("kind").isin(*BINDINGS)).alias("callable_candidates"),
        F.count_if(F.col("kind").isin(*BINDINGS)).alias("bindings"),
        F.count_if(F.col("kind") == "class").alias("classes"),
        F.min(F.when(usable, F.col("source_id"))).alias("low_source"),
        F.max(F.when(usable, F.col("source_id"))).alias("high_source"),
    )


def _lexical(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Nearest scope that declares the name: (relationship_id, candidates, only, ...)."""
    probes = edges.select(
        "relationship_id", "source_id", "language", "owner_kind", "target_key",
        F.posexplode(scopes(F.col("owner_name"))).alias("depth", "scope"),
    ).withColumns(
        {
            "name": joined(F.col("scope"), F.col("target_key")),
            "head": F.when(
                F.contains("target_key", F.lit(".")), joined(F.col("scope"), F.element_at(F.split("target_key", r"\."), 1))
            ),
            "enclosing": F.when(
                (F.col("language") == "python") & F.col("owner_kind").isin("method", "function") & (F.col("scope") != ""), F.col("scope")
            ),
        }
    )
    heads = index.filter(F.col("bindings") > 0).select("source_id", F.col("qualified_name").alias("head"), F.lit(True).alias("shadow"))
    classes = index.filter(F.col("classes") > 0).select("source_id", F.col("qualified_name").alias("enclosing"), F.lit(True).alias("in_class"))
    names = index.filter(F.col("candidates") > 0).withColumnRenamed("qualified_name", "name")
    facts = (
        probes.join(names, ["source_id", "name"], "left")
        .join(heads, ["source_id", "head"], "left")
        .join(classes, ["source_id", "enclosing"], "left")
    )
    stop = F.when(F.col("shadow"), F.lit("shadow")).when(
        F.col("in_class").isNull() & F.col("candidates").isNotNull(), F.lit("found")
    )
    columns = ("candidates", "only", "callable_candidates", "low_source", "high_source")
    found = facts.withColumn("stop", stop).filter(F.col("stop").isNotNull())
    nearest = found.groupBy("relationship_id").agg(F.min_by(F.struct("stop", *columns), "depth").alias("n"))
    return nearest.filter(F.col("n.stop") == "found").select("relationship_id", "n.*").drop("stop")


def resolve(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with ``target_id`` (only when exactly one candidate), ``resolution`` and the candidate count.

    ``known`` are the entities of current sources. Every lookup is an equi join against one row per name.
    """
    own = _name_index(known, ["source_id", "qualified_name"])
    public = _name_index(known, ["root_key", "family", "full_key"]).withColumnRenamed("full_key", "target_key")
    modules = known.filter((F.col("kind") == "module") & (F.col("qualified_name") == ""))
    columns = ["candidates", "only", "callable_candidates", "low_source", "high_source"]
    keyed = edges.withColumn("family", family(F.col("language")))

    hinted = keyed.filter(F.col("target_hint").isNotNull()).join(
        known.filter(F.col("kind") != "implementation").select(F.col("entity_id").alias("target_hint"), F.col("source_id"), F.struct("entity_id", "source_id", F.col("kind")).alias("only")),
        ["target_hint", "source_id"], "left",
    ).select(
        *edges.columns, F.when(F.col("only").isNotNull(), F.lit(1)).cast("bigint").alias("candidates"), "only",
        F.lit(1).cast("bigint").alias("callable_candidates"), F.col("source_id").alias("low_source"),
        F.col("source_id").alias("high_source"), F.lit("syntax").alias("method"),
    )
    free = keyed.filter(F.col("target_hint").isNull())
    by_file = modules.groupBy("root_key", F.col("path").alias("target_key")).agg(
        F.count("*").alias("candidates"), F.min(F.struct("entity_id", "source_id", "kind")).alias("only"),
        F.count("*").alias("callable_candidates"), F.min("source_id").alias("low_source"), F.max("source_id").alias("high_source"),
    )
    included = free.filter(F.col("target_mode") == "file").join(by_file, ["root_key", "target_key"], "left").select(
        *edges.columns, *columns, F.lit("include_static").alias("method")
    )
    imported = free.filter(F.col("target_mode") == "qualified").join(
        public.select("root_key", "family", "target_key", *columns), ["root_key", "family", "target_key"], "left"
    ).select(*edges.columns, *columns, F.lit("import_static").alias("method"))
    external = free.filter(~F.col("target_mode").isin("file", "qualified", "lexical")).select(
        *edges.columns, *[F.lit(None).cast(included.schema[c].dataType).alias(c) for c in columns], F.lit("unresolved").alias("method")
    )
    local = free.filter(F.col("target_mode") == "lexical")
    scoped = local.join(_lexical(local, own), "relationship_id", "left")
    # Go names may also be those of the package; only the open Go edges are looked up again, so that the
    # other edges do not meet in one partition under an empty key.
    open_go = F.col("candidates").isNull() & (F.col("language") == "go")
    package = public.filter(F.col("family") == "go").select("root_key", F.col("target_key").alias("package_key"), *columns)
    in_package = (
        scoped.filter(open_go).select(*edges.columns)
        .withColumn("package_key", F.concat_ws(".", "module_key", "target_key"))
        .join(package, ["root_key", "package_key"], "left")
        .select(*edges.columns, *columns, F.lit("package_static").alias("method"))
    )
    in_scope = scoped.filter(~open_go).select(*edges.columns, *columns, F.lit("local_static").alias("method"))
    found = hinted.unionByName(included).unionByName(imported).unionByName(external).unionByName(in_scope).unionByName(in_package)
    # A call never means a plain variable; a dependency means the file, not the name in it.
    count = F.when((F.col("kind") == "calls") & (F.col("callable_candidates") == 0), F.lit(0)).otherwise(F.coalesce("candidates", F.lit(0)))
    one_file = (F.col("kind") == "depends_on") & (F.col("low_source") == F.col("high_source"))
    found = found.withColumn("candidates", F.when(one_file & (count > 0), F.lit(1)).otherwise(count).cast("bigint"))
    single, dependency = F.col("candidates") == 1, F.col("kind") == "depends_on"
    lifted = modules.select(F.col("source_id").alias("low_source"), F.col("entity_id").alias("target_id"), F.lit("module").alias("target_kind"))
    files = found.filter(dependency & single).join(lifted, "low_source", "left")
    others = found.filter(~(dependency & single)).withColumns(
        {"target_id": F.when(single, F.col("only.entity_id")), "target_kind": F.when(single, F.col("only.kind"))}
    )
    target, target_kind = files.unionByName(others), F.col("target_kind")
    kind = F.when(
        (F.col("kind") == "type_base") & single,
        F.when((F.col("owner_kind") == "class") & (target_kind == "interface"), "implements").otherwise("inherits"),
    ).otherwise(F.col("kind"))
    resolution = F.when(F.col("candidates") > 1, "ambiguous").when(single, F.col("method")).otherwise("unresolved")
    return target.select(
        *[c for c in edges.columns if c != "kind"],
        kind.alias("kind"), F.col("kind").alias("observed_kind"), "candidates", "target_id", resolution.alias("resolution"),
    )


def current_sources(parsed: DataFrame, sources: DataFrame, parser_version: str) -> DataFrame:
    """Parse results that belong to the indexed content: same hash, same parser, live source."""
    live = sources.filter((F.col("status") == "indexed") & F.col("deleted_at").isNull())
    valid = parsed.filter(F.col("parser_version") == parser_version)
    return valid.join(live.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_semi")
