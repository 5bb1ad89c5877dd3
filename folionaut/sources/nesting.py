"""Nested declarations, members and bases of Java, JavaScript and TypeScript, from bracket depth.

A text is cut into comments, strings, headings and brackets by one pattern. Running sums over these give depth and line,
a declaration ends at the first closing bracket of its own depth, and what is open there encloses it. All of it is column
expressions and windows over the tokens of one file. Headings count if a ``{`` follows them; parameter lists with
brackets of their own are passed over. An unclosed declaration lasts to the end of its file. Null texts declare nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folionaut.functions.names import SCRIPT_FAMILY, family, normalize_name
from folionaut.functions.text import stable_id
from folionaut.operators.graph import joined
from folionaut.sources.outline import KINDS, NOT_CALLED, imports

LANGUAGES = (*SCRIPT_FAMILY, "java")
TYPES = ("class", "interface", "enum")

_COMMENT = r"/\*(?s:.*?)\*/|//[^\n]*"
_STRING = "|".join(rf"{q}[^{q}\\{line}]*+(?:\\.[^{q}\\{line}]*+)*+{q}" for q, line in (('"', r"\n"), ("'", r"\n"), ("`", "")))
_TYPE = r"\b(class|interface|enum|record)\s+([\w$]+)[^{};()]*(?:\([^()]*\)[^{};()]*)?(?=\{)"
_TYPE_NAME = r"^(class|interface|enum|record)\s+([\w$]+)"
_MEMBER = r"\b([\w$]+)\s*\([^(){};]*\)\s*(?::[^(){};=]*|throws\b[^(){};]*)?(?=\{)"
_TOKEN = "|".join((_COMMENT, _STRING, _TYPE, _MEMBER, r"[{}\n]"))
#: Type parameters within type parameters that are understood.
GENERIC_DEPTH = 4


def _plain(heading: Column) -> Column:
    """A heading without type parameters."""
    for _ in range(GENERIC_DEPTH):
        heading = F.regexp_replace(heading, r"<[^<>]*>", "")
    return heading


def declarations(files: DataFrame) -> DataFrame:
    """One row per declaration, with the entity that encloses it (``parent_id``, the file's own if there is none).

    Texts are dealt out by file once, into as many partitions as the session's shuffles have; tokens and all windows over
    them stay in these. A shuffle of tokens would be coalesced by its compressed size, and tokens take many times that in memory.
    """
    shared = ["source_id", "root_key", "path", "module_key", "language"]
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = files.where(F.col("language").isin(*LANGUAGES)).select(*shared, "text").repartition(spread, "source_id")
    tokens = known.select(*shared, F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    code = ~F.substring("token", 1, 1).isin('"', "'", "`", "/")
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    breaks = F.length("token") - F.length(F.translate("token", "\n", ""))
    word, named = F.regexp_extract("token", _TYPE_NAME, 1), F.regexp_extract("token", _TYPE_NAME, 2)
    name = F.when(named != "", named).otherwise(F.regexp_extract("token", r"^([\w$]+)", 1))
    read = tokens.withColumns({"step": step, "breaks": breaks, "word": F.when(code, word), "name": F.when(code & ~name.isin("", *NOT_CALLED), name)})
    # Only headings carry their text and what is known of their file; the other tokens are sorted as numbers.
    about = F.when(F.col("name").isNotNull(), F.struct(*shared[1:], "token", "name", "word")).alias("about")
    before = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = read.select("source_id", "pos", "step", "breaks", about).withColumns({"depth": sum_of("step"), "line": sum_of("breaks") + 1})
    closing = F.col("step") == -1
    marks = placed.where(closing | F.col("about").isNotNull()).withColumn("level", F.col("depth") - F.when(closing, 1).otherwise(0))
    # Seen from the end of the file, the last closing bracket of a level is the next one.
    later = Window.partitionBy("source_id", "level").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(closing, F.struct("pos", "line")), ignorenulls=True).over(later)
    found = marks.withColumn("end", end).where(F.col("about").isNotNull()).select("source_id", "pos", "line", "level", "end", "about")

    # A declaration is a row at its own level and asks, at each level below, what was opened there last.
    levels = found.withColumn("at", F.explode(F.sequence(F.least(F.col("level"), F.lit(0)), F.col("level")))).withColumn("own", F.col("at") == F.col("level"))
    past = F.coalesce("end.pos", F.lit(2147483647))
    owner = F.when(F.col("own"), F.struct("pos", past.alias("past"), "about.name", "about.word"))
    earlier = Window.partitionBy("source_id", "at").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    opened = levels.select(
        "source_id", "pos", "at", "own", *[F.when(F.col("own"), F.col(c)).alias(c) for c in ("line", "end", "about")], F.last(owner, ignorenulls=True).over(earlier).alias("around")
    )
    encloses = ~F.col("own") & (F.col("around.past") > F.col("pos")) & F.col("source_id").isNotNull()
    asking = Window.partitionBy("source_id", "pos")
    chain = F.array_sort(F.collect_list(F.when(encloses, F.struct("at", "around"))).over(asking))
    nested = opened.withColumn("chain", chain).where("own").select("source_id", "pos", "line", "end", "about.*", "chain")

    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    inner = F.try_element_at("chain", F.lit(-1))["around"]
    kinds = nested.withColumns({
        "scope": F.coalesce(F.array_join(F.transform("chain", lambda c: c["around"]["name"]), "."), F.lit("")), "parent_pos": inner["pos"],
        "kind": F.coalesce(F.try_element_at(table, F.col("word")), F.when(F.coalesce(inner["word"], F.lit("")) != "", "method").otherwise("function")),
    }).withColumn("qualified_name", joined(F.col("scope"), F.col("name")))
    same = Window.partitionBy("source_id", "kind", "qualified_name").orderBy("pos")
    rows = kinds.withColumn("ordinal", F.row_number().over(same) - 1).withColumn(
        "entity_id", stable_id(*[F.col(c) for c in ("source_id", "kind", "qualified_name", "ordinal")])
    )
    # What encloses a row is the row at its place; a row stands at its own place and at that of what encloses it.
    twice = rows.select("*", F.posexplode(F.array("pos", "parent_pos")).alias("asks", "place")).drop("chain")
    there = F.when(F.col("asks") == 0, F.struct("entity_id", "kind", "qualified_name"))
    asked = twice.withColumn("parents", F.collect_list(there).over(Window.partitionBy("source_id", "place"))).where("asks = 1")
    signature = F.trim(F.regexp_replace("token", r"\s+", " "))
    full = F.when(F.col("module_key") == "", F.col("qualified_name")).otherwise(F.concat_ws(".", "module_key", "qualified_name"))
    last = F.array_max(F.array(F.col("line"), F.col("end.line")))
    return asked.withColumn("parent", F.explode_outer("parents")).select(
        *shared, "kind", "name", "qualified_name", "ordinal", F.col("line").alias("line_start"), last.alias("line_end"), signature.alias("signature"),
        "entity_id", "scope", full.alias("full_key"), family(F.col("language")).alias("family"), F.col("pos").alias("position"),
        F.coalesce("parent.entity_id", stable_id(F.col("source_id"), F.lit("module"), F.lit(""), F.lit(0))).alias("parent_id"),
        F.coalesce("parent.kind", F.lit("module")).alias("parent_kind"), F.coalesce("parent.qualified_name", F.lit("")).alias("parent_name"),
    )


def edges(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Observed edges as ``graph.resolve`` takes them: ``contains`` from what encloses, ``type_base`` to each base of a type.

    A base is the import of that name, else a name of the file, else (Java) a name of the package.
    """
    shared = ["source_id", "root_key", "module_key", "language"]

    def row(owner: tuple[str, str, str], kind: str, target: Column, key: Column, mode: Column, hint: Column) -> list[Column]:
        names = ("from_id", "owner_kind", "owner_name")
        return [
            *map(F.col, shared), *[F.col(c).alias(n) for c, n in zip(owner, names)], F.lit(kind).alias("kind"), target.alias("target_name"), key.alias("target_key"),
            mode.alias("target_mode"), hint.cast("string").alias("target_hint"), F.col("line_start"), F.col("position"),
        ]

    qualified = F.col("qualified_name")
    contains = declared.select(*row(("parent_id", "parent_kind", "parent_name"), "contains", F.col("name"), qualified, F.lit("lexical"), F.col("entity_id")))
    heading = F.regexp_replace(_plain(F.col("signature")), r"\bpermits\b.*$", "")
    listed = F.concat_ws(",", *[F.regexp_extract(heading, rf"\b{w}\s+(.*?)(?:\b{stop}\b|$)", 1) for w, stop in (("extends", "implements"), ("implements", "extends"))])
    bases = F.filter(F.transform(F.split(listed, ","), lambda b: F.trim(b)), lambda b: b != "")
    typed = declared.where(F.col("kind").isin(*TYPES)).withColumn("base", F.explode(bases)).withColumn("key", normalize_name(F.col("base")))
    typed = typed.withColumn("alias", F.element_at(F.split("key", r"\."), 1))
    bound = imports(files).where("alias <> ''").groupBy("source_id", "alias").agg(F.max_by(F.struct("target", "mode"), "import_no").alias("b"))
    names = declared.select("source_id", F.col("name").alias("alias"), F.lit(True).alias("own")).distinct()
    placed = typed.join(bound, ["source_id", "alias"], "left").join(names, ["source_id", "alias"], "left")
    rest = F.expr("substring(key, length(alias) + 1)")
    free = F.col("own").isNull()
    packaged = free & (F.col("language") == "java") & ~F.contains("key", F.lit(".")) & (F.col("module_key") != "")
    key = F.when(free & F.col("b").isNotNull(), F.concat("b.target", rest)).when(packaged, F.concat_ws(".", "module_key", "key")).otherwise(F.col("key"))
    mode = F.when(free & F.col("b").isNotNull(), F.col("b.mode")).when(packaged, "qualified").otherwise("lexical")
    inherited = placed.select(*row(("entity_id", "kind", "qualified_name"), "type_base", F.col("base"), key, mode, F.lit(None)))
    every = contains.unionByName(inherited)
    return every.select(
        stable_id(F.col("from_id"), F.col("kind"), F.col("target_key"), F.col("line_start"), F.col("position")).alias("relationship_id"),
        *shared, "from_id", "owner_kind", "owner_name", "kind", "target_name", "target_key", "target_mode",
        F.element_at(F.split("target_key", r"\."), -1).alias("target_leaf"), "target_hint", "line_start", F.col("line_start").alias("line_end"), F.lit("").alias("evidence"),
    )
