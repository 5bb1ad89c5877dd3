"""An outline of source files by line patterns, for languages without a parser here.

Declarations come from the same line rule that cuts code into blocks; imports and calls from
one pattern each. All of it is column expressions, windows and joins; scopes are not nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folionaut.functions.names import SCRIPT_FAMILY, family, module_key, normalize_name
from folionaut.functions.text import stable_id
from folionaut.sources.plaintext import CONTROL_WORDS, DECLARATION_WORDS, code_blocks

# Keyword of a declaration to the kind of entity.
KINDS = {
    "class": "class", "object": "class", "record": "class", "struct": "struct", "enum": "enum", "trait": "trait", "interface": "interface",
    "namespace": "namespace", "module": "module", "impl": "implementation", "type": "type_alias",
}
NOT_CALLED = (*CONTROL_WORDS, *DECLARATION_WORDS, "sizeof", "new", "await", "using", "include", "import")

SPEC = "array<struct<alias:string,target:string,mode:string,dependency:string>>"
SCRIPT_IMPORT = r"(?m)^[ \t]*import\s+(?:([^;'\"]+?)\s+from\s+)?['\"]([^'\"]+)['\"]"
INCLUDE = r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"][^>\"]+[>\"])"
JAVA_IMPORT = r"(?m)^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;"
JAVA_PACKAGE = r"(?m)^[ \t]*package\s+([\w.]+)\s*;"
SHARP_USING = r"(?m)^[ \t]*using\s+(?:static\s+)?(?:(\w+)\s*=\s*)?([\w.]+)\s*;"
GO_IMPORT = r"(?m)^[ \t]*(?:import\s+)?(?:([\w.]+)\s+)?\"([^\"\n]+)\"[ \t]*$"
GO_GROUP = r"(?ms)^import\s*\((.*?)^\)"
GO_SINGLE = r"(?m)^import\s+[^(\n]+$"
RUST_USE = r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"
CALL = r"(?<![\w.:>])([A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)*)\s*\("


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..``; null when it leaves the root."""
    def step(kept: Column, part: Column) -> Column:
        up = F.when(F.size(kept) > 0, F.slice(kept, 1, F.size(kept) - 1))
        return F.when(part == "..", up).when(part.isin("", "."), kept).otherwise(F.array_append(kept, part))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def _beside(path: Column, name: Column) -> Column:
    return normal_path(F.concat(F.regexp_replace(path, r"[^/]*$", ""), name))


def _spec(alias: Column, target: Column, mode: Column, dependency: Column) -> Column:
    names = ("alias", "target", "mode", "dependency")
    return F.struct(*[c.cast("string").alias(n) for n, c in zip(names, (alias, normalize_name(target), mode, normalize_name(dependency)))])


def _matches(text: Column, pattern: str, build) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)


def _part(match: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(match, pattern, group)


def _script(text: Column, path: Column) -> Column:
    def one(match: Column) -> Column:
        source, clause = _part(match, SCRIPT_IMPORT, 2), _part(match, SCRIPT_IMPORT, 1)
        local = F.when(source.startswith("."), module_key(_beside(path, F.concat(source, F.lit(".js"))), F.lit("javascript")))
        key, mode = F.coalesce(local, source), F.when(local.isNotNull(), "qualified").otherwise("external")

        def named(item: Column) -> Column:
            words = F.split(F.trim(item), r"\s+as\s+")
            return _spec(F.element_at(words, -1), F.concat(key, F.lit("."), words[0]), mode, key)

        inside = F.filter(F.split(_part(clause, r"\{([^}]*)\}", 1), ","), lambda i: F.trim(i) != "")
        space, default = _part(clause, r"\*\s+as\s+(\w+)", 1), _part(clause, r"^\s*(\w+)\s*(?:,|$)", 1)
        parts = F.concat(
            F.transform(inside, named),
            F.when(space != "", F.array(_spec(space, key, mode, key))).otherwise(F.array().cast(SPEC)),
            F.when(default != "", F.array(_spec(default, F.concat(key, F.lit(".default")), mode, key))).otherwise(F.array().cast(SPEC)),
        )
        return F.when(F.size(parts) > 0, parts).otherwise(F.array(_spec(F.lit(""), key, mode, key)))

    return F.flatten(_matches(text, SCRIPT_IMPORT, one))


def _include(text: Column, path: Column) -> Column:
    def one(match: Column) -> Column:
        written = _part(match, INCLUDE, 1)
        name = F.regexp_replace(written, '[<>"]', "")
        local = F.when(written.startswith('"'), _beside(path, name))
        target = F.coalesce(local, name)
        return _spec(F.lit(""), target, F.when(local.isNotNull(), "file").otherwise("external"), target)

    return _matches(text, INCLUDE, one)


def _java(text: Column) -> Column:
    target = lambda m: _part(m, JAVA_IMPORT, 1)
    return _matches(text, JAVA_IMPORT, lambda m: _spec(F.element_at(F.split(target(m), r"\."), -1), target(m), F.lit("qualified"), target(m)))


def _sharp(text: Column) -> Column:
    return _matches(
        text, SHARP_USING, lambda m: _spec(_part(m, SHARP_USING, 1), _part(m, SHARP_USING, 2), F.lit("qualified"), _part(m, SHARP_USING, 2))
    )


def _go(text: Column) -> Column:
    def one(match: Column) -> Column:
        target, alias = _part(match, GO_IMPORT, 2), _part(match, GO_IMPORT, 1)
        name = F.when(alias != "", alias).otherwise(F.element_at(F.split(target, "/"), -1))
        return _spec(name, target, F.lit("external"), target)

    lines = F.concat(
        F.flatten(F.transform(F.regexp_extract_all(text, F.lit(GO_GROUP), F.lit(1)), lambda body: F.split(body, "\n"))),
        F.regexp_extract_all(text, F.lit(GO_SINGLE), F.lit(0)),
    )
    return F.transform(F.filter(lines, lambda line: line.rlike(GO_IMPORT)), one)


def _rust(text: Column, module: Column) -> Column:
    def absolute(name: Column) -> Column:
        parent = F.regexp_replace(module, r"\.[^.]*$", "")
        return F.when(name.startswith("self."), F.concat(module, F.substring(name, 5, 2147483647))).when(
            name.startswith("super."), F.concat(parent, F.substring(name, 6, 2147483647))
        ).otherwise(name)

    def one(match: Column) -> Column:
        body = F.trim(_part(match, RUST_USE, 1))
        prefix, inside = _part(body, r"(?s)^(.*?)::\{", 1), _part(body, r"(?s)\{(.*)\}", 1)
        items = F.when(inside != "", F.transform(F.split(inside, ","), lambda i: F.concat(prefix, F.lit("::"), F.trim(i)))).otherwise(F.array(body))

        def item(written: Column) -> Column:
            words = F.split(written, r"\s+as\s+")
            path = normalize_name(words[0])
            alias = F.when(F.size(words) > 1, words[1]).otherwise(F.element_at(F.split(path, r"\."), -1))
            return _spec(alias, absolute(path), F.lit("qualified"), absolute(path))

        return F.transform(F.filter(items, lambda i: ~i.endswith("::")), item)

    return F.flatten(_matches(text, RUST_USE, one))


def imports(files: DataFrame) -> DataFrame:
    """(source_id, ..., alias, target, mode, dependency), one row per imported name."""
    text, path, lang = F.col("text"), F.col("path"), F.col("language")
    found = (
        F.when(lang.isin(*SCRIPT_FAMILY), _script(text, path)).when(lang.isin("c", "cpp"), _include(text, path)).when(lang == "java", _java(text))
        .when(lang == "c_sharp", _sharp(text)).when(lang == "go", _go(text)).when(lang == "rust", _rust(text, F.col("module_key")))
    )
    return files.select("source_id", "root_key", "module_key", "path", "language", F.posexplode(found.cast(SPEC)).alias("import_no", "i")).select(
        "source_id", "root_key", "module_key", "path", "language", "import_no", "i.*"
    )


def with_package(files: DataFrame) -> DataFrame:
    """Java files are known by their package, not by their path."""
    package = F.regexp_extract("text", JAVA_PACKAGE, 1)
    return files.withColumn("module_key", F.when(F.col("language") == "java", package).otherwise(F.col("module_key")))


def _blocks(files: DataFrame) -> DataFrame:
    """Declared blocks with kind and ordinal; the part before the first declaration belongs to the file."""
    head = F.element_at(F.split("text", "\n"), 1)
    word = F.regexp_extract(head, rf"\b({'|'.join(DECLARATION_WORDS)})\s", 1)
    table = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    rows = files.select("source_id", "root_key", "module_key", "path", "language", F.inline(code_blocks(F.col("text"))))
    named = rows.select(
        "source_id", "root_key", "module_key", "path", "language", "text", "line_start", "line_end",
        normalize_name(F.col("heading")).alias("name"),
        F.when(F.col("heading").isNull(), "module").otherwise(F.coalesce(F.try_element_at(table, word), F.lit("function"))).alias("kind"),
        F.substring(head, 1, 512).alias("signature"),
    )
    same = Window.partitionBy("source_id", "kind", "name").orderBy("line_start")
    # All nameless parts of a file stand for the file itself.
    return named.withColumn("ordinal", F.when(F.col("name").isNull(), 0).otherwise(F.row_number().over(same) - 1)).withColumn(
        "qualified_name", F.coalesce("name", F.lit(""))
    ).withColumn("entity_id", stable_id(F.col("source_id"), F.col("kind"), F.col("qualified_name"), F.col("ordinal")))


def entities(files: DataFrame) -> DataFrame:
    """The columns of graph entities: one per file, one per declaration."""
    modules = files.select(
        "source_id", "root_key", "path", "module_key", "language", F.lit("module").alias("kind"), F.col("path").alias("name"), F.lit("").alias("qualified_name"),
        F.lit(0).alias("ordinal"), F.lit(1).alias("line_start"), F.greatest(F.size(F.split("text", "\n")), F.lit(1)).alias("line_end"), F.col("path").alias("signature"),
        stable_id(F.col("source_id"), F.lit("module"), F.lit(""), F.lit(0)).alias("entity_id"),
    )
    declared = _blocks(files).filter(F.col("name").isNotNull())
    rows = declared.select(*modules.columns).unionByName(modules)
    full = F.when(F.col("qualified_name") == "", F.col("module_key")).when(F.col("module_key") == "", F.col("qualified_name")).otherwise(
        F.concat_ws(".", "module_key", "qualified_name")
    )
    return rows.withColumns({"scope": F.lit(""), "full_key": full, "family": family(F.col("language"))})


def edges(files: DataFrame) -> DataFrame:
    """The columns of observed edges: imports and dependencies of files, calls inside blocks."""
    found = imports(files)
    owner = stable_id(F.col("source_id"), F.lit("module"), F.lit(""), F.lit(0))
    kinds = F.explode(F.array(F.struct(F.lit("imports").alias("kind"), F.col("target").alias("key")), F.struct(F.lit("depends_on").alias("kind"), F.col("dependency").alias("key"))))
    shared = ("source_id", "root_key", "module_key", "language")
    of_files = found.withColumn("k", kinds).select(
        *shared, owner.alias("from_id"), F.lit("module").alias("owner_kind"), F.lit("").alias("owner_name"), F.col("k.kind").alias("kind"),
        F.col("k.key").alias("target_name"), F.col("k.key").alias("target_key"), F.col("mode").alias("target_mode"), F.lit(1).alias("line_start"), F.col("import_no").alias("position"),
    )
    lines = _blocks(files).select(
        *shared, "entity_id", "kind", "qualified_name", F.col("line_start").alias("first"), F.posexplode(F.split("text", "\n")).alias("n", "line")
    )
    calls = lines.select(*shared, "entity_id", "kind", "qualified_name", "n", (F.col("first") + F.col("n")).alias("line_start"),
                         F.posexplode(F.regexp_extract_all("line", F.lit(CALL), F.lit(1))).alias("position", "written")).filter(
        ~F.col("written").isin(*NOT_CALLED) & ~((F.col("n") == 0) & (F.col("written") == F.col("qualified_name")))
    )
    key = normalize_name(F.col("written"))
    first = F.element_at(F.split("key", r"\."), 1)
    called = calls.withColumn("key", key).withColumn("alias", first)
    # An import binds a name unless the file declares that name itself; the last import of a name wins.
    bound = found.filter(F.col("alias") != "").groupBy("source_id", "alias").agg(F.max_by(F.struct("target", "mode"), "import_no").alias("b"))
    declared = _blocks(files).filter(F.col("name").isNotNull()).select("source_id", F.col("name").alias("alias")).distinct()
    free = bound.join(declared, ["source_id", "alias"], "left_anti")
    resolved = called.join(free, ["source_id", "alias"], "left")
    rest = F.expr("substring(key, length(alias) + 1)")
    of_calls = resolved.select(
        *shared, F.col("entity_id").alias("from_id"), F.col("kind").alias("owner_kind"), F.col("qualified_name").alias("owner_name"), F.lit("calls").alias("kind"),
        F.col("key").alias("target_name"), F.when(F.col("b").isNotNull(), F.concat("b.target", rest)).otherwise(F.col("key")).alias("target_key"),
        F.coalesce("b.mode", F.lit("lexical")).alias("target_mode"), "line_start", "position",
    )
    every = of_files.unionByName(of_calls)
    return every.select(
        stable_id(F.col("from_id"), F.col("kind"), F.col("target_key"), F.col("line_start"), F.col("position")).alias("relationship_id"),
        *shared, "from_id", "owner_kind", "owner_name", "kind", "target_name", "target_key", "target_mode",
        F.element_at(F.split("target_key", r"\."), -1).alias("target_leaf"), F.lit(None).cast("string").alias("target_hint"),
        "line_start", F.col("line_start").alias("line_end"), F.lit("").alias("evidence"),
    )
