"""Code structure: entities, the edges between them, counts and the import graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import CODE_EXTS, display_language
from ..functions.structure import extract_entities, parse_code
from ..session import salted_join, stage
from ..sources.tables import analysable


def entity_files(files: DataFrame) -> DataFrame:
    """One row per code file with its entities as an array, in source order of discovery.

    Files parsed before (``parsed_files``) are not parsed again.
    """
    code = analysable(files).where(F.col("ext").isin(CODE_EXTS))
    found = F.col("entities") if "entities" in files.columns else extract_entities(F.col("ext"), F.col("content"))
    return code.select(
        "path", "name", "parent", "stem", "ext", "content", display_language(F.col("ext")).alias("language"), found.alias("entities")
    )


def parsed_files(files: DataFrame) -> DataFrame:
    """A files table with ``facts`` and ``entities`` of every file from one parse, staged.

    Rules, index and entity tables of this table need no parser any more.
    """
    code = files.withColumn("_code", parse_code(F.col("ext"), F.col("language"), F.col("content")))
    return stage(code.select(*files.columns, F.col("_code.facts").alias("facts"), F.col("_code.entities").alias("entities")))


def entities(files: DataFrame) -> DataFrame:
    """One row per function, class or import; ``pos`` is its position in the file's result."""
    return entity_files(files).select("path", F.posexplode("entities").alias("pos", "e")).select(
        F.col("path").alias("file_path"), "pos", "e.*"
    )


def edges(entities_df: DataFrame) -> DataFrame:
    """'uses' edges: a dependency that is the name of an entity of the same file.

    Keyed by file and name, so a large file spreads over tasks; names are made distinct first.  The table is read
    twice: pass a staged or stored one, so that no file is parsed twice.
    """
    uses = entities_df.select(
        "file_path", F.col("name").alias("source"), "line_number", F.explode("dependencies").alias("target")
    )
    names = entities_df.select("file_path", F.col("name").alias("target")).distinct()
    # Staged tables are small as compressed files and may be large in memory: the planner must not broadcast one by its file size.
    return uses.join(names.hint("merge"), ["file_path", "target"]).select(
        "source", "target", F.lit("uses").alias("relationship_type"), "file_path", "line_number"
    )


def find_entities(entities_df: DataFrame, name: str) -> DataFrame:
    """Entities whose name contains ``name``, ignoring case."""
    return entities_df.where(F.contains(F.lower("name"), F.lit(name.lower())))


def edges_of(edges_df: DataFrame, name: str) -> DataFrame:
    """Edges that start or end at ``name``."""
    return edges_df.where((F.col("source") == name) | (F.col("target") == name))


def entity_counts(entities_df: DataFrame) -> DataFrame:
    return entities_df.groupBy("type").agg(F.count(F.lit(1)).alias("entities"))


def structure_totals(files: DataFrame, entities_df: DataFrame, edges_df: DataFrame) -> DataFrame:
    """Files, entities and edges in one row; each branch reduces to one row before they meet."""
    n = F.count(F.lit(1))
    parts = [
        analysable(files).agg(n.alias("n")).select(F.lit("files").alias("k"), "n"),
        entities_df.agg(n.alias("n")).select(F.lit("entities").alias("k"), "n"),
        edges_df.agg(n.alias("n")).select(F.lit("edges").alias("k"), "n"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("files", "entities", "edges")])


def dependency_counts(entities_df: DataFrame) -> DataFrame:
    """Dependencies per entity name; the last entity with a name decides."""
    has = entities_df.where(F.size("dependencies") > 0)
    return has.groupBy("name").agg(
        F.max_by(F.size("dependencies"), F.struct("file_path", "pos")).alias("dependencies")
    )


def top_dependencies(entities_df: DataFrame, n: int = 5) -> DataFrame:
    return dependency_counts(entities_df).orderBy(F.desc("dependencies"), "name").limit(n)


def codebase_summary(name: str, totals: DataFrame, entities_df: DataFrame, n: int = 5) -> DataFrame:
    """Summary text as ordered lines ``(ord, line)``: totals, entity types and the entities with most dependencies."""
    text = F.col

    # Headings and labels of the summary.
    def line(order: int, *parts: Column | str) -> Column:
        cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
        return F.struct(F.lit(order).alias("ord"), F.concat(*cols).alias("line"))

    head = totals.select(
        F.inline(
            F.array(
                line(0, f"Codebase Summary for {name}"),
                line(1, ""),
                line(2, "**Files Analyzed:** ", text("files").cast("string")),
                line(3, "**Code Entities:** ", text("entities").cast("string")),
                line(4, "**Relationships:** ", text("edges").cast("string")),
                line(5, ""),
                line(6, "**Entity Types:**"),
            )
        )
    )
    types = entity_counts(entities_df).select(
        F.lit(7).alias("ord"), F.concat(F.lit("- "), "type", F.lit(": "), F.col("entities").cast("string")).alias("line")
    )
    top = top_dependencies(entities_df, n)
    # The heading appears only when there is an entity to list below it.
    heading = top.limit(1).select(
        F.inline(F.array(line(8, ""), line(9, "**Most Complex Entities (by dependencies):**")))
    )
    body = top.select(
        F.lit(10).alias("ord"),
        F.concat(F.lit("- "), "name", F.lit(": "), F.col("dependencies").cast("string"), F.lit(" dependencies")).alias("line"),
    )
    return head.unionByName(types).unionByName(heading).unionByName(body)


def import_edges(files: DataFrame, entities_df: DataFrame) -> DataFrame:
    """File-to-file imports that resolve inside the tree.

    A script import is relative to its directory; a Python import names a sibling module, with dots as
    directories.  The join key is the full target path without suffix, so popular module names do not meet.
    """
    imports = entities_df.where("type = 'import'").select(
        "file_path", "name", "content", F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("dir")
    )
    is_py = F.col("file_path").endswith(".py")
    from_module = F.regexp_extract("content", r"^from (\S+) import ", 1)
    module = F.when(from_module.isin("", "None"), F.col("name")).otherwise(from_module)
    py_key = F.concat("dir", F.lit("/"), F.replace(module, F.lit("."), F.lit("/")))
    spec = F.regexp_replace("name", r"\.(?:js|ts|jsx|tsx)$", "")
    ups = F.size(F.split(spec, r"\.\./", -1)) - 1
    base = F.split("dir", "/")
    js_dir = F.array_join(F.slice(base, F.lit(1), F.greatest(F.size(base) - ups, F.lit(0))), "/")
    js_key = F.when(spec.rlike(r"^\.{1,2}/"), F.concat(js_dir, F.lit("/"), F.regexp_replace(spec, r"^(?:\.{1,2}/)+", "")))
    sources = imports.select(
        F.col("file_path").alias("source"), is_py.alias("py"), F.when(is_py, py_key).otherwise(js_key).alias("key")
    ).where(F.col("key").isNotNull())
    targets = files.where(F.col("language").isNotNull()).select(
        F.col("path").alias("target"), (F.col("language") == "python").alias("py"), F.concat_ws("/", "parent", "stem").alias("key")
    )
    # One module may be imported by a large share of all files; its targets are at most a few suffixes.
    return salted_join(sources, targets, ["py", "key"], "source").select("source", "target").distinct()


def import_degrees(import_edges_df: DataFrame) -> DataFrame:
    """Imports made and received per file."""
    ends = import_edges_df.select(
        F.inline(
            F.array(
                F.struct(F.col("source").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("target").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("path").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
