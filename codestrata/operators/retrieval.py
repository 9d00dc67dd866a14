"""Batch retrieval: questions against an index of chunks, entities and edges.

A question that names an indexed file gets that file's chunks; every other question gets its nearest
chunks, enriched with file facts, and related entities when there are fewer chunks than asked for.
All steps are joins and ranked windows over a ``questions(qid, question, embedding)`` table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, WORD, strip, truncate
from ..session import broadcast_if_small, stage
from .containment import contained
from .knn import nearest

# File-name patterns in order of preference, and the limits of the retrieval steps.
FILENAME_PATTERNS = [
    rf"({WORD}+\.py)", rf"({WORD}+\.js)", rf"({WORD}+\.ts)", rf"({WORD}+\.jsx)", rf"({WORD}+\.tsx)",
    rf"file{SPACE}+({WORD}+\.{WORD}+)", rf"in{SPACE}+({WORD}+\.{WORD}+)", rf"from{SPACE}+({WORD}+\.{WORD}+)",
]
FILE_HITS, FILE_ENTITY_HITS, FILE_OTHER_HITS = 10, 8, 2
MAX_FILE_RESULTS, MAX_RELATED, MAX_RELATED_HITS, MAX_SOURCES = 3, 3, 2, 5
HIT_CHARS, ENTITY_CHARS, PREVIEW_CHARS = 1000, 500, 200
CONTEXT_BUDGET, FILE_BUDGET, MIN_REMAINDER = 2000, 3000, 100
FILE_CONTEXT_CHARS, SUMMARY_CHARS = 1500, 1000
CANNED_QUESTIONS = {
    "security": "What security vulnerabilities can you identify in this codebase?",
    "performance": "What performance bottlenecks do you see in this code?",
    "maintainability": "What maintainability issues are present in this codebase?",
    "testing": "What testing gaps do you observe?",
    "documentation": "What documentation issues do you find?",
    "all": "What are the main quality issues and areas for improvement in this codebase?",
}


def filename_in(question: Column) -> Column:
    """File name mentioned in a question, or null; earlier patterns win, so ``a.jsx`` gives ``a.js``."""
    return F.coalesce(*[F.nullif(F.regexp_extract(question, "(?iu)" + p, 1), F.lit("")) for p in FILENAME_PATTERNS])


def canned_question(issue_type: Column) -> Column:
    """Standing question of an issue type; an unknown type asks about everything."""
    table = F.create_map(*[F.lit(x) for kv in CANNED_QUESTIONS.items() for x in kv])
    return F.coalesce(table[issue_type], F.lit(CANNED_QUESTIONS["all"]))


def by_extension(chunks: DataFrame, extension: str) -> DataFrame:
    return chunks.where(F.col("file_extension") == extension)


def by_filename(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunks of the asked files: all of them up to ten, else the first eight entities and two others.

    A popular file name may own a large share of the index.  The chunks are ranked within (file name, kind) and
    cut before the shuffle, and the totals come from a combined count, so no task sees a whole name.
    """
    asked = chunks.join(broadcast_if_small(names.select("filename").distinct()), "filename", "left_semi").withColumn(
        "is_entity", F.coalesce(F.col("type") == "entity", F.lit(False))
    )
    totals = asked.groupBy("filename").agg(F.count(F.lit(1)).alias("total_hits"))
    order = Window.partitionBy("filename", "is_entity").orderBy("source", "doc_no", "chunk_no")
    ranked = asked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= FILE_HITS)
    limit = F.when(F.col("is_entity"), FILE_ENTITY_HITS).otherwise(FILE_OTHER_HITS)
    kept = ranked.join(totals, "filename").where((F.col("total_hits") <= FILE_HITS) | (F.col("rn") <= limit))
    # Entities come first only when the list was cut; a complete list keeps index order.
    final = Window.partitionBy("filename").orderBy(
        F.when(F.col("total_hits") > FILE_HITS, F.when(F.col("is_entity"), 0).otherwise(1)).otherwise(0),
        "source", "doc_no", "chunk_no",
    )
    return kept.withColumn("hit_no", F.row_number().over(final)).drop("rn", "is_entity")


def _running(length: Column, part: Window) -> Column:
    return F.coalesce(F.sum(length).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def within_budget(rows: DataFrame, group: str, order: list, text: str, budget: int) -> DataFrame:
    """Rows in order while their texts fit ``budget``; the first that does not fit is cut when enough room is left.

    Adds ``part_no``.  Once a row overflows, all later rows are dropped.
    """
    part = Window.partitionBy(group).orderBy(*order)
    before = _running(F.length(text), part)
    sized = rows.withColumns({"_before": before, "part_no": F.row_number().over(part)})
    left = budget - F.col("_before")
    fits = F.length(text) <= left
    cut = F.concat(F.substring(F.col(text), F.lit(1), left.cast("int")), F.lit("..."))
    return (
        sized.where(fits | (left > MIN_REMAINDER))
        .withColumn(text, F.when(fits, F.col(text)).otherwise(cut))
        .drop("_before")
    )


def _joined(parts: DataFrame, group: str, text: str, name: str, separator: str = "\n\n") -> DataFrame:
    """Texts of a group in ``part_no`` order; groups hold at most a handful of budgeted rows."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", F.col(text).alias("t"))))
    return parts.groupBy(group).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), separator).alias(name))


def file_views(file_hits: DataFrame) -> DataFrame:
    """Text of a file from its (at most ten) hits, within 3000 characters."""
    parts = within_budget(file_hits, "filename", ["hit_no"], "text", FILE_BUDGET)
    return _joined(parts, "filename", "text", "file_content")


# ---- related entities ----------------------------------------------------------------------------------


def related_entities(questions: DataFrame, entities: DataFrame, limit: int = MAX_RELATED) -> DataFrame:
    """First entities related to each question: by name containment either way, then by the kind it asks for.

    Containment goes over an index of character runs (``operators.containment``), linear in the questions' text.  Entities are
    reduced to the first per name before they meet a question, so repeated names cost nothing.  The entity
    table is read several times: pass a staged or stored one.
    """
    at = F.struct("file_path", "pos")
    first = stage(entities.groupBy("name").agg(F.min(at).alias("at")).select(F.lower("name").alias("low"), "name", "at"))
    q = questions.select("qid", F.lower("question").alias("q"))
    named = contained(q, ["qid"], "q", first, "low").select("qid", "name", "at")
    # The other way round: only questions no longer than the longest name can lie within one.
    longest = first.agg(F.max(F.length("low"))).first()[0] or 0
    short = stage(q.where(F.length("q").between(1, longest)))
    if not short.isEmpty():
        named = named.unionByName(contained(first, ["name", "at"], "low", short, "q").select("qid", "name", "at"))
    # An empty question is contained in every name: the first few names serve all of them.
    by_order = first.orderBy("at").limit(limit).select(F.lit("").alias("q"), "name", "at")
    named = named.unionByName(q.where("q = ''").join(F.broadcast(by_order), "q").select("qid", "name", "at"))

    # By kind: enough first names of a kind to fill the limit even when all named ones are among them.
    kinds = None
    for kind in ("function", "class"):
        one = (
            entities.where(F.col("type") == kind)
            .groupBy("name")
            .agg(F.min(at).alias("at"))
            .orderBy("at")
            .limit(2 * limit)
            .select(F.lit(kind).alias("kind"), "name", "at")
        )
        kinds = one if kinds is None else kinds.unionByName(one)
    asked = F.when(F.contains("q", F.lit("function")), "function").when(F.contains("q", F.lit("class")), "class")
    by_kind = q.withColumn("kind", asked).where(F.col("kind").isNotNull()).join(F.broadcast(kinds), "kind").select("qid", "name", "at")

    staged = named.select("*", F.lit(0).alias("stage")).unionByName(by_kind.select("*", F.lit(1).alias("stage")))
    unique = staged.groupBy("qid", "name").agg(F.min(F.struct("stage", "at")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("best"))
    chosen = stage(
        unique.withColumn("related_no", rank)
        .where(F.col("related_no") <= limit)
        .select("qid", "related_no", F.col("best.at.file_path").alias("file_path"), F.col("best.at.pos").alias("pos"))
    )
    # Only now the wide entity rows are met, by their key.
    return entities.join(broadcast_if_small(chosen), ["file_path", "pos"]).select(
        "qid", "related_no", "file_path", "pos", "name", "type", "line_number", "content", "docstring", "parameters", "dependencies"
    )


# ---- hits ----------------------------------------------------------------------------------------------


def file_facts(entity_files: DataFrame, edges: DataFrame, chars: int = HIT_CHARS) -> DataFrame:
    """Per file: number and kinds of entities, their list and the file's edges as text, as far as ``chars`` shows them."""
    e = F.coalesce("entities", F.array())

    def bullet(x: Column) -> Column:
        def extra(cond: Column, label: str, shown: Column, tail: str = "") -> Column:
            return F.when(cond, F.concat(F.lit(f"  {label}: "), shown, F.lit(tail + "\n"))).otherwise("")

        return F.concat(
            F.lit("- "), x["name"], F.lit(" ("), x["type"], F.lit(") at line "), x["line_number"].cast("string"), F.lit("\n"),
            F.coalesce(extra(F.length(x["docstring"]) > 0, "Docstring", F.substring(x["docstring"], 1, 100), "..."), F.lit("")),
            F.coalesce(extra(F.size(x["parameters"]) > 0, "Parameters", F.array_join(x["parameters"], ", ")), F.lit("")),
            F.coalesce(extra(F.size(x["dependencies"]) > 0, "Dependencies", F.array_join(F.slice(x["dependencies"], 1, 5), ", ")), F.lit("")),
        )

    listing = F.array_join(F.transform(e, bullet), "")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(e, lambda x: x["type"]))), ", ")
    # A hit is cut to ``chars`` characters, so the text beyond that is never shown.
    facts = entity_files.select(
        F.col("path").alias("source"), F.size(e).alias("total_entities"), kinds.alias("entity_types"),
        F.left(listing, F.lit(chars + 1)).alias("entity_list"),
    )
    order = Window.partitionBy("file_path").orderBy("line_number", "source", "target")
    # An edge line has 20 characters at least, which bounds the lines within the cut.
    shown = edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= chars // 20 + 1)
    line = F.concat("source", F.lit(" "), "relationship_type", F.lit(" "), "target", F.lit(" (line "), F.col("line_number").cast("string"), F.lit(")\n"))
    lists = shown.groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))).alias("l"))
    edge_text = lists.select("path", F.array_join(F.transform("l", lambda s: F.concat(F.lit("- "), s["t"])), "").alias("edge_list"))
    return facts.join(edge_text, facts["source"] == edge_text["path"], "left").drop("path")


def enriched_text(with_facts: bool) -> Column:
    """Hit text with file information and, when known, the file's entities and relationships."""
    total = F.coalesce(F.col("total_entities"), F.lit(0)).cast("string") if with_facts else F.lit("0")
    kinds = F.coalesce(F.col("entity_types"), F.lit("")) if with_facts else F.lit("")
    info = F.concat(
        F.lit("\n\n**File Information:**\n- Filename: "), "filename", F.lit("\n- Language: "), F.coalesce("language", F.lit("Unknown")),
        F.lit("\n- Extension: "), F.coalesce("file_extension", F.lit("Unknown")), F.lit("\n- AST Parsed: "),
        F.when(F.coalesce("ast_parsed", F.lit(False)), "True").otherwise("False"), F.lit("\n- Total Entities: "), total,
        F.lit("\n- Entity Types: "), kinds, F.lit("\n"),
    )
    parts = [F.col("text"), info]
    if with_facts:
        for c, title in [("entity_list", "AST Parsed Entities"), ("edge_list", "Code Relationships")]:
            parts.append(F.when(F.length(c) > 0, F.concat(F.lit(f"\n\n**{title}:**\n"), c)).otherwise(""))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


HIT_COLUMNS = ["qid", "hit_kind", "hit_no", "source", "filename", "type", "entity_name", "line_number", "text"]


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    entities: DataFrame | None = None,
    structure: tuple[DataFrame, DataFrame] | None = None,
    k: int = 3,
) -> DataFrame:
    """At most ``k`` hits per question, in order; see the module text for the three kinds.

    ``structure`` is the pair (files with their entities, edges) that enriches similarity hits; facts are only built
    for the files that were hit.  Intermediate hits are a few rows per question and are staged, so the chunk table
    is scanned once per kind of search.
    """
    asked = questions.withColumn("filename", filename_in(F.col("question")))
    names = asked.where(F.col("filename").isNotNull()).select("qid", "filename")
    hits = by_filename(chunks, names).where(F.col("hit_no") <= min(k, MAX_FILE_RESULTS))
    by_name = stage(
        names.join(hits, "filename").select(
            "qid", F.lit("file").alias("hit_kind"), "hit_no", "source", "filename", "type", "entity_name", "line_number", "text"
        )
    )
    others = asked.drop("filename").join(by_name.select("qid").distinct(), "qid", "left_anti")

    near = stage(nearest(others.select("qid", "embedding"), chunks.select(F.col("chunk_id").alias("item_id"), "embedding"), k))
    keyed = near.withColumnRenamed("item_id", "chunk_id").drop("dist")
    found = stage(chunks.drop("embedding").join(broadcast_if_small(keyed), "chunk_id"))
    if structure is not None:
        paths = broadcast_if_small(found.select("source").distinct())
        parsed, edges = structure
        facts = file_facts(
            parsed.join(paths.select(F.col("source").alias("path")), "path", "left_semi"),
            edges.join(paths.select(F.col("source").alias("file_path")), "file_path", "left_semi"),
        )
        found = found.join(facts, "source", "left")
    similar = found.select(
        "qid", F.lit("similar").alias("hit_kind"), F.col("rank").alias("hit_no"), "source", "filename", "type", "entity_name",
        "line_number", truncate(enriched_text(structure is not None), HIT_CHARS).alias("text"),
    )
    out = by_name.unionByName(similar)
    if entities is not None:
        found_n = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
        short = stage(others.join(found_n, "qid", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k).select("qid", "question", "n"))
        if short.isEmpty():
            return out.select(*HIT_COLUMNS)
        related = related_entities(short.select("qid", "question"), entities).where(F.col("related_no") <= MAX_RELATED_HITS)
        extra = related.join(short.select("qid", "n"), "qid").select(
            "qid", F.lit("related").alias("hit_kind"), (F.col("n") + F.col("related_no")).cast("int").alias("hit_no"),
            F.col("file_path").alias("source"), F.element_at(F.split("file_path", "/"), -1).alias("filename"),
            F.lit("related_entity").alias("type"), F.col("name").alias("entity_name"), "line_number",
            strip(F.concat(
                F.lit("Entity: "), "name", F.lit("\nType: "), F.col("type"),
                F.lit("\nFile: "), F.element_at(F.split("file_path", "/"), -1), F.lit("\nLine: "), F.col("line_number").cast("string"),
                F.lit("\n\nCode Content:\n"), truncate(F.col("content"), ENTITY_CHARS),
                F.lit("\n\nDocstring: "), F.when(F.length("docstring") > 0, F.col("docstring")).otherwise("No docstring"),
                F.lit("\nParameters: "),
                F.when(F.size("parameters") > 0, F.concat(F.lit("['"), F.array_join("parameters", "', '"), F.lit("']"))).otherwise("No parameters"),
            )).alias("text"),
        ).where(F.col("hit_no") <= k)
        out = out.unionByName(extra)
    return out.select(*HIT_COLUMNS)


# ---- context and prompts -------------------------------------------------------------------------------


def contexts(hits: DataFrame) -> DataFrame:
    """Bounded context per question: entity hits first, then shorter ones, within 2000 characters."""
    order = [F.when(F.col("type") == "entity", 0).otherwise(1), F.length("text"), "hit_no"]
    return _joined(within_budget(hits, "qid", order, "text", CONTEXT_BUDGET), "qid", "text", "context")


def sources(hits: DataFrame) -> DataFrame:
    """Attribution lines per question, at most five: file, line and entity for entity hits, the file otherwise."""
    where = F.concat_ws(":", "filename", F.col("line_number").cast("string"))
    line = F.when(
        (F.col("type") == "entity") & (F.length("entity_name") > 0), F.concat(F.lit("- "), where, F.lit(" ("), "entity_name", F.lit(")"))
    ).otherwise(F.concat(F.lit("- "), "filename"))
    lines = hits.where(F.col("hit_no") <= MAX_SOURCES).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("hit_no", line.alias("t")))).alias("l")
    )
    return lines.select("qid", F.transform("l", lambda s: s["t"]).alias("sources"))


# Prompt texts.
PROMPT_HEAD = "You are an expert code analysis assistant. Answer the following question about the codebase:\n\nQuestion: "
PROMPT_RULES = """Instructions:
1. Provide specific examples from the code with line numbers when available
2. Explain how different parts of the code interact
3. If asked about specific functions/classes, explain their purpose and usage
4. Keep your response concise and focused

IMPORTANT: Only answer based on the provided context. If the context doesn't contain enough information, say "I need more specific information about this topic." Do not make up information."""
SIMPLE_HEAD = "You are a helpful code analysis assistant. Answer the following question about the codebase:\n\nQuestion: "
SIMPLE_TAIL = "\n\nPlease provide a helpful answer based on the context. If the context doesn't contain enough information, say so."
NO_CONTEXT = "No context available."


def prompts(questions: DataFrame, hits: DataFrame, summary: DataFrame | None = None, views: DataFrame | None = None) -> DataFrame:
    """``(qid, context, sources, prompt)``: everything an answering model is given.

    ``summary`` is a one-row table with the codebase summary, ``views`` the file texts by name.
    """
    base = (
        questions.select("qid", "question", filename_in(F.col("question")).alias("filename"))
        .join(contexts(hits), "qid", "left")
        .join(sources(hits), "qid", "left")
    )
    context = F.coalesce("context", F.lit(NO_CONTEXT))
    if views is not None:
        # Most questions name no file: their keys are made different, so that they spread over the join's tasks.
        nobody = F.concat(F.lit("\0"), F.col("qid").cast("string"))
        named = views.select(F.col("filename").alias("_view"), "file_content")
        base = base.withColumn("_key", F.coalesce("filename", nobody)).join(named, F.col("_key") == F.col("_view"), "left").drop("_key", "_view")
        seen = F.col("file_content").isNotNull() & ~F.contains(F.lower("file_content"), F.lit("not found"))
        context = F.when(
            seen,
            F.concat(
                F.lit("Specific file content for "), "filename", F.lit(":\n\n"),
                truncate(F.col("file_content"), FILE_CONTEXT_CHARS), F.lit("\n\n"), context,
            ),
        ).otherwise(context)
    overview = F.lit("")
    if summary is not None:
        base = base.withColumn("_one", F.lit(1)).join(F.broadcast(summary.limit(1).select(F.lit(1).alias("_one"), "summary")), "_one", "left")
        overview = truncate(F.coalesce("summary", F.lit("")), SUMMARY_CHARS)
    prompt = F.concat(
        F.lit(PROMPT_HEAD), "question", F.lit("\n\nCodebase Overview:\n"), overview,
        F.lit("\n\nRelevant Code Context:\n"), context, F.lit("\n\n" + PROMPT_RULES),
    )
    return base.select("qid", context.alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), prompt.alias("prompt"))


def simple_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Prompt of the plain path: the texts of the nearest chunks, one after the other."""
    texts = _joined(hits.withColumn("part_no", F.col("hit_no")), "qid", "text", "context", "\n")
    return questions.join(texts, "qid", "left").select(
        "qid",
        F.concat(
            F.lit(SIMPLE_HEAD), "question", F.lit("\n\nContext from codebase:\n"), F.coalesce("context", F.lit(NO_CONTEXT)), F.lit(SIMPLE_TAIL)
        ).alias("prompt"),
    )


def search_report(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Per question: file name found, file hits, similarity hits, their total and previews of both."""
    asked = questions.withColumn("filename_detected", filename_in(F.col("question")))
    names = asked.where(F.col("filename_detected").isNotNull()).select("qid", F.col("filename_detected").alias("filename"))
    preview = truncate(F.col("text"), PREVIEW_CHARS)
    file_hits = names.join(by_filename(chunks, names), "filename").select("qid", "hit_no", preview.alias("preview"))
    near = stage(nearest(asked.select("qid", "embedding"), chunks.select(F.col("chunk_id").alias("item_id"), "embedding"), k))
    sim_hits = chunks.select(F.col("chunk_id").alias("item_id"), "text").join(broadcast_if_small(near.drop("dist")), "item_id").select(
        "qid", F.col("rank").alias("hit_no"), preview.alias("preview")
    )
    out = asked.select("qid", "question", "filename_detected")
    for name, hits in [("file", file_hits), ("similarity", sim_hits)]:
        per_q = hits.groupBy("qid").agg(
            F.count(F.lit(1)).alias(f"{name}_hits"), F.array_sort(F.collect_list(F.struct("hit_no", "preview"))).alias("l")
        )
        per_q = per_q.select("qid", f"{name}_hits", F.transform("l", lambda s: s["preview"]).alias(f"{name}_previews"))
        out = out.join(per_q, "qid", "left").withColumn(f"{name}_hits", F.coalesce(f"{name}_hits", F.lit(0)))
    return out.withColumn("total_results", F.col("file_hits") + F.col("similarity_hits"))
