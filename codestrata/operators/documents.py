"""Documents for retrieval: one per file, one per entity, then chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunking, splitter
from ..functions.text import WHITE_SPACE, list_repr, strip

METADATA = [
    "source", "filename", "file_extension", "type", "entity_name", "entity_type", "line_number", "language",
    "ast_parsed", "has_docstring", "has_parameters", "has_dependencies",
]


# The wording of the document templates in the functions below.


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _bullets(entities: Column) -> Column:
    """Entity list of a file as text."""

    def one(e: Column) -> Column:
        doc = F.when(F.length(e["docstring"]) > 0, _text("\n  Docstring: ", F.substring(e["docstring"], 1, 100), "..."))
        params = F.when(F.size(e["parameters"]) > 0, _text("\n  Parameters: ", F.array_join(e["parameters"], ", ")))
        head = _text("- ", e["name"], " (", e["type"], ") at line ", e["line_number"].cast("string"))
        return _text(head, F.coalesce(doc, F.lit("")), F.coalesce(params, F.lit("")))

    listed = F.array_join(F.transform(entities, one), "\n")
    return F.when(F.size(entities) > 0, listed).otherwise("No entities found")


def _entity_types(entities: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["type"]))), ", ")


def file_text() -> Column:
    e = F.coalesce("entities", F.array())
    body = _text(
        "File: ", F.col("name"), "\nLanguage: ", F.col("language"), "\nExtension: ", F.col("ext"),
        "\nTotal Entities: ", F.size(e).cast("string"), "\nEntity Types: ", _entity_types(e),
        "\n\nCode Content:\n", F.col("content"), "\n\nAST Parsed Entities:\n", _bullets(e),
    )
    return strip(body)


def entity_text(e: Column, name: Column, language: Column) -> Column:
    def or_else(c: Column, shown: Column, default: str) -> Column:
        return F.when(c > 0, shown).otherwise(default)

    return strip(
        _text(
            "Entity: ", e["name"], "\nType: ", e["type"], "\nFile: ", name, "\nLine: ", e["line_number"].cast("string"),
            "\nLanguage: ", language, "\nAST Parsed: True\n\nCode Content:\n", F.coalesce(e["content"], F.lit("None")),
            "\n\nDocstring: ", or_else(F.length(e["docstring"]), e["docstring"], "No docstring"),
            "\nParameters: ", or_else(F.size(e["parameters"]), list_repr(e["parameters"]), "No parameters"),
            "\nDependencies: ", or_else(F.size(e["dependencies"]), list_repr(e["dependencies"]), "No dependencies"),
            "\n\nContext: This ", e["type"], " is defined in ", name, " at line ", e["line_number"].cast("string"), ".",
        )
    )


def code_documents(entity_files: DataFrame) -> DataFrame:
    """File documents and entity documents, built inside the file's row: no join, no shuffle."""
    def present(c: Column, size=F.size) -> Column:
        return F.coalesce(size(c) > 0, F.lit(False))

    none_s, none_i, none_b = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("boolean")
    file_doc = F.struct(
        F.lit(0).alias("doc_no"), F.lit("code_file").alias("type"), none_s.alias("entity_name"), none_s.alias("entity_type"),
        none_i.alias("line_number"), none_b.alias("has_docstring"), none_b.alias("has_parameters"),
        none_b.alias("has_dependencies"), F.col("content").alias("code_content"), file_text().alias("text"),
    )
    entity_docs = F.transform(
        "entities",
        lambda e, i: F.struct(
            (i + 1).alias("doc_no"), F.lit("entity").alias("type"), e["name"].alias("entity_name"), e["type"].alias("entity_type"),
            e["line_number"].alias("line_number"), present(e["docstring"], F.length).alias("has_docstring"),
            present(e["parameters"]).alias("has_parameters"), present(e["dependencies"]).alias("has_dependencies"),
            e["content"].alias("code_content"), entity_text(e, F.col("name"), F.col("language")).alias("text"),
        ),
    )
    docs = F.concat(F.array(file_doc), F.coalesce(entity_docs, F.array().cast(_DOC_ARRAY)))
    rows = entity_files.select(
        F.col("path").alias("source"), F.col("name").alias("filename"), F.col("ext").alias("file_extension"), "language",
        F.explode_outer(docs).alias("d"),
    )
    return rows.select(
        F.concat_ws("#", "source", F.col("d.doc_no").cast("string")).alias("doc_id"),
        "source", "filename", "file_extension", "d.type", "d.entity_name", "d.entity_type", "d.line_number", "language",
        F.lit(True).alias("ast_parsed"), "d.has_docstring", "d.has_parameters", "d.has_dependencies",
        F.col("d.doc_no").alias("doc_no"), "d.code_content", F.col("d.text").alias("content"),
    )


_DOC_ARRAY = (
    "array<struct<doc_no:int,type:string,entity_name:string,entity_type:string,line_number:int,has_docstring:boolean,"
    "has_parameters:boolean,has_dependencies:boolean,code_content:string,text:string>>"
)


def text_documents(files: DataFrame) -> DataFrame:
    """Plain documents: the text of every readable file with its path as source."""
    return files.where(F.col("content").isNotNull()).select(
        F.col("path").alias("doc_id"), F.col("path").alias("source"), F.col("name").alias("filename"),
        F.col("ext").alias("file_extension"), F.lit("code").alias("type"), "content",
    )


def safe_metadata(documents: DataFrame) -> DataFrame:
    """The twelve metadata fields as text of at most 500 characters, and the code cut to 1000; nulls stay null."""
    def shown(name: str) -> Column:
        c = F.col(name)
        if dict(documents.dtypes)[name] == "boolean":
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        return F.substring(c.cast("string"), 1, 500).alias(name)

    code = F.when(F.length("code_content") > 0, F.substring("code_content", 1, 1000)).alias("code_content")
    return documents.select("doc_id", *[shown(m) for m in METADATA], code)


def chunks(documents: DataFrame, chunker: str = "recursive", size: int = splitter.CHUNK_SIZE, overlap: int = splitter.CHUNK_OVERLAP) -> DataFrame:
    """Chunk rows of any documents table; all other columns are carried along.

    ``recursive_native`` gives the chunks of ``recursive`` without Python in the plan, at a higher cost (see the README).
    """
    split = {"recursive": splitter.chunk_recursive, "recursive_native": chunking.chunk_recursive, "fixed": splitter.chunk_fixed}[chunker]
    rest = [c for c in documents.columns if c not in ("content", "code_content")]
    parts = documents.select(*rest, split(F.col("content"), size, overlap).alias("_chunks"))
    return parts.select(*rest, F.posexplode("_chunks").alias("chunk_no", "text")).select(
        F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")).alias("chunk_id"), "*"
    )


def chunk_stats(chunks_df: DataFrame) -> DataFrame:
    """Chunks in total, by file, by type and by language, in long form; missing values count as "unknown"."""
    keys = ["filename", "type", "language"]
    src = chunks_df.select(*[F.coalesce(F.col(k), F.lit("unknown")).alias(k) for k in keys])
    level = F.when(F.grouping("filename") == 0, "files").when(F.grouping("type") == 0, "entity_types").when(
        F.grouping("language") == 0, "languages"
    ).otherwise("total")
    return (
        src.groupingSets([[], *[[k] for k in keys]], *keys)
        .agg(level.alias("breakdown"), F.count(F.lit(1)).alias("chunks"))
        .select("breakdown", F.coalesce("filename", "type", "language", F.lit("")).alias("value"), "chunks")
    )


def corpus_chunk_summary(chunks_df: DataFrame) -> DataFrame:
    """Chunks per file extension of the whole index."""
    return chunks_df.groupBy("file_extension").agg(F.count(F.lit(1)).alias("chunks"))


def chunk_summary_text(chunks_df: DataFrame) -> DataFrame:
    """The short summary text: number of chunks and the file types found."""
    per_ext = corpus_chunk_summary(chunks_df)
    return per_ext.agg(
        F.sum("chunks").alias("n"), F.array_join(F.array_sort(F.collect_set("file_extension")), ", ").alias("types")
    ).select(
        F.concat(
            F.lit("Codebase Summary:\n- Total indexed chunks: "), F.coalesce("n", F.lit(0)).cast("string"),
            F.lit("\n- File types found: "), F.col("types"), F.lit("\n"),
        ).alias("summary")
    )


def index_report(documents: DataFrame, chunks_df: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents, chunks, entities and relationships in one row."""
    parts = {
        "documents_indexed": documents, "chunks_created": chunks_df, "entities_found": entities, "relationships_found": edges,
    }
    rows = None
    for k, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.agg(*[F.sum(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in parts])


def repository_documents(repos: DataFrame, files: DataFrame, counters: DataFrame) -> DataFrame:
    """Documents of a repository: its metadata, every non-empty file and the analysis summary.

    ``repos`` holds repository metadata, ``counters`` the long-form counters of the selected files.
    """
    def meta(c: str, default: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(default))

    about = repos.select(
        F.lit("repository_info").alias("source"), F.lit("metadata").alias("type"),
        _text("Repository: ", meta("name", "Unknown"), "\nDescription: ", meta("description", "No description"),
              "\nLanguage: ", meta("language", "Unknown"), "\nStars: ", meta("stars", "0"), "\nURL: ", meta("url", ""), "\n").alias("content"),
    )
    texts = files.where(F.length("content") > 0).select(
        F.col("path").alias("source"), F.lit("code").alias("type"), _text("File: ", F.col("path"), "\n\n", F.col("content")).alias("content")
    )
    # Counters are one row per category or severity, a fixed handful.
    def shown(kind: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("counter") == kind, _text("'", F.col("value"), "': ", F.col("issues").cast("string")))))
        return _text("{", F.array_join(pairs, ", "), "}")

    total = F.coalesce(F.sum(F.when(F.col("counter") == "category", F.col("issues"))), F.lit(0)).cast("string")
    summary = counters.agg(
        _text("Analysis Summary:\nTotal Issues: ", total, "\nIssues by Category: ", shown("category"),
              "\nIssues by Severity: ", shown("severity"), "\n").alias("content")
    ).select(F.lit("analysis_summary").alias("source"), F.lit("analysis").alias("type"), "content")
    return about.unionByName(texts).unionByName(summary)
