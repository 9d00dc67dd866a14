"""Index build and question answering up to the prompt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..operators import documents, entities, retrieval
from ..session import stage

Embedder = Callable[[DataFrame, str], DataFrame]


@dataclass
class Index:
    """Tables of an indexed corpus; each can be written and read back on its own."""

    files: DataFrame
    parsed: DataFrame
    entities: DataFrame
    edges: DataFrame
    documents: DataFrame
    chunks: DataFrame

    def report(self) -> DataFrame:
        return documents.index_report(self.documents, self.chunks, self.entities, self.edges)

    def summary_text(self, name: str) -> DataFrame:
        """Codebase summary as one text; it has one line per entity type and five more."""
        lines = entities.codebase_summary(
            name, entities.structure_totals(self.files, self.entities, self.edges), self.entities
        )
        ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
        return lines.agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n"), F.lit("\n")).alias("summary"))


def fit_term_embedder(texts: DataFrame, column: str, dims: int = 256) -> Embedder:
    """Vectors from hashed term weights, for corpora that bring none: term frequency, inverse frequency, unit length."""
    tokens = Tokenizer(inputCol=column, outputCol="_tokens")
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(tf.transform(tokens.transform(texts.select(column))))
    unit = Normalizer(inputCol="_idf", outputCol="_unit")

    def embed(df: DataFrame, text: str) -> DataFrame:
        named = df.withColumn(column, F.col(text)) if text != column else df
        out = unit.transform(idf.transform(tf.transform(tokens.transform(named))))
        out = out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_idf", "_unit")
        return out.drop(column) if text != column else out

    return embed


def hashed_embedder(dims: int = 256) -> Embedder:
    """Vectors from hashed term counts of unit length: each depends on its own text alone."""

    def embed(df: DataFrame, text: str) -> DataFrame:
        tokens = Tokenizer(inputCol=text, outputCol="_tokens").transform(df)
        counts = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims).transform(tokens)
        out = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
        return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_unit")

    return embed


def model_embedder(make_predict: Callable, batch_size: int = 256) -> Embedder:
    """Vectors from the caller's own model.

    ``make_predict()`` runs once per worker, where it loads the model, and returns a function from an array of texts to a matrix
    of their vectors.  Spark hands it the texts in batches of at most ``batch_size``.
    """
    predict = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def embed(df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("embedding", predict(F.col(text)))

    return embed


def build_index(files: DataFrame, embed: Embedder | None = None, chunker: str = "recursive") -> Index:
    """Documents, chunks and vectors of a files table.  Parsed structure and vectors are computed once and staged."""
    parsed = stage(entities.entity_files(files))
    found = parsed.select("path", F.posexplode("entities").alias("pos", "e")).select(F.col("path").alias("file_path"), "pos", "e.*")
    used = stage(entities.edges(found))
    docs = documents.code_documents(parsed)
    pieces = documents.chunks(docs, chunker)
    if embed is None:
        # Weights are fitted before vectors are made: two readers, for whom the texts are cut once.
        pieces = stage(pieces)
        embed = fit_term_embedder(pieces, "text")
    return Index(files, parsed, found, used, docs, stage(embed(pieces, "text")))


def answer_prompts(index: Index, questions: DataFrame, name: str = "corpus", k: int = 3) -> DataFrame:
    """Prompt table for a batch of ``questions(qid, question, embedding)``."""
    hits = stage(retrieval.retrieve(questions, index.chunks, index.entities, (index.parsed, index.edges), k))
    names = questions.select(retrieval.filename_in(F.col("question")).alias("filename")).where("filename IS NOT NULL")
    views = retrieval.file_views(retrieval.by_filename(index.chunks, names))
    return retrieval.prompts(questions, hits, index.summary_text(name), views)
