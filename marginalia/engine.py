"""The engine's front: from files or documents to chunks, and from questions to evidence and checks.

Embeddings and language models come in from outside: embed(texts column) -> array<float> column,
answer(prompt column) -> string column; neither is needed for lexical search, tables and checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import questions, signals
from marginalia.operators import aggregates, context, grids, retrieval
from marginalia.sources import chunks, decoders


class Engine:
    def __init__(self, spark: SparkSession, embed: Callable[[Column], Column] | None = None, answer: Callable[[Column], Column] | None = None, decode: dict[str, decoders.Decoder] | None = None):
        self.spark, self.embed, self.answer, self.decode = spark, embed, answer, decode

    def ingest(self, where: str) -> DataFrame:
        """Sections of all files below a folder, with their paths and captions."""
        return decoders.captioned(decoders.outlined(decoders.read_sections(self.spark, where, self.decode)))

    def chunk(self, docs: DataFrame, limit: int = 1800) -> DataFrame:
        """doc_id, chunk_no and text: paragraphs packed to chunks."""
        return docs.select("doc_id", F.posexplode(chunks.pack(F.split("text", r"\n{2,}"), limit)).alias("chunk_no", "text"))

    def search(self, docs: DataFrame, asked: DataFrame, k: int = 20) -> DataFrame:
        """Hits of questions (q_id, query): lexical, or hybrid if there is an embedding."""
        lexical = retrieval.bm25(docs, asked, k)
        if self.embed is None:
            return lexical
        rows = docs.select(F.col("doc_id").alias("id"), retrieval.normalised(self.embed(F.col("text"))).alias("v"))
        near = retrieval.cosine(rows, asked.select("q_id", retrieval.normalised(self.embed(F.col("query"))).alias("qv")), k).drop("place")
        texts = near.select("q_id", "id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id").join(asked.select("q_id", "query"), "q_id")
        shared = texts.select("q_id", "id", retrieval.shared_numbers(F.col("text"), F.col("query")).alias("shared"))
        return retrieval.hybrid(near, lexical.select("q_id", F.col("doc_id").alias("id"), "score"), shared, k).withColumnRenamed("id", "doc_id")

    def context(self, hits: DataFrame, docs: DataFrame, limit: int = 6000) -> DataFrame:
        """q_id and the text of its hits in order of place, under a budget of characters."""
        rows = hits.join(docs.select("doc_id", "text"), "doc_id")
        rows = aggregates.budget_prefix(rows, ["q_id"], ["place"], F.length("text"), limit, cut_last=True)
        rows = rows.withColumn("text", F.substring("text", F.lit(1), F.col("room").cast("int")))
        items = F.sort_array(F.collect_list(F.struct("place", "text")))  # bounded by the budget
        return rows.groupBy("q_id").agg(F.array_join(F.transform(items, lambda x: x["text"]), "\n\n").alias("context"))

    def ask(self, docs: DataFrame, asked: DataFrame, k: int = 8) -> DataFrame:
        """q_id, type, context and, with a model, the answer; too little context gives no answer."""
        found = asked.withColumn("type", questions.question_type(F.col("query"))).join(self.context(self.search(docs, asked, k), docs), "q_id", "left")
        if self.answer is None:
            return found
        enough = F.length(F.coalesce("context", F.lit(""))) >= 100
        return found.withColumn("answer", F.when(enough, self.answer(F.concat_ws("\n\n", "query", "context"))))

    def ask_reports(self, chunks: DataFrame, asked: DataFrame) -> DataFrame:
        """q_id, doc_id, type, n, context, good and, with a model, the answer of questions about documents' tables, figures and sections.

        chunks and asked as in operators.context; a context that fails the strict gate gives no answer.
        """
        near = None
        if self.embed is not None:
            rows = chunks.where(F.trim("text") != "").select("doc_id", "id", retrieval.normalised(self.embed(F.col("text"))).alias("v"))
            told = asked.select("q_id", "doc_id", retrieval.normalised(self.embed(F.col("query"))).alias("qv"))
            # a question meets the chunks of its own document
            sims = told.join(rows, "doc_id").select("q_id", "doc_id", "id", F.round(retrieval.dot(F.col("v"), F.col("qv")), 6).alias("sim"))
            near = retrieval.top(sims, ["q_id", "doc_id"], [F.desc("sim"), "id"], 16).drop("place")
        found = context.for_questions(chunks, asked, near=near)
        if self.answer is None:
            return found
        texts = found.join(asked.select("q_id", "doc_id", "query"), ["q_id", "doc_id"])
        return texts.withColumn("answer", F.when(F.col("good"), self.answer(F.concat_ws("\n\n", "query", "context")))).drop("query")

    def check(self, grid: DataFrame, asked: DataFrame | None = None) -> DataFrame:
        """All checks of a set of grids (table_id, row_idx, cells); with questions (query), only if one of them asks for calculations."""
        if asked is not None and not asked.where(signals.asks_for_calculation(F.col("query"))).limit(1).count():
            return grids.report(grid.limit(0))
        return grids.report(grid)
