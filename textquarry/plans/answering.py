"""Whole plans: documents to indexed passages, and questions to cited passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import sanitize
from textquarry.operators import retrieval as R
from textquarry.operators.chunking import passages
from textquarry.operators.vectors import hashed_embedding, knn
from textquarry.tables import table
from textquarry.workspace import written

#: Bits of a passage id that number the passages of a document.
PASSAGE_BITS = 20


def indexed(docs: DataFrame) -> DataFrame:
    """Clean, cut and embed: doc_id, chunk_no, start, content, id and embedding of every passage."""
    clean = sanitize(docs.where(F.length("text") > 0)).select("doc_id", F.col("clean").alias("text"))
    chunks = passages(clean, ["doc_id"])
    # The passage's place among all, as one number: documents are told apart by the high part. What does not fit fails.
    fits = F.col("doc_id").between(0, (1 << 43) - 1) & (F.col("chunk_no") < F.lit(1 << PASSAGE_BITS))
    number = F.col("doc_id") * F.lit(1 << PASSAGE_BITS) + F.col("chunk_no")
    ident = F.when(fits, number).otherwise(F.raise_error(F.lit("a document's id or number of passages is too large for a passage id")))
    return chunks.select("*", ident.alias("id"), hashed_embedding(F.col("content")).alias("embedding"))


def answered(spark: SparkSession, sf_dir: str, k: int = 5, least: float = 0.2) -> DataFrame:
    """Every benchmark item as a question: its nearest passages, reranked by their words, cited with source and place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    asked = items.select("query_id", hashed_embedding(F.col("question")).alias("embedding"))
    # Stored, so that whatever asks for the hits again does not embed the corpus again.
    hits = written(R.floored(knn(asked, indexed(docs).select("id", "embedding"), R.pool_size(k, reranking=True)), least).select("query_id", "id", "score"), "hits")
    # Only documents with a hit are cut again, for their passages' words; nothing of the others is read but their ids.
    named = hits.select(F.shiftright("id", PASSAGE_BITS).alias("doc_id")).distinct()
    near = written(indexed(docs.join(named, "doc_id", "left_semi")).select("id", "doc_id", "chunk_no", "start", "content").join(hits.select("id").distinct(), "id", "left_semi"), "passages")
    pairs = hits.join(near.select("id", F.col("content").alias("text")), "id").join(items, "query_id").select("query_id", "id", "question", "text")
    ranked = R.reranked(hits, R.lexical_scores(pairs), k, 0.0)
    cited = ranked.join(near, "id").join(docs.select("doc_id", "source"), "doc_id", "left")
    return cited.select("query_id", "rank", F.bround("final", 4).alias("score"), "doc_id", "chunk_no", "start", R.source_name(F.col("source"), F.lit("")).alias("source"), "content")
