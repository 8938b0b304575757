"""From hits to ranked, linked and cited passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def floored(hits: DataFrame, least: float) -> DataFrame:
    """VEC3."""
    return hits.where(F.col("score") >= least)


def merged_hits(hits: DataFrame) -> DataFrame:
    """VEC7: one row a question and hit: the best score (none counts as 0, ties keep the earlier part), a picture if any copy is."""
    key = F.struct(F.coalesce("score", F.lit(0.0)), -F.col("part"))
    return hits.groupBy("query_id", "id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"), F.max_by("part", key).alias("part"), F.when(F.bool_or(F.col("kind") == "image"), "image").otherwise("text").alias("kind"))


def top_of_each_kind(hits: DataFrame, texts: int, pictures: int = 4) -> DataFrame:
    """VEC8: so many texts, then so many pictures, each by score."""
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id"))
    kept = hits.withColumn("_p", place).where(F.col("_p") <= F.when(F.col("kind") == "image", pictures).otherwise(texts))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("kind") == "image", "_p"))
    return kept.withColumn("rank", rank).drop("_p")


def pool_size(top_k: int, reranking: bool) -> int:
    """VEC9."""
    return max(top_k, 20) if reranking else top_k


def reranked(hits: DataFrame, scores: DataFrame, n: int, least: float) -> DataFrame:
    """VEC10, WIN9: by the reranker's score with a floor; a question without any score keeps the vector order."""
    return rescored(hits.join(scores.select("query_id", "id", F.col("score").alias("again")), ["query_id", "id"], "left"), n, least)


def rescored(hits: DataFrame, n: int, least: float) -> DataFrame:
    """VEC10: the same of hits that have the reranker's score, or null, in a column again: nothing is joined."""
    any_score = F.max(F.col("again").isNotNull()).over(Window.partitionBy("query_id"))
    both = hits.select("query_id", "id", "score", "again").withColumn("_any", any_score)
    kept = both.select("query_id", "id", F.when(F.col("_any"), F.col("again")).otherwise(F.col("score")).alias("final"), "_any").where(~F.col("_any") | (F.col("final") >= least)).drop("_any")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("final"), "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "id", "final", "rank")


def even_scores(hits: DataFrame) -> DataFrame:
    """VEC11: (n - i) / n by the order at hand."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return hits.withColumn("score", (n - (F.col("rank") - 1)) / n)


def lexical_scores(pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """VEC10: a stand-in reranker: BM25 of question and text over the candidate passages, (query_id, id, question, text)."""
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != "")
    passages = pairs.select("id", "text").dropDuplicates(["id"]).select("id", words(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    totals = passages.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    terms = passages.select("id", "len", F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = pairs.select("query_id", "id", F.explode(F.array_distinct(words(F.col("question")))).alias("term"))
    found = asked.join(terms, ["id", "term"]).join(frequency, "term").join(F.broadcast(totals))  # one row of totals
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return found.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def resolved(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN1: hits with their passage; one without a passage stays."""
    return hits.join(chunks, ["asset_id", "chunk_order"], "left")


def location(row: Column, seconds: Column, page: Column) -> Column:
    """JOIN2: row before time before page; pages are shown from 1."""
    from textquarry.functions.text import time_label

    return F.when(row.isNotNull(), F.concat(F.lit("row "), row.cast("string"))).when(seconds.isNotNull(), time_label(seconds)).when(page.isNotNull(), F.concat(F.lit("page "), (page + 1).cast("string")))


def source_name(live: Column, stale: Column) -> Column:
    """JOIN3."""
    return F.coalesce(F.nullif(live, F.lit("")), F.nullif(stale, F.lit("")), F.lit("unknown"))


def expanded(hits: DataFrame, links: DataFrame, images: int = 2, texts: int = 2) -> DataFrame:
    """JOIN7: partners of hits that are no hits themselves, the first to bring one counts, so many pictures and texts a question."""
    partners = hits.select("query_id", F.col("id").alias("linked_from"), "rank").join(links.withColumnRenamed("id", "linked_from"), "linked_from")
    fresh = partners.join(hits.select("query_id", F.col("id").alias("partner")), ["query_id", "partner"], "left_anti")
    first = F.row_number().over(Window.partitionBy("query_id", "partner").orderBy("rank", "linked_from"))
    once = fresh.withColumn("_f", first).where("_f = 1")
    place = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank", "partner"))
    return once.withColumn("_p", place).where(F.col("_p") <= F.when(F.col("kind") == "image", images).otherwise(texts)).select("query_id", "partner", "kind", "linked_from")


def numbers(hits: DataFrame) -> DataFrame:
    """WIN5, VEC16: each question's distinct hits, numbered by first occurrence.

    Hits are dealt out by question once and sorted there, with no aggregate or join that would hold or sort them again beside it.
    """
    own = hits.select("query_id", "id", "part", "rank").repartition("query_id")
    again = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("part", "rank"))
    first = own.withColumn("_again", again).where("_again = 1").drop("_again")
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("part", "rank", "id"))
    return first.select("query_id", "id", number.alias("num"))


def numbered(hits: DataFrame) -> DataFrame:
    """WIN5, VEC16: hits of all parts numbered by first occurrence."""
    return hits.join(numbers(hits), ["query_id", "id"])


def picture_budget(hits: DataFrame, has_own: Column, cap: int = 4) -> DataFrame:
    """WIN12: cited pictures in citation order, a slot kept for the reader's own."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("num"))
    return hits.where("kind = 'image'").withColumn("_p", place).where(F.col("_p") <= cap - has_own.cast("int")).drop("_p")


def without_excluded(hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """JOIN12: hits of sources that the chat has not excluded; excluded has a row (query_id, asset_id) for each."""
    return hits.join(excluded, ["query_id", "asset_id"], "left_anti")


def citations(hits: DataFrame, chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """VEC15: a citation record of each hit: number, source, location, score to four places."""
    rows = resolved(hits, chunks).join(assets.select("asset_id", F.col("name").alias("live")), "asset_id", "left")
    return rows.select("query_id", "num", source_name(F.col("live"), F.col("source")).alias("source"), location(F.col("row"), F.col("seconds"), F.col("page")).alias("location"), F.bround("score", 4).alias("score"))


def refilled(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN17: citations(asset_id, chunk_order, page) of stored messages with missing pages filled in, in their order."""
    rows = messages.select("message_id", F.posexplode("citations").alias("pos", "c"))
    rows = rows.select("message_id", "pos", "c.asset_id", "c.chunk_order", F.col("c.page").alias("known"))
    full = rows.join(chunks.select("asset_id", "chunk_order", "page"), ["asset_id", "chunk_order"], "left")
    items = F.array_sort(F.collect_list(F.struct("pos", "asset_id", "chunk_order", F.coalesce("known", "page").alias("page"))))
    return full.groupBy("message_id").agg(F.transform(items, lambda x: F.struct(x["asset_id"].alias("asset_id"), x["chunk_order"].alias("chunk_order"), x["page"].alias("page"))).alias("citations"))
