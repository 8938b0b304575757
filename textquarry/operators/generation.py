"""Glue around injected models: grouping for calls, checked results, fallbacks, re-attachment. No model is built here."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def called(rows: DataFrame, keys: list[str], call: Callable[[list[str]], list[str]], text: str, id_column: str) -> DataFrame:
    """UDF3-UDF7: one call a group of rows; a call that fails or answers a wrong number leaves a null answer and its error."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            answers, error = call(frame[text].tolist()), None
            if len(answers) != len(frame):
                raise ValueError(f"{len(answers)} answers to {len(frame)} texts")
        except Exception as e:  # the row carries the failure, the job goes on
            answers, error = [None] * len(frame), f"{type(e).__name__}: {e}"
        return pd.DataFrame({id_column: frame[id_column], "answer": answers, "error": error})

    kind = dict(rows.dtypes)[id_column]
    return rows.groupBy(*keys).applyInPandas(run, f"{id_column} {kind}, answer string, error string")


def corrected(pages: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """UDF4: the answer where its length is in the band, else the original; and the scale of places."""
    from textquarry.functions.text import accepted

    both = pages.join(answers.select(key, "answer"), key, "left").withColumn("_a", accepted(F.col("text"), F.col("answer")))
    return both.select(key, F.when(F.coalesce("_a.accepted", F.lit(False)), F.col("answer")).otherwise(F.col("text")).alias("text"), F.coalesce("_a.scale", F.lit(1.0)).alias("scale"))


def caption_or(caption: Column, nearby: Column, label: Column) -> Column:
    """UDF5: the model's caption, else the printed line, else a place-holder."""
    from textquarry.operators.chunking import image_content

    return image_content(F.coalesce(F.nullif(F.trim(caption), F.lit("")), nearby), label)


def attached(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """JOIN18: generated items with the passage that their batch-local number names; others are dropped."""
    return items.join(chunks.select("batch_id", "num", "chunk_id"), ["batch_id", "num"])


def verdicts_for(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """JOIN19: the first verdict of each place; none is undecided, places beyond the batch are ignored."""
    first = F.row_number().over(Window.partitionBy("batch_id", "idx").orderBy("seq"))
    one = verdicts.withColumn("_n", first).where("_n = 1").select("batch_id", "idx", "safe", "category")
    return items.join(one, ["batch_id", "idx"], "left").withColumn("decided", F.col("safe").isNotNull())


def released(passages: DataFrame) -> DataFrame:
    """STR3: passages before the first unsafe one of an answer; that one's place gets the refusal."""
    unsafe = F.min(F.when(~F.col("safe"), F.col("seq"))).over(Window.partitionBy("answer_id"))
    rows = passages.withColumn("_u", unsafe)
    return rows.where(F.col("_u").isNull() | (F.col("seq") <= F.col("_u"))).select("answer_id", "seq", F.when(F.col("seq") == F.col("_u"), "refusal").otherwise("delta").alias("type"))


def is_open(safe: Column, fail_open: bool) -> Column:
    """STR4: an undecided verdict passes or not, by the mode."""
    return F.coalesce(safe, F.lit(fail_open))


def branched(members: DataFrame, items: DataFrame) -> DataFrame:
    """WIN8: the first branch that claims an item has it, the rest are 'other'; items in branch order."""
    first = F.row_number().over(Window.partitionBy("map_id", "item").orderBy("branch_rank"))
    claim = members.withColumn("_n", first).where("_n = 1").select("map_id", "item", "branch", "branch_rank")
    both = items.join(claim, ["map_id", "item"], "left")
    return both.select("map_id", "item", F.coalesce("branch", F.lit("other")).alias("branch"), F.row_number().over(Window.partitionBy("map_id").orderBy(F.coalesce("branch_rank", F.lit(1 << 30)), "item")).alias("place"))


def reranked_by(pairs: DataFrame, score: Callable[[str, list[str]], list[float]]) -> DataFrame:
    """UDF2: one call a question with its candidate texts; a failed call leaves its scores null. Candidates are few by top-k."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            values = [float(x) for x in score(frame["question"].iloc[0], frame["text"].tolist())]
            if len(values) != len(frame):
                raise ValueError("wrong number of scores")
        except Exception:  # the question keeps its vector order
            values = [None] * len(frame)
        return pd.DataFrame({"query_id": frame["query_id"], "id": frame["id"], "score": pd.array(values, dtype="Float64")})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def generated_items(raw: DataFrame, chunks: DataFrame, per_batch: int = 3) -> DataFrame:
    """UDF7, WIN7, JOIN18: a batch's raw answer as checked quiz items, at most so many, each with its passage."""
    from textquarry.functions.payload import salvaged
    from textquarry.functions.text import valid_quiz

    item = "question string, correct string, wrong array<string>, num bigint"
    good = raw.select("batch_id", F.posexplode(salvaged(F.col("answer"), item, lambda x: F.coalesce(valid_quiz(x.question, x.correct, x.wrong), F.lit(False)))["items"]).alias("pos", "x"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("pos"))
    kept = good.withColumn("_n", place).where(F.col("_n") <= per_batch).select("batch_id", "x.num", "x.question", "x.correct")
    return attached(kept, chunks)


def extracted_facts(messages: DataFrame, pattern: str = r"(?i)\bmy (\w+) is ([^.!?\n]+)") -> DataFrame:
    """UDF9: (user, key, description) facts of messages, the newest of each key; the pattern is a stand-in for a model."""
    keys, values = F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2)
    rows = messages.select("user_id", "turn", F.explode(F.arrays_zip(keys.alias("key"), values.alias("description"))).alias("f"))
    return rows.groupBy("user_id", F.lower("f.key").alias("key")).agg(F.max_by("f.description", "turn").alias("description"))
