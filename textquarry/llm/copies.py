"""Exact deduplication: which documents have the same text, with DataFrame functions alone.

A text is cut into chunks where its own content says so: a chunk ends at the first place at or after LEAST characters
whose few neighbouring characters match CUT, or else at MOST. Such places are some hundred characters apart, well over
LEAST, so equal passages are soon cut alike wherever they stand. Every chunk gets a
128-bit identifier, the salted MD5 of its bytes. The identifiers are then verified: distinct (identifier, chunk)
pairs are formed, copies collapsing in the task that reads them, and no identifier may have two chunks. Should one
have, all are drawn anew with the next salt, so no result rests on a hash alone. Chunks are the only content that is
ever shuffled, each once a task that has it. From there on a document is its recipe, the ordered list of its chunks'
identifiers (16 bytes a chunk), and documents with equal recipes have equal texts.

Recipes are written once with a number for every row; classes are an aggregation of them that is partial before its
shuffle, and a plain join brings the classes of two and more back to their rows, so a class of any size can be split.

Defined cases: a null text is an empty one (one class); texts of any length are read whole; of equal texts the row
with the greatest doc_id stays, a null id counting as the least; of rows that tie in id and text exactly one stays;
an empty table gives no rows; extra columns are ignored, whatever their names. Texts are valid UTF-8, as Spark's strings are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.shared import fresh, stored

#: Characters of a chunk, at least (but for a text's last one) and at most.
LEAST, MOST = 128, 4096

#: Where a chunk may end: between two words, by the letters at either side.
CUT = r"[aeiou][b-m]\s(?=[a-e])"
#: The same for texts with characters beyond Latin letters: also by Cyrillic letters, and at the end of a sentence in scripts without such blanks.
WIDE_CUT = r"(?:[aeiouаеиоу][b-mб-м]\s(?=[a-eа-д])|[。！？।۔؟])"


def chunk_list(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """A text's chunks in order; together they are the text."""
    latin, wide = (F.lit(f"(?s).{{{least}}}.{{0,{most - least - 3}}}?{cut}|.{{1,{most}}}") for cut in (CUT, WIDE_CUT))
    return F.regexp_extract_all(text, F.when(text.rlike(r"[^\x00-\u024f]"), wide).otherwise(latin), F.lit(0))


def identifier(chunk: Column, salt: int) -> Column:
    """32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{salt}:"), chunk))


def recipe(text: Column, salt: int) -> Column:
    """The ordered identifiers of a text's chunks, 16 bytes each."""
    return F.unhex(F.array_join(F.transform(chunk_list(text), lambda c: identifier(c, salt)), ""))


def clashes(texts: DataFrame, salt: int) -> DataFrame:
    """Identifiers that two different chunks of texts(text) share: none, as good as always."""
    chunks = texts.select(F.explode(chunk_list(F.col("text"))).alias("chunk"))
    distinct = chunks.groupBy(identifier(F.col("chunk"), salt).alias("id"), "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


def verified_salt(texts: DataFrame, salts=range(1 << 30)) -> int:
    """The first salt under which every identifier stands for one chunk."""
    return next(salt for salt in salts if clashes(texts, salt).isEmpty())


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs(doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    salt = verified_salt(texts)
    rows = stored(
        texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", recipe(F.col("text"), salt).alias("recipe"), F.sha2("text", 256).alias("text_sha256")),
        "recipes",
    )
    last = F.max(F.struct("doc_id", (-F.col("row")).alias("back"))).alias("last")
    groups = rows.groupBy("recipe").agg(last, F.count(F.lit(1)).alias("size")).where("size > 1")
    # Written, so that the join deals out both sides itself and can split a large class.
    sized = stored(groups, "classes").select("recipe", F.col("last.doc_id").alias("keep"), (-F.col("last.back")).alias("keep_row"), "size")
    alone = F.col("size").isNull()
    return rows.join(sized, "recipe", "left").select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that tie in id and text any one."""
    digest = fresh(docs, "digest")
    stay = classes(docs).where("kept").select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("own"))
    marked = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = marked.join(stay, (F.col(f"`{digest}`") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("stays")), "left_semi")
    return joined.dropDuplicates(["doc_id", digest]).drop(digest)
