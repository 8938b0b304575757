"""Registered queries of single steps that the composite ones also use, and of injected functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import evaluation as E
from textquarry.operators import generation as M
from textquarry.operators import retrieval as R
from textquarry.operators import vectors as V
from textquarry.plans.registry import query
from textquarry.tables import table

C = F.col


@query("""SELECT l_orderkey AS query_id, l_linenumber AS num, l_partkey AS asset_id, p_name AS content FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0""")
def join1_resolve(spark, d):
    hits = table(spark, d, "lineitem").select(C("l_orderkey").alias("query_id"), C("l_linenumber").alias("num"), C("l_partkey").alias("asset_id"), F.lit(0).alias("chunk_order"))
    chunks = table(spark, d, "part").where("p_size % 2 = 0").select(C("p_partkey").alias("asset_id"), F.lit(0).alias("chunk_order"), C("p_name").alias("content"))
    return R.resolved(hits, chunks).drop("chunk_order")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'row ' || p_size WHEN p_size % 4 = 1 THEN (p_size * 100) // 60 || ':' || lpad(CAST((p_size * 100) % 60 AS VARCHAR), 2, '0') WHEN p_size % 4 = 2 THEN 'page ' || (p_size + 1) END AS location
FROM part WHERE p_size < 36""")
def join2_location(spark, d):
    part = table(spark, d, "part").where("p_size < 36")
    row, seconds, page = (F.when(C("p_size") % 4 == k, v) for k, v in ((0, C("p_size")), (1, C("p_size") * 100), (2, C("p_size"))))
    return part.select("p_partkey", R.location(row, seconds, F.when(C("p_size") % 4 != 3, C("p_size"))).alias("location"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN n_name ELSE 'unknown' END AS source FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def join3_source_name(spark, d):
    both = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("c_nationkey") == C("n_nationkey"))  # 25 rows
    live = F.when(C("c_custkey") % 3 == 0, C("c_name")).when(C("c_custkey") % 3 == 1, "")
    return both.select("c_custkey", R.source_name(live, F.when(C("c_custkey") % 3 == 1, C("n_name"))).alias("source"))


@query("""WITH f AS (SELECT l_orderkey AS query_id, l_partkey AS id, min((l_linenumber, l_suppkey)) AS f FROM lineitem GROUP BY ALL) SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS INT) AS num FROM f""")
def win5_first_occurrence(spark, d):
    hits = table(spark, d, "lineitem").select(C("l_orderkey").alias("query_id"), C("l_partkey").alias("id"), C("l_linenumber").alias("part"), C("l_suppkey").alias("rank"))
    return R.numbers(hits)


@query("""SELECT query_id, id, final, CAST(n AS INT) AS rank FROM (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS final, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice >= 50000) WHERE n <= 3""")
def win9_rerank_cut(spark, d):
    hits = table(spark, d, "orders").select(C("o_custkey").alias("query_id"), C("o_orderkey").alias("id"), F.lit(0.0).alias("score"))
    scores = table(spark, d, "orders").select(C("o_custkey").alias("query_id"), C("o_orderkey").alias("id"), C("o_totalprice").alias("score"))
    return R.reranked(hits, scores, 3, 50000.0)


@query("""SELECT event_type AS metric, '{"metric":"' || event_type || '","scored":' || count(*) || '}' AS line FROM events GROUP BY event_type""")
def snk6_report_lines(spark, d):
    means = table(spark, d, "events").groupBy(C("event_type").alias("metric")).agg(F.count("*").alias("scored"))
    lines, _ = E.report_lines(means, means)
    return lines.select(F.get_json_object("line", "$.metric").alias("metric"), "line")


@query("SELECT vec_id AS id FROM embeddings WHERE label = 2 AND vec_id % 2 = 0")
def vec13_picture_index(spark, d):
    rows = table(spark, d, "embeddings").select(C("vec_id").alias("id"), "embedding", F.when(C("label") == 2, "image").otherwise("text").alias("kind"))
    return V.picture_index(rows.drop("embedding"), rows.where("id % 2 = 0")).select("id")


@query("SELECT conv_id AS query_id, turn AS id, CASE WHEN max(turn) OVER (PARTITION BY conv_id) < 5 THEN CAST(length(text) AS DOUBLE) END AS score FROM conversations")
def udf2_reranker(spark, d):
    """A stand-in scorer that fails on long candidate lists, so that both ways are seen."""
    turns = table(spark, d, "conversations")
    first = turns.groupBy("conv_id").agg(F.max("turn").cast("string").alias("question"))
    pairs = turns.join(first, "conv_id").select(C("conv_id").alias("query_id"), C("turn").alias("id"), "question", "text")

    def score(question, texts):
        if int(question) >= 5:
            raise RuntimeError("too many")
        return [len(t) for t in texts]

    return M.reranked_by(pairs, score)


@query("""WITH b AS (SELECT conv_id, turn, text, bool_or(contains(text, 'zz')) OVER (PARTITION BY conv_id, turn // 4) AS breaks FROM conversations)
SELECT conv_id || ':' || turn AS id, CASE WHEN NOT breaks THEN NOT contains(lower(text), 'er') END AS safe FROM b""")
def udf3_judge(spark, d):
    """Verdicts on the turns themselves, four for one call; a call that fails leaves its turns undecided."""
    turns = table(spark, d, "conversations").select("conv_id", F.floor(C("turn") / 4).alias("batch"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text")

    def judge(texts):
        if any("zz" in t for t in texts):
            raise ValueError("no verdict")
        return ["unsafe" if "er" in t.lower() else "safe" for t in texts]

    return M.called(turns, ["conv_id", "batch"], judge, "text", "id").select("id", (C("answer") == "safe").alias("safe"))


@query("SELECT p_partkey AS batch_id, CAST(1 AS BIGINT) AS num, p_name AS correct, p_type AS chunk_id FROM part")
def udf7_items(spark, d):
    """Quiz items from noisy answers: a question as an option and a number out of range are dropped."""
    part = table(spark, d, "part")
    item = lambda num, wrong: F.to_json(F.struct(F.lit("Which part?").alias("question"), C("p_name").alias("correct"), F.array(*wrong).alias("wrong"), F.lit(num).alias("num")))
    a, b, c = C("p_type"), F.concat(C("p_type"), F.lit(" b")), F.concat(C("p_type"), F.lit(" c"))
    answer = F.concat(F.lit("Here: ["), item(1, (a, b, c)), F.lit(","), item(1, (a, a, c)), F.lit(","), item(9, (a, b, c)), F.lit(", {\"question\": \"cut"))
    raw = part.select(C("p_partkey").alias("batch_id"), answer.alias("answer"))
    return M.generated_items(raw, part.select(C("p_partkey").alias("batch_id"), F.lit(1).cast("bigint").alias("num"), C("p_type").alias("chunk_id"))).drop("question")


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract(text, '[\\p{L}]+') AS word FROM conversations WHERE turn % 2 = 0 AND regexp_matches(text, '[\\p{L}]'))
SELECT conv_id AS user_id, 'name' AS key, arg_max(word, turn) AS description FROM t GROUP BY conv_id""")
def udf9_facts(spark, d):
    """Every other turn gives its first word as a name between its own words; the newest stays."""
    first = F.regexp_extract("text", r"\p{L}+", 0)
    said = F.when((C("turn") % 2 == 0) & (first != ""), F.concat(F.left("text", F.lit(30)), F.lit(". Well, my Name is "), first, F.lit(". "), C("text"))).otherwise(C("text"))
    return M.extracted_facts(table(spark, d, "conversations").select(C("conv_id").alias("user_id"), "turn", said.alias("text")))


@query("""SELECT page_id, extractor, CASE WHEN extractor = 'whole' THEN length(html) WHEN page_id % 7 <> 0 THEN length(replace(html, '<', '')) END AS characters,
  CASE WHEN extractor = 'bare' AND page_id % 7 = 0 THEN 'ValueError: no text layer' END AS error FROM pages, (VALUES ('whole'), ('bare')) e(extractor)""")
def udf8_extractors(spark, d):
    """Two extractors on the same pages, one of which fails on some."""
    from textquarry.operators.evaluation import extracted

    def bare(body):
        if body.startswith("0|"):
            raise ValueError("no text layer")
        return body.split("|", 1)[1].replace("<", "")

    pages = table(spark, d, "pages").select("page_id", F.concat((C("page_id") % 7).cast("string"), F.lit("|"), "html").alias("content"))
    found = extracted(pages, {"whole": lambda body: body.split("|", 1)[1], "bare": bare}, "page_id")
    return found.select("page_id", "extractor", F.length("text").alias("characters"), "error")
