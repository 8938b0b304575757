"""The registered queries of this subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import copies, decontaminate, idstore, jaccard, language, licences, manifest, neighbours, periods, pieces, secrets, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_bytes(name: str) -> bytes:
    with open(tokenizer_file(name), "rb") as file:
        return file.read()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.payload_summary(warc.read_chunks(spark, archives))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(_table(spark, sf_dir, "documents"), tokenizer_bytes("piece_bpe_32k.model"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"),
    )


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idstore.write_store(_table(spark, sf_dir, "documents"), tokenizer_bytes("word_bpe_49k.json").decode())
    return idstore.read_digests(spark, path)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licences_in(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fitted(docs, _table(spark, sf_dir, "labels")))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predictions(docs, language.fitted(docs))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found_secrets(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proven(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return periods.run_summaries(docs, planted=periods.planted_runs(F.col("doc_id"), F.col("text")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.classes(_table(spark, sf_dir, "documents"))


_OPERATORS = (
    op1_decontamination, op2_nearest_vectors, op3_warc, op4_sentencepiece, op5_id_store, op6_licence_scan, op7_toxicity, op8_ngram_jaccard,
    op9_language_id, op10_secret_scan, op11_merkle_manifest, op12_periodic_runs, op13_exact_dedup,
)
QUERIES = {q.__name__: q for q in _OPERATORS}

#: Words as the operators see them: runs of letters, digits and underscores of the lower-case text.
_SHINGLES = """
  SELECT DISTINCT {key} AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
  FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table})
"""

_NOTICES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licences.NOTICES.items()))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: A tree's nodes by level, each node's siblings, and the way up from each of its leaves with the digest that it arrives at.
_TREE = """
  {p}nodes AS (
    SELECT tree, 0 AS level, place, n, digest FROM {p}leaves
    UNION ALL
    SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY place)) FROM {p}nodes WHERE n > 1 GROUP BY tree, level, n, place // 8),
  {p}beside AS (
    SELECT tree, level, place, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
           coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM {p}nodes WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, place // 8 ORDER BY place)),
  {p}ways AS (
    SELECT k, tree, 0 AS level, place, start AS node, proof FROM {p}starts
    UNION ALL
    SELECT k, w.tree, w.level + 1, w.place // 8, sha256(before || node || after), proof || before || after
    FROM {p}ways w JOIN {p}beside b ON b.tree = w.tree AND b.level = w.level AND b.place = w.place),
  {p}ends AS (SELECT k, arg_max(node, level) AS node, arg_max(proof, level) AS proof FROM {p}ways GROUP BY k)"""

_MANIFEST = f"""
WITH RECURSIVE
  crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
  rows AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('text')} AS leaf,
           {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lowered,
           xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) AS crc
    FROM documents, crcs),
  placed AS (SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM rows),
  leaves AS (SELECT tree, place, n, leaf AS digest FROM placed),
  starts AS (SELECT k, tree, place, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS start, '' AS proof FROM placed),
  {_TREE.format(p='')},
  subroots AS (SELECT tree, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree),
  top_leaves AS (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(s.tree)) - 1 AS place, count(*) OVER () AS n, subroot AS digest, s.tree AS name FROM subroots s),
  top_starts AS (SELECT e.k, 0 AS tree, t.place, e.node AS start, e.proof FROM ends e JOIN placed p USING (k) JOIN top_leaves t ON t.name = p.tree),
  {_TREE.format(p='top_')},
  root AS (SELECT arg_max(digest, level) AS root FROM top_nodes)
SELECT doc_id, leaf, subroot, root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = root AS verified
FROM placed p JOIN subroots USING (tree) JOIN top_ends e USING (k), root
"""

ORACLES = {
    "op11_merkle_manifest": _MANIFEST,
    "op6_licence_scan": f"""
WITH notices(item_id, text) AS (VALUES {_NOTICES}),
     want AS ({_SHINGLES.format(key='item_id', table='notices')}),
     have AS ({_SHINGLES.format(key='doc_id', table='documents')}),
     sizes AS (SELECT k, CAST(count(*) AS INT) AS n FROM want GROUP BY k)
SELECT have.k AS doc_id, want.k AS licence, CAST(count(*) AS INT) AS shared_shingles, any_value(n) AS template_shingles,
       count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM want JOIN have USING (s) JOIN sizes ON sizes.k = want.k
GROUP BY have.k, want.k
HAVING count(*) >= 0.8 * any_value(n)
""",
    "op1_decontamination": f"""
WITH want AS ({_SHINGLES.format(key='item_id', table='benchmark')}),
     have AS ({_SHINGLES.format(key='doc_id', table='documents')}),
     sizes AS (SELECT k, CAST(count(*) AS INT) AS n FROM want GROUP BY k)
SELECT have.k AS doc_id, want.k AS item_id, any_value(n) AS item_shingles, CAST(count(*) AS INT) AS shared_shingles,
       count(*) / CAST(any_value(n) AS DOUBLE) AS containment
FROM want JOIN have USING (s) JOIN sizes ON sizes.k = want.k
GROUP BY have.k, want.k
HAVING count(*) >= 0.8 * any_value(n) - 1e-9
""",
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
