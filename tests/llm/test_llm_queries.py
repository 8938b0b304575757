"""Registered queries against their SQL twins, and the pipeline end to end."""

import oracle
import pytest

import corpus_pipeline
from textquarry.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.difference(oracle.connect(sf_dir), queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_covers_its_table(spark, sf_dir, name):
    table = {"op2_nearest_vectors": None, "op3_warc": "pages"}.get(name, "documents")
    n = queries.QUERIES[name](spark, sf_dir).count()
    assert n == (spark.read.parquet(f"{sf_dir}/{table}.parquet").count() if table else 500)


def test_pipeline(spark, sf_dir):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "secret_scan", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0.7 * docs.count() < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()


def test_pipeline_on_nothing_and_on_odd_rows(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, hit string, shape string, n_tokens string"
    words = "the house and the river are under the old bridge of our town ".split()
    texts = [" ".join(words[k % 13 :] + words[: k % 13]) * (1 + k % 3) for k in range(40)]
    odd = [(None, None), (None, ""), (None, texts[0]), (50, texts[0]), (50, texts[0]), (51, None), (52, ""), (53, texts[1] * 2000)]
    rows = [(k, t, "en", "s", len(t or ""), "i", "h", "s", "n") for k, t in [*enumerate(texts), *odd]]
    for name, own in (("none", []), ("odd", rows)):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (None, "a b"), (2, "a question that no document has at all")], "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert got and len({r.doc_id for r in got}) == len(got) and {r.doc_id for r in got} <= set(range(54)) and all(r.n_tokens > 2 for r in got)
