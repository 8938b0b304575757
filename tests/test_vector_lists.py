"""The inverted-file store against the exact search: recall, pruning, split lists, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import vector_lists as I
from textquarry.operators import vectors as V

N, LISTS = 100_000, 64


def numbered(x, name="id"):
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))
    return pa.table({name: pa.array(np.arange(len(x))), "embedding": lists})


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    heads = rng.normal(size=(200, 24))
    share = rng.dirichlet(np.full(200, 0.3))  # clusters of very different sizes
    x = heads[rng.choice(200, N, p=share)] + 0.35 * rng.normal(size=(N, 24))
    path = str(tmp_path_factory.mktemp("vectors") / "raw")
    spark.createDataFrame(numbered(x)).repartition(8).write.parquet(path)
    rows = spark.read.parquet(path)
    asked = spark.createDataFrame(numbered(x[:120] + 0.1 * rng.normal(size=(120, 24)), "query_id"))
    store = str(tmp_path_factory.mktemp("vectors") / "store")
    I.write_lists(rows, I.kmeans_centres(rows, LISTS, sample_rows=20_000), store)
    return rows, asked, store, V.knn(asked, rows, 10).cache()


def test_recall_grows_with_probes_and_reads_fall(spark, table):
    rows, asked, store, exact = table
    assert I.stored_vectors(spark, store).count() == N and len(I.read_centres(spark, store)) == LISTS
    found = {p: I.recall(I.search(asked, store, 10, p), exact) for p in (1, 8, LISTS)}
    assert found[LISTS] == 1.0 and found[8] >= 0.9 and found[1] <= found[8]
    one = asked.where("query_id = 0")
    lists = I.with_lists(one, I.read_centres(spark, store), 8).first().lists
    few = I.stored_vectors(spark, store, lists)
    assert "PartitionFilters: [isnotnull(list_id" in (plan := few._jdf.queryExecution().toString()) or "list_id" in plan.split("PartitionFilters:")[1].split("]")[0]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(few) <= 8 + 2 < files(I.stored_vectors(spark, store))


def test_what_is_shuffled_is_bounded_by_tasks(spark, table):
    rows, asked, *_ = table
    many = rows.repartition(200)
    assert V.grouped_tasks(many).rdd.getNumPartitions() == V.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    got = V.knn(asked, many, 10)
    assert {(r.query_id, r.id, r.rank) for r in got.collect()} == {(r.query_id, r.id, r.rank) for r in table[3].collect()}


def test_long_lists_are_split(spark, table, tmp_path, monkeypatch):
    rows = table[0].where("id < 5000")
    monkeypatch.setattr(I, "FILE_ROWS", 500)
    I.write_lists(rows, np.stack([np.zeros(24), np.full(24, 1e3)]), str(tmp_path / "s"))
    sizes = [r["count"] for r in I.stored_vectors(spark, str(tmp_path / "s")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 500


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclid"])
def test_all_lists_probed_is_exact(spark, table, tmp_path, metric, monkeypatch):
    monkeypatch.setattr(I, "QUESTION_BLOCK", 50)  # several blocks of questions
    rows, asked = table[0].where("id < 3000"), table[1]
    I.write_lists(rows, I.sampled_centres(rows, F.col("id") % 200 == 3), str(tmp_path / "s"))
    want = {(r.query_id, r.rank, r.id) for r in V.knn(asked, rows, 7, metric).collect()}
    assert {(r.query_id, r.rank, r.id) for r in I.search(asked, str(tmp_path / "s"), 7, 15, metric).collect()} == want


def test_odd_rows(spark, tmp_path):
    schema = "id bigint, embedding array<float>, source int"
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 2), (3, None, 1), (4, [1.0], 1), (None, [1.0, 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.0], 2), (7, [0.0, 0.0], 1)]
    vectors, path = spark.createDataFrame(rows, schema), str(tmp_path / "s")
    I.write_lists(vectors, np.eye(2), path)
    asked = spark.createDataFrame([(10, [1.0, 0.1]), (11, None), (12, [1.0, 2.0, 3.0])], "query_id bigint, embedding array<double>")
    got = I.search(asked, path, 5, 2).collect()
    assert [(r.query_id, r.id) for r in sorted(got, key=lambda r: r.rank)] == [(10, 1), (10, 6), (10, 2)]
    assert [r.id for r in I.search(asked, path, 5, 2, sources=[2]).orderBy("rank").collect()] == [6, 2]
    assert I.search(asked, path, 5, 2, sources=[]).count() == 0 and I.search(asked.limit(0), path, 5, 2).count() == 0


def test_too_many_centres_are_refused(spark, monkeypatch):
    monkeypatch.setattr(I, "CENTRE_BYTES", 10)
    with pytest.raises(ValueError, match="too many"):
        I.with_lists(spark.createDataFrame([(1, [1.0, 2.0])], "id int, embedding array<double>"), np.eye(2), 1)


def test_nearest_centres_are_exact_and_hold_a_bounded_tile():
    import tracemalloc

    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(400, 8)), rng.normal(size=(3000, 8))
    centres[1500:] = centres[:1500]  # copies: the earlier one is nearer
    got = I.nearest_centres(np.concatenate([x, centres[:50]]), centres, 4)
    for row, own in zip(got, [*x, *centres[:50]]):
        assert row.tolist() == sorted(range(3000), key=lambda c: (((own - centres[c]) ** 2).sum(), c))[:4]
    assert I.nearest_centres(np.full((1, 8), np.nan), centres, 2).tolist() == [[0, 1]]
    assert I.first_copies(np.repeat(centres[:3], 5, axis=0), 2).tolist() == [0, 1, 5, 6, 10, 11]
    tracemalloc.start()
    I.nearest_centres(rng.normal(size=(3000, 8)), rng.normal(size=(20_000, 8)), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20  # all distances at once are 480 MB
