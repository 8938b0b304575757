"""Links of figures and passages against all pairs; pairs stay linear however many share a page or a label."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import linking

FIG = "asset_id int, page int, chunk_order int, nearby_text string, caption string, bbox array<double>, whole_page boolean"
TXT = "asset_id int, page int, chunk_order int, content string, rects array<array<double>>"


def layout(spark, seed, figures, texts, pages, labels):
    rng = random.Random(seed)
    box = lambda: (lambda x, y: [x, y, x + 100.0, y + 30.0])(rng.choice([0.0, 300.0]), float(rng.randrange(0, 800, 10)))
    fig = [(rng.randrange(2), rng.choice([None, *range(pages)]), k, rng.choice([None, f"Figure {rng.randrange(labels)}"]), rng.choice([None, f"Table {rng.randrange(labels)}"]), rng.choice([None, box(), box()]), rng.random() < 0.2) for k in range(figures)]
    txt = [(rng.randrange(2), rng.choice([None, *range(pages)]), k, rng.choice([None, "plain", f"see Fig. {rng.randrange(labels)} and Table {rng.randrange(labels)}"]), rng.choice([None, [], [box()], [box(), box()]])) for k in range(texts)]
    return spark.createDataFrame(fig, FIG), spark.createDataFrame(txt, TXT)


def by_all_pairs(figures, texts, k):
    """The rule over all pairs, from the pair operators."""
    score = defaultdict(float)
    for r in linking.label_pairs(figures, texts).collect() + linking.page_pairs(figures, texts).collect():
        score[r.asset_id, r.image, r.text] += r.score
    out = set()
    for own, other in ((1, 2), (2, 1)):
        groups = defaultdict(list)
        for pair, s in score.items():
            groups[pair[0], pair[own]].append((-round(s, 9), pair[other], pair))
        out |= {(own, pair) for g in groups.values() for _, _, pair in sorted(g)[:k]}
    return out


@pytest.mark.parametrize("shape", [(40, 60, 4, 3), (120, 30, 1, 1)])
def test_links_equal_all_pairs(spark, shape):
    figures, texts = layout(spark, sum(shape), *shape)
    got = linking.links(figures, texts).collect()
    assert {(1, (r.asset_id, r.image, r.text)) for r in got if r.of_image} | {(2, (r.asset_id, r.image, r.text)) for r in got if r.of_text} == by_all_pairs(figures, texts, 2)


def test_pairs_are_linear_in_items(spark):
    n = 1500
    figures = spark.range(n).select(F.lit(1).alias("asset_id"), F.lit(0).alias("page"), F.col("id").cast("int").alias("chunk_order"), F.lit("Figure 1").alias("nearby_text"), F.lit("").alias("caption"), F.array(F.lit(0.0), F.col("id") * 10.0, F.lit(50.0), F.col("id") * 10.0 + 5).alias("bbox"), F.lit(False).alias("whole_page"))
    texts = spark.range(n).select(F.lit(1).alias("asset_id"), (F.col("id") % 3).cast("int").alias("page"), F.col("id").cast("int").alias("chunk_order"), F.lit("Fig. 1").alias("content"), F.array(F.array(F.lit(0.0), F.col("id") * 10.0, F.lit(50.0), F.col("id") * 10.0 + 5)).alias("rects"))
    assert 2 * n <= linking.links(figures, texts).count() <= 8 * n  # of 2,250,000 pairs with the label


def test_many_pages_are_compared_at_once(spark):
    """No page is a call of its own; in frames of any size, with many pages together or alone, the same partners are found."""
    figures, texts = layout(spark, 5, 300, 400, 40, 9)
    figures, texts = figures.union(figures.where("chunk_order % 50 = 0")), texts.union(texts.where("chunk_order % 60 = 0"))
    found = linking.links(figures, texts)
    assert {(own, (r.asset_id, r.image, r.text)) for r in found.collect() for own, best in ((1, r.of_image), (2, r.of_text)) if best} == by_all_pairs(figures, texts, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan

    rng = random.Random(3)
    box = lambda: [0.0, y := rng.randrange(900) * 1.0, 50.0, y + 20]
    rows = [dict(asset_id=1, page=p, _text=text, image=None if text else n, label=None if text else rng.choice([None, "figure:1", "table:2"]), bbox=None if text else rng.choice([None, box(), [None, *box()[1:]]]), whole_page=None if text else rng.random() < 0.2,
                 text=n if text else None, labels=rng.choice([[], ["figure:1"], ["figure:1", "table:2"]]) if text else None, rects=rng.choice([None, [], [box()], [box(), box()]]) if text else None)
            for p in range(60) for text in (False, True) for n in sorted(rng.choices(range(900), k=rng.randrange(9)))]
    names = {"asset_id": pa.int64(), "page": pa.int64(), "_text": pa.bool_(), "image": pa.int64(), "label": pa.string(), "bbox": pa.list_(pa.float64()), "whole_page": pa.bool_(), "text": pa.int64(), "labels": pa.list_(pa.string()), "rects": pa.list_(pa.list_(pa.float64()))}
    table = pa.Table.from_pylist(rows, pa.schema(names))
    calls, best = [], linking._pairs_best

    def run(frame, most):
        out = [tuple(round(x, 9) for x in r.values()) for b in linking._pages_best(2, most)(iter(table.to_batches(frame))) for r in b.to_pylist()]
        return set(out)

    linking._pairs_best = lambda *args: (calls.append(1), best(*args))[1]
    try:
        want = run(1000, 0)  # every page alone
        assert not calls and want == run(1000, 1 << 18) and 1 <= len(calls) <= 2
        assert all(run(frame, most) == want for frame in (1, 7, 100) for most in (30, 200, 1 << 18))
    finally:
        linking._pairs_best = best


def test_no_pair_is_shuffled(spark):
    """A page gets the few partners that its labels have elsewhere, and chooses there: pairs are neither dealt out nor ranked again."""
    figures, texts = layout(spark, 8, 150, 200, 5, 4)
    figures, texts = figures.union(figures.where("chunk_order % 50 = 0")), texts.union(texts.where("chunk_order % 60 = 0"))
    found = linking.links(figures, texts, 1, 3)
    rows = found.collect()
    want = {x for x in by_all_pairs(figures, texts, 1) if x[0] == 1} | {x for x in by_all_pairs(figures, texts, 3) if x[0] == 2}
    assert sorted((own, (r.asset_id, r.image, r.text)) for r in rows for own, best in ((1, r.of_image), (2, r.of_text)) if best) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[2]
    assert plan.index("MapInArrow") < plan.index("Exchange") and plan.count("Exchange hashpartitioning") == 3

    # Partners from elsewhere, before a page's items, in frames of any size; page null is none.
    items = [dict(asset_id=a, page=p, _text=text, image=None if text else n, label=None if text else "f:1", text=n if text else None, labels=["f:1", "f:2"] if text else None) for a in (1, 2) for p in (None, 0, 1) for text in (False, True) for n in range(3)]
    far = [dict(asset_id=a, page=p, label=f"f:{f}", image=None if t else 100 + f, text=200 + f if t else None, _side=t, times=3 - f) for a in (1, 2) for p in (None, 0) for t in (False, True) for f in (1, 2)]
    names = {"asset_id": pa.int64(), "page": pa.int64(), "_text": pa.bool_(), "image": pa.int64(), "label": pa.string(), "bbox": pa.list_(pa.float64()), "whole_page": pa.bool_(), "text": pa.int64(), "labels": pa.list_(pa.string()), "rects": pa.list_(pa.list_(pa.float64())), "_side": pa.bool_(), "times": pa.int64()}
    below = lambda x: (x is not None, x or 0)
    table = pa.Table.from_pylist(sorted(items + far, key=lambda r: (r["asset_id"], below(r["page"]), below(r.get("_text")))), pa.schema(names))
    for frame, most in ((100, 1 << 18), (1, 1 << 18), (7, 0)):
        got = [tuple(r.values()) for b in linking._pages_best(2, most)(iter(table.to_batches(frame))) for r in b.to_pylist()]
        one = {x[1:] for x in got if x[0] == 1}
        assert one == {x[1:] for x in got if x[0] == 2}
        assert {x for x in one if max(x[:2]) >= 200} == {(n, 201, 20.0, True, False) for n in range(3)}  # label 1 alone, twice there
        assert {x for x in one if 100 <= x[0] < 200} == {(101, n, 20.0, False, True) for n in range(3)} | {(102, n, 10.0, False, True) for n in range(3)}


def test_an_item_without_a_number_is_linked(spark):
    figures = spark.createDataFrame([(1, 0, 5, "Figure 1", None, None, False)], FIG)
    texts = spark.createDataFrame([(1, None, None, "Fig. 1", None), (1, 3, 2, "Fig. 2", None)], TXT)
    assert {(r.image, r.text, r.score, r.of_image, r.of_text) for r in linking.links(figures, texts).collect()} == {(5, None, 10.0, True, False), (5, None, 10.0, False, True)}


def test_nothing_to_link(spark):
    figures, texts = layout(spark, 1, 3, 3, 1, 1)
    assert linking.links(figures.limit(0), texts).count() == 0 and linking.links(figures, texts.limit(0)).count() == 0


def test_words_are_placed_without_a_shuffle(spark):
    texts = ["one two", "", None, " a  b ", "é 👍x " * 40, "w" * 3000]
    words = linking.split_words(spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "asset_id int, page int, text string").repartition(2))
    want = {(k, n + 1, w, at := len(" ".join(t.split(" ")[:n])) + (n > 0), at + len(w)) for k, t in enumerate(texts) if t is not None for n, w in enumerate(t.split(" "))}
    assert {(r.asset_id, r.word_no, r.word, r.start, r.stop) for r in words.collect()} == want
    from textquarry.catalog import QUERIES

    plan = QUERIES["join8_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_words_of_texts_of_any_length(spark, tmp_path):
    """Long and empty texts count as others do, in SQL too."""
    import duckdb
    import oracle

    from textquarry.catalog import ORACLES, QUERIES

    texts = ["ab é  " * 5000, "", None, "x" * 20001, " ", "one two", "y" * 399 + " " + "z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for k, text in enumerate(texts):
        start = 0
        for n, word in enumerate((text or "").split(" ")):
            for c in range(max(0, (start - 500) // 400), (start + len(word)) // 400 + 1):
                if c * 400 < len(text or "") and start < c * 400 + 500 and start + len(word) > c * 400:
                    words, places = want.get((k, c), (0, 0))
                    want[k, c] = words + 1, places + n + 1
            start += len(word) + 1
    found = QUERIES["join8_words"](spark, str(tmp_path))
    assert {(r.asset_id, r.chunk_order): (r.words, r.places) for r in found.collect()} == want and max(c for k, c in want if k == 0) == 74
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.difference(db, found, ORACLES["join8_words"]) == ""


def test_words_are_shuffled_by_the_stretch(spark):
    """Words come in a row a stretch, and meet the same passages as rows of their own; no word is shuffled by itself."""
    rng = random.Random(4)
    sign = {k: "".join(rng.choice(["a" * rng.randrange(12), "", "é👍", "w" * rng.choice([5, 4095, 9000])]) + "--" for _ in range(n)) for k, n in enumerate((0, 1, 40, 700, 3000))}
    pages = spark.createDataFrame([(k // 2, k % 2, t) for k, t in sign.items()] + [(9, 0, None), (9, None, "a--b")], "asset_id int, page int, text string").repartition(3)
    chunks = pages.where("length(text) > 0").select("asset_id", "page", F.explode(F.sequence(F.lit(0), (F.length("text") / 700).cast("int"))).alias("chunk_order"))
    chunks = chunks.select("*", (F.col("chunk_order") * 700).alias("start"), F.lit("y" * 5000).alias("content"))
    alone = linking.words_of_chunks(chunks, linking.split_words(pages, "--").drop("word"))
    packed = linking.words_of_chunks(chunks, linking.words_by_stretch(pages, "--"))
    assert sorted(packed.columns) == sorted(alone.columns) and packed.schema["word_no"].dataType == alone.schema["word_no"].dataType
    rows = lambda df: sorted(tuple(r) for r in df.select("asset_id", "page", "chunk_order", "word_no").collect())
    assert rows(packed) == rows(alone) != []
    assert linking.words_by_stretch(pages, "--").count() < linking.split_words(pages, "--").count() / 2
    from textquarry.catalog import QUERIES

    plan = QUERIES["join8_words"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode(begins") < plan.index("Join")  # only after the shuffle


def test_patterns_are_found_by_their_beginnings(spark):
    names = ["gpt-4", "gpt-4-mini", "gpt-5", "o1", "claude-3-x", "claude-[z]", "a.b", "axb", "", "line\nbreak", "gp", "solo-7", "solo-x"]
    prices = [("gpt-4", 1.0), ("gpt-*", 2.0), ("gpt-4-m*", 3.0), ("*", 0.5), ("?1", 4.0), ("claude-[0-9]-*", 5.0), ("a.?", 6.0), ("g*", 7.0), ("solo-[!0-9]", 8.0), ("line*", 9.0)]
    models = spark.createDataFrame([(n,) for n in names], "model_id string")
    found = linking.prices_for(models, spark.createDataFrame(prices, "pattern string, input double"))
    want = {"gpt-4": 1.0, "gpt-4-mini": 3.0, "gpt-5": 2.0, "o1": 4.0, "claude-3-x": 5.0, "claude-[z]": 0.5, "a.b": 6.0, "axb": 0.5, "": 0.5, "line\nbreak": 9.0, "gp": 7.0, "solo-7": 0.5, "solo-x": 8.0}
    assert {r.model_id: r.input for r in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    assert all(r.input is None for r in linking.prices_for(models, spark.createDataFrame([("none", 1.0)], "pattern string, input double")).collect())
