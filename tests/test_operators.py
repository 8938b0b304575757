"""Operators on small literal frames: the cases that the tables do not have."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import payload, scoring, text
from textquarry.operators import chunking, evaluation, generation, linking, logs, retrieval, vectors
from textquarry.sources import delimited, pages, sinks, tabular
from textquarry.streaming import stateful


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_normalisation_folds_forms_and_marks(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="ﷲ ﻻ‏ a \t  b ﬁ") == "الله لا a b fi"
    assert one(spark, text.strip_nulls(F.col("t")), t="a\0b") == "ab"


def test_script_profile_and_usability(spark):
    p = one(spark, text.script_profile(F.col("t")), t="مرحبا abc ٣4")
    assert (p.arabic, p.latin, p.digits, p.words) == (5, 3, 2, 3)
    u = one(spark, text.usability(text.script_profile(F.col("t"))), t="x" * 100)
    assert u.run_together and not u.usable


def test_labels_in_two_languages(spark):
    found = one(spark, text.labels_in(F.col("t")), t="see Fig. 3a, الجدول ٢ and fig 3a; Map 4")
    assert [(x.kind, x.number) for x in found] == [("figure", "3a"), ("table", "2"), ("figure", "4")]


@pytest.mark.parametrize("said, is_talk", [("Thanks a lot!", True), ("شكرًا جزيلاً", True), ("شكرًا", True), ("hi?", False), ("شكرًا لكم", False), ("", False), ("hi what is the capital", False)])
def test_small_talk(spark, said, is_talk):
    assert one(spark, text.is_small_talk(F.col("t")), t=said) is is_talk


def test_word_error_rate_sees_fragments(spark):
    assert one(spark, scoring.word_error_rate(F.col("a"), F.col("b")), a="one two three four", b="one t wo three four") == 0.5
    assert one(spark, scoring.error_rate(F.col("a"), F.col("b")), a="", b="x") == 1.0


def test_sigmoid_does_not_overflow(spark):
    assert one(spark, scoring.sigmoid(F.col("x")), x=-1000.0) == 0.0
    assert one(spark, scoring.sigmoid(F.col("x")), x=1000.0) == 1.0


def test_salvage_of_a_cut_list(spark):
    s = one(spark, payload.salvaged(F.col("t"), "q string", lambda x: x.q.isNotNull()), t='[{"q": "a"}, {"q": 1x}, {"q": "b"}, {"q": "c')
    assert [i.q for i in s["items"]] == ["a", "b"] and s.dropped == 1


def test_segments_are_lossless_and_bounded(spark):
    body = "para one.\n\nline two\nthird. Fourth sentence here " + "x" * 95 + " end"
    pieces = one(spark, chunking.segments_of(F.col("t"), 30), t=body)
    assert "".join(pieces) == body and max(map(len, pieces)) <= 30


def test_header_merges_forward_and_folio_backward():
    spans = chunking.pack_ranges([8, 990, 990, 2], [False] * 4, 1000, 0, 100)
    assert spans[0][0] == 0 and spans[0][1] >= 998 and spans[-1][1] == 1990
    assert all(b - a <= 1100 for a, b in spans)


def test_passages_overlap_and_cover(spark):
    pages_ = spark.createDataFrame([(1, "word " * 900), (2, "tiny"), (3, "")], "id int, text string")
    rows = chunking.passages(pages_, ["id"], 1000, 200).orderBy("id", "start").collect()
    first = [r for r in rows if r.id == 1]
    assert all(a.start + len(a.content) >= b.start for a, b in zip(first, first[1:])) and first[-1].start + len(first[-1].content) == 4500
    assert [r.content for r in rows if r.id == 2] == ["tiny"] and not [r for r in rows if r.id == 3]
    assert chunking.broken_passages(chunking.passages(pages_, ["id"]), pages_, ["id"]).count() == 0


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name;age\n\nمها;3\n".encode())
    (tmp_path / "b.csv").write_bytes("caf\xe9,1\n".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"x")
    rows = {(r.path[-5:], r.line): list(r.cells) for r in delimited.read_records(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == {("a.csv", 1): ["name", "age"], ("a.csv", 3): ["مها", "3"], ("b.csv", 1): ["café", "1"]}
    kinds = sorted((r.path[-5:], r.kind) for r in pages.read_sources(spark, str(tmp_path)).collect())
    assert kinds == [("a.csv", "csv"), ("b.csv", "csv"), ("c.bin", "rejected")]


def test_main_text_prefers_a_long_article(spark):
    html = f"<html><head><title>T &amp; U</title></head><body><nav>menu</nav><article>{'word ' * 60}</article><footer>f</footer></body></html>"
    got = one(spark, pages.main_text(F.col("t")), t=html)
    assert got.title == "T & U" and got.text == ("word " * 60).strip()


def test_links(spark):
    got = one(spark, pages.link_parts(F.col("u")), u="https://docs.google.com/spreadsheets/d/abc-1/edit#gid=7")
    assert (got.sheet_id, got.gid, got.video_id) == ("abc-1", "7", None)
    assert one(spark, pages.link_parts(F.col("u")), u="https://youtu.be/dQw4w9WgXcQ?t=1").video_id == "dQw4w9WgXcQ"


def test_asset_replacement_touches_no_other(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.append_chunks(spark.createDataFrame([("a", 1), ("b", 2)], "asset_id string, n int"), path)
    sinks.replace_assets(spark.createDataFrame([("a", 9)], "asset_id string, n int"), path)
    assert sorted((r.asset_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 2)]


def test_rerank_falls_back_when_no_score(spark):
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (2, 10, 0.5), (2, 12, 0.7)], "query_id int, id int, score double")
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.6), (2, 10, None), (2, 12, None)], "query_id int, id int, score double")
    got = sorted((r.query_id, r.rank, r.id) for r in retrieval.reranked(hits, scores, 5, 0.3).collect())
    assert got == [(1, 1, 11), (2, 1, 12), (2, 2, 10)]


def test_prices_exact_beats_pattern_and_longest_wins(spark):
    models = spark.createDataFrame([("gpt-4",), ("gpt-4-mini",), ("other",)], "model_id string")
    prices = spark.createDataFrame([("gpt-4", 1.0), ("gpt-*", 2.0), ("gpt-4-m*", 3.0)], "pattern string, input double")
    assert {r.model_id: r.input for r in linking.prices_for(models, prices).collect()} == {"gpt-4": 1.0, "gpt-4-mini": 3.0, "other": None}


def test_failed_call_keeps_its_rows(spark):
    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 1)], "id int, text string, g int")

    def call(texts):
        if "c" in texts:
            raise RuntimeError("no model")
        return [t.upper() for t in texts]

    got = {r.id: (r.answer, r.error) for r in generation.called(rows, ["g"], call, "text", "id").collect()}
    assert got == {1: ("A", None), 2: ("B", None), 3: (None, "RuntimeError: no model")}


def streamed(spark, tmp_path, rows, schema, build, mode="append"):
    source, out = tmp_path / "in", []
    source.mkdir()
    for k, part in enumerate(rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in part))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in the order of their times
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    return out


def test_cut_passage():
    assert stateful.cut_passage("One. Two", 3) == ("One.", " Two")
    assert stateful.cut_passage("no end here", 30) == ("", "no end here")
    assert stateful.cut_passage("tail", 30, True) == ("tail", "")


def test_stream_of_deltas_becomes_ordered_passages(spark, tmp_path):
    event = lambda seq, kind, t: {"answer_id": "x", "seq": seq, "type": kind, "text": t}
    rows = [[event(1, "delta", "two. Thr"), event(0, "delta", "One ")], [event(3, "done", ""), event(2, "delta", "ee")]]
    got = streamed(spark, tmp_path, rows, "answer_id string, seq long, type string, text string", lambda s: stateful.passages_of(s, 4))
    assert [r.passage for r in sorted(got, key=lambda r: r.passage_no)] == ["One two.", " Three"]


def test_equal_calls_are_suppressed_across_batches(spark, tmp_path):
    row = lambda ts, f: {"ts": f"2024-01-01T00:{ts}:00Z", "fingerprint": f}
    got = streamed(spark, tmp_path, [[row("01", "a"), row("02", "a")], [row("03", "b"), row("04", "a")], [row("45", "c")], [row("46", "c")]], "ts timestamp, fingerprint string", stateful.suppressed_stream)
    assert sorted(r.fingerprint for r in got) == ["a", "b", "c"]


def test_rolling_windows_close_behind_the_watermark(spark, tmp_path):
    event = lambda minute, v: {"ts": f"2024-01-01T00:{minute:02}:00Z", "event_type": "k", "value": v}
    got = streamed(spark, tmp_path, [[event(0, 1.0), event(1, 2.0)], [event(40, 5.0)], [event(59, 7.0)]], "ts timestamp, event_type string, value double", lambda s: stateful.rolling_stream(s, "5 minutes", "5 minutes"))
    rows = spark.createDataFrame([(e["ts"], "k", e["value"]) for e in (event(0, 1.0), event(1, 2.0), event(40, 5.0))], "ts string, event_type string, value double")
    want = logs.rolling(rows.withColumn("ts", F.col("ts").cast("timestamp")), "5 minutes", "5 minutes").collect()
    assert len(want) == 2 and sorted(map(str, got)) == sorted(map(str, want))


def test_new_files_become_passages_with_vectors(spark, tmp_path):
    rows = [[{"path": "a", "text": "word " * 500}], [{"path": "b", "text": ""}, {"path": "c", "text": "tiny"}]]
    got = streamed(spark, tmp_path, rows, "path string, text string", stateful.ingested)
    assert {r.path for r in got} == {"a", "c"} and all(len(r.embedding) == 64 for r in got)
    table = stateful.ingested(spark.createDataFrame([("a", "word " * 500), ("c", "tiny")], "path string, text string")).collect()
    assert sorted((r.path, r.start, r.content) for r in got) == sorted((r.path, r.start, r.content) for r in table)


def test_reindexing_replaces_one_collection(spark, tmp_path):
    path, rows = str(tmp_path / "index"), lambda t: spark.createDataFrame([(k, f"{t} {k}") for k in range(5)], "id long, content string")
    vectors.reindexed(rows("one"), "x", path)
    vectors.reindexed(rows("two"), "y", path)
    before = {r.id: r.embedding for r in spark.read.parquet(path).where("collection = 'y'").collect()}
    vectors.reindexed(rows("three").where("id < 3"), "x", path, 32)
    got = spark.read.parquet(path)
    assert {r.id: len(r.embedding) for r in got.where("collection = 'x'").collect()} == {0: 32, 1: 32, 2: 32}
    assert {r.id: r.embedding for r in got.where("collection = 'y'").collect()} == before


def test_extractors_are_compared_on_the_same_pages(spark):
    pages_ = spark.createDataFrame([(1, "a b"), (2, "x"), (3, "boom")], "page int, content string")

    def fragile(body):
        if body == "boom":
            raise RuntimeError("unreadable")
        return body.upper()

    got = {(r.page, r.extractor): (r.text, r.error) for r in evaluation.extracted(pages_, {"plain": str, "fragile": fragile}).collect()}
    assert got == {(1, "plain"): ("a b", None), (2, "plain"): ("x", None), (3, "plain"): ("boom", None), (1, "fragile"): ("A B", None), (2, "fragile"): ("X", None), (3, "fragile"): (None, "RuntimeError: unreadable")}


def test_records_with_line_breaks_and_many_cells(spark):
    wide = ",".join(f"c{k}" for k in range(700))
    rows = [(1, 'a,b\n"one\ntwo, ""three""",x\n\n , \nlast,,,\n'), (2, wide), (3, ""), (4, None), (5, "a;b\r\n\"p\r\nq\";r\r\n")]
    got = {(r.id, r.line): (r.delimiter, list(r.cells)) for r in tabular.records(spark.createDataFrame(rows, "id int, text string"), "id").collect()}
    assert got == {(1, 1): (",", ["a", "b"]), (1, 2): (",", ['one\ntwo, "three"', "x"]), (1, 6): (",", ["last"]), (2, 1): (",", wide.split(",")), (5, 1): (";", ["a", "b"]), (5, 2): (";", ["p\r\nq", "r"])}


def test_best_of_many_equals_sorting():
    rng = np.random.default_rng(1)
    kept_s, kept_i = np.full((7, 5), -np.inf), np.full((7, 5), np.iinfo(np.int64).max)
    scores, ids = rng.integers(0, 30, (7, 400)).astype(float), rng.permutation(400)
    scores[2], scores[3, 50:] = np.nan, -np.inf
    for at in range(0, 400, 64):
        vectors.keep_best(kept_s, kept_i, scores[:, at : at + 64], ids[at : at + 64])
    for s, i, row in zip(kept_s, kept_i, scores):
        want = sorted((-v, int(k)) for v, k in zip(row, ids) if np.isfinite(v))[:5]
        assert [(-a, int(b)) for a, b in zip(s, i) if np.isfinite(a)] == want


def test_ranges_meet_once_across_stretches(spark):
    words = spark.createDataFrame([(1, 0, 4090 + 3 * k, "abcdefghij", k) for k in range(8)], "asset_id int, page int, start int, word string, no int")
    chunks = spark.createDataFrame([(1, 0, 0, 4000, "z" * 9000), (1, 0, 1, 0, "z" * 4000), (1, 0, 2, 4097, "z")], "asset_id int, page int, chunk_order int, start int, content string")
    got = sorted((r.chunk_order, r.no) for r in linking.words_of_chunks(chunks, words).collect())
    assert got == [(0, k) for k in range(8)] + [(2, k) for k in range(3)]


def test_prices_keep_repeated_models(spark):
    models = spark.createDataFrame([("m", 1), ("m", 2), ("n", 3)], "model_id string, use int")
    prices = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("*", 2.0)], "pattern string, input double")
    assert sorted((r.use, r.input) for r in linking.prices_for(models, prices).collect()) == [(1, 1.0), (2, 1.0), (3, 2.0)]


def test_usability_counts_a_text_once_and_only_what_is_asked_for(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "a b c\n" * 30), (3, "x" * 100)], "k int, text string")
    found = text.with_usability(df).select("k", "space_ratio", "fragmented", "run_together", "usable")
    assert [tuple(r) for r in found.orderBy("k").collect()] == [(0, 0.0, False, False, True), (1, 0.0, False, False, True), (2, 0.5, True, False, False), (3, 0.0, False, True, False)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_numbers_and_rescored_need_no_join(spark):
    """F13 to F15: hits are dealt out by question once, and no join or aggregate holds them beside the sorts."""
    rows = [(q, part, n, (7 * n + part) % 5) for q in range(4) for part in range(3) for n in range(6)]
    hits = spark.createDataFrame(rows, "query_id int, part int, rank int, id int")
    got = {(r.query_id, r.id): r.num for r in retrieval.numbers(hits).collect()}
    want = {(q, i): k + 1 for q in range(4) for k, i in enumerate(dict.fromkeys(i for p, r, i in sorted((p, r, i) for own, p, r, i in rows if own == q)))}
    assert got == want and {(r.query_id, r.part, r["rank"], r.id): r.num for r in retrieval.numbered(hits).collect()} == {(q, p, r, i): want[q, i] for q, p, r, i in rows}
    from textquarry.catalog import QUERIES

    for name, most in (("vec10_rerank", 2), ("vec16_numbering", 1), ("win5_first_occurrence", 1)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange ") == most, plan
    scored = spark.createDataFrame([(1, 1, 0.9, None), (1, 2, 0.8, 0.7), (1, 3, 0.7, 0.1), (2, 4, 0.1, None), (2, 5, 0.2, None)], "query_id int, id int, score double, again double")
    assert [(r.query_id, r.id, r["rank"]) for r in retrieval.rescored(scored, 2, 0.3).orderBy("query_id", "rank").collect()] == [(1, 2, 1), (2, 5, 1), (2, 4, 2)]
