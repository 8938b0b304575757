"""Delimited files in many blocks against Python's reader over whole files: quotes, line breaks, encodings, odd files."""

import csv
import hashlib
import io
import random

import pytest

from textquarry.sources import delimited


def made(seed, rows):
    rng = random.Random(seed)
    d = rng.choice([",", ";", "\t", "|"])
    cell = lambda: rng.choice(["", "plain", " padded ", "é ü", '5" pipe', 'a"b"c', f"{rng.random()}", '"quoted"', f'"with {d} sign"', '"two\nlines"', '"a ""doubled"" one"', '"many\n\nlines, ; | of\r\ntext"', '""', '"closed"then more'])
    end = rng.choice(["\n", "\r\n"])
    return d.join(["first", "second", "third"]) + end + "".join(d.join(cell() for _ in range(rng.randrange(1, 5))) + end for _ in range(rows)), d


def whole(text, d):
    reader, begins, out = csv.reader(io.StringIO(text, newline=""), delimiter=d), 1, []
    for cells in reader:
        cells = [c.strip(" ") for c in cells]
        while cells and not cells[-1]:
            cells.pop()
        if any(c.strip() for c in cells):
            out.append((d, begins, cells))
        begins = reader.line_num + 1
    return out


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_blocks_of_any_size_give_the_records_of_whole_files(spark, tmp_path, size):
    want = {}
    for k in range(6):
        text, d = made(k, 120)
        kind = "latin-1" if k == 4 else "utf-8-sig" if k == 3 else "utf-8"
        (tmp_path / f"f{k}.csv").write_bytes(text.encode(kind))
        want[f"f{k}.csv"] = whole(text, d)
    odd = {"unclosed.csv": 'a,b\n1,"never closed\n2,3\n4,5\n', "blank.csv": "\n \n\n", "empty.csv": "", "one.csv": "only", "lone.csv": '"x",y', "wide.csv": "a,b\n" + '"' + "line\n" * 300 + '",end\nlast,1\n'}
    for name, text in odd.items():
        (tmp_path / name).write_text(text, newline="")
        want[name] = whole(text.rstrip("\n") if name == "unclosed.csv" else text, ",")  # the last line's end is no part of an open cell
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        rows = delimited.read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in rows:
        got.setdefault(r.path.rpartition("/")[2], []).append((r.delimiter, r.line, list(r.cells)))
    assert {k: sorted(v, key=lambda x: x[1]) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("line, inside, want", [("a,b", False, False), ("a,b", True, True), ('a,"b', False, True), ('b",c', True, False), ('b"",c', True, True), ('a"b', False, False), ('"a"b"c,"d', False, True), ('x","y', True, True), ('"', True, False), ('""', False, False), ('",""', True, False)])
def test_what_a_line_does_to_the_bit(line, inside, want):
    assert delimited.after(line, ",", inside) is want


def test_texts_on_a_files_first_lines_do_not_tell_its_delimiter(spark, tmp_path):
    from textquarry.plans.source_queries import src2_files

    texts = {1: "a, b, c, d, e", 2: "one | two | three | four\n, five", 3: 'said "so; so", twice', 4: "tab\tand\ttab\t\tagain\t"}
    for k, text in texts.items():  # each the first of a file
        spark.createDataFrame([(k, text)], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_cells, r.text_sha256) for r in src2_files(spark, str(tmp_path)).collect()}
    assert got == {k: (3, hashlib.sha256(text.strip(" ").encode()).hexdigest()) for k, text in texts.items()}
