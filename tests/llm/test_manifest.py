"""The Merkle manifest against a plain recomputation: places, proofs, tampering, trees of many sizes, nulls, ties, repeats."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from textquarry.llm import manifest, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string, part string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree_of(leaves):
    """The root, and of each leaf its siblings, a list a level of (those before, those after)."""
    level, paths, own = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(own):
            base = at // 8 * 8
            paths[k].append((level[base:at], level[at + 1 : base + 8]))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        own = [at // 8 for at in own]
    return level[0], paths


def expected(rows):
    """Rows as dicts; a Counter, as equal rows are interchangeable."""
    langs = defaultdict(list)
    for r in rows:
        langs[r["lang"]].append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        own = sorted(langs[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[name] = (own, *tree_of([leaf_of(r, r["text"]) for r in own]))
    root, upper = tree_of([trees[name][1] for name in names])
    out = Counter()
    for name, above in zip(names, upper):
        own, subroot, paths = trees[name]
        for r, path in zip(own, paths):
            text, whole = r["text"], path + above
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(r, text)
            for before, after in whole:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join("".join(before + after) for before, after in whole))
            out[r["doc_id"], leaf_of(r, r["text"]), subroot, root, proof, node, node == root] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


def rows_of(n, lang, start=0):
    return [{"doc_id": start + 7 * k, "text": f"Text {k} Of É", "lang": lang, "source": None if k % 5 == 0 else f"s{k % 3}", "n_chars": None if k % 4 == 0 else k} for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", "y", "z") for r in rows], DOCS)


def test_query_equals_brute_force_on_the_table(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = got(queries.op11_merkle_manifest(spark, sf_dir))
    assert out == expected(rows)
    assert {v for *_, v in out} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [9], [64, 1], [130, 513, 1, 3, 2, 1, 1, 1, 1, 9]])
def test_trees_of_many_sizes(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in rows_of(n, f"l{k}", 1000 * k)]
    assert got(manifest.proven(frame(spark, rows))) == expected(rows)


def test_small_partitions_meet_in_the_middle_of_runs(spark, monkeypatch):
    rows = rows_of(600, "en") + rows_of(37, None)
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(manifest.proven(frame(spark, rows).repartition(5))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    base = {"doc_id": 1, "text": "A", "lang": "en", "source": "s", "n_chars": 1}
    rows = [base, base, base, {**base, "text": "B"}, {**base, "doc_id": None}, {**base, "doc_id": None, "text": None}, dict.fromkeys(base), dict.fromkeys(base), {**base, "lang": "", "text": ""}, {**base, "lang": "é", "n_chars": -5}]
    rows += [{**base, "doc_id": -3, "text": "X" * 200_000}, {**base, "doc_id": 9, "lang": "Z", "source": "-"}, {**base, "doc_id": 9, "lang": "\U0001f600", "source": "1:a"}]
    assert got(manifest.proven(frame(spark, rows))) == expected(rows)
    assert manifest.proven(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 5, 8, 9, 64, 65, 700])
def test_what_is_fetched_is_enough_and_no_more(n):
    digests = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(n)]
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest_of(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    for first, end in [(0, n), (0, 1), (n - 1, n), (n // 3, n // 3 + (n + 1) // 2), (n // 2, n // 2 + 1)]:
        need = manifest.missing(first, end, n)
        derived = set()
        low, high = first, end
        for level in range(len(levels) - 1):
            derived |= {(level, k) for k in range(low, high)}
            low, high = low // 8, -(-high // 8)
        assert not derived & set(need) and len(set(need)) == len(need)
        proofs = manifest.Proofs(first, digests[first:end], n, {x: levels[x[0]][x[1]] for x in need})
        assert proofs.root.decode() == levels[-1][0].hex() == proofs.fold(first, digests[first].hex().encode()).decode()
        assert proofs.fold(end - 1, b"0" * 64).decode() != levels[-1][0].hex()


def test_published_nodes_cover_what_others_need():
    n = 700
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    bounds = [0, 3, 64, 65, 300, 301, 512, 699, n]
    given = {(level, k): d for a, b in zip(bounds, bounds[1:]) for level, k, d in manifest.published(a, digests[a:b], n)}
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([manifest.digest_of(levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    for level in range(len(levels) - 1):  # the nodes that cross bounds
        runs = {k // 8 for (l, k) in given if l == level}
        for run in runs:
            members = [given.get((level, k)) for k in range(8 * run, min(8 * run + 8, len(levels[level])))]
            assert all(members), (level, run)
            given[level + 1, run] = manifest.digest_of(members)
    assert given[len(levels) - 1, 0] == levels[-1][0]
    for a, b in zip(bounds, bounds[1:]):
        assert all(given[x] == levels[x[0]][x[1]] for x in manifest.missing(a, b, n))
