"""Registered queries over sources, sinks and passages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.operators import chunking as K
from textquarry.plans.registry import query
from textquarry.sources import buckets as H
from textquarry.sources import delimited as D
from textquarry.sources import pages as G
from textquarry.sources import sinks as N
from textquarry.sources import tabular as B
from textquarry.tables import table
from textquarry.workspace import shared_path

C = F.col


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ';' WHEN doc_id % 3 = 1 THEN ',' ELSE '|' END AS delimiter FROM documents""")
def src2_delimiter(spark, d):
    sign = F.when(C("doc_id") % 3 == 0, ";").when(C("doc_id") % 3 == 1, ",").otherwise("|")
    text = F.concat(F.lit("\n  \n"), C("lang"), sign, C("source"), sign, C("n_chars").cast("string"), F.lit("\n"), C("text"))
    return table(spark, d, "documents").select("doc_id", B.delimiter_of(text).alias("delimiter"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ';' ELSE ',' END AS delimiter, CAST(2 AS INT) AS line, 3 AS n_cells, sha256(trim(text)) AS text_sha256 FROM documents WHERE length(trim(text)) > 0""")
def src2_records(spark, d):
    """Every document as a delimited file of two records, its text a quoted cell with whatever breaks, quotes and delimiters it has."""
    sign = F.when(C("doc_id") % 2 == 0, ";").otherwise(",")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    files = table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", F.concat(F.lit("id"), sign, F.lit("text"), sign, F.lit("last\n"), C("doc_id").cast("string"), sign, quoted, sign, F.lit("end\n")).alias("text"))
    found = B.records(files, "doc_id").where("line > 1")
    return found.select("doc_id", "delimiter", "line", F.size("cells").alias("n_cells"), F.sha2(F.element_at("cells", 2).cast("binary"), 256).alias("text_sha256"))


@query("""SELECT doc_id, 3 AS n_cells, sha256(trim(text, ' ')) AS text_sha256 FROM documents WHERE trim(text, ' ') <> ''""")
def src2_files(spark, d):
    """The documents written as delimited files with quoted texts, and read back from them, block by block.

    A file's delimiter is told by its first line, so every file has a header: a text on that line may hold more of other delimiters.
    """
    path = shared_path(spark, "delimited")
    docs = table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", "text", F.lit("end").alias("last"))
    docs.write.options(sep=";", quote='"', escape='"', quoteAll=True, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    cells = D.read_records(spark, path).where("line > 1")
    return cells.select(F.element_at("cells", 1).cast("bigint").alias("doc_id"), F.size("cells").alias("n_cells"), F.sha2(F.element_at("cells", 2), 256).alias("text_sha256"))


@query("""SELECT CASE WHEN lang = 'es' THEN 'latin-1' ELSE 'utf-8' END AS encoding, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents
WHERE lang <> 'es' OR regexp_matches(text, '[^\\x00-\\x7f]') GROUP BY 1""")
def src3_encoding(spark, d):
    docs = table(spark, d, "documents").where((C("lang") != "es") | C("text").rlike(r"[^\x00-\x7F]"))
    content = F.when(C("lang") == "es", F.encode("text", "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    found = docs.select(B.decoded(content).alias("d"))
    return found.groupBy("d.encoding").agg(F.count("*").alias("n"), F.sum(F.length("d.text")).alias("characters"))


@query("""WITH h AS (SELECT l_orderkey AS k, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS name FROM lineitem),
b AS (SELECT *, CASE WHEN name = '' THEN 'column_' || pos ELSE name END AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY k, base ORDER BY pos) AS nth FROM b)
SELECT k, pos, CASE WHEN nth = 1 THEN base ELSE base || '_' || nth END AS name FROM n""")
def src4_header_names(spark, d):
    name = F.when(C("l_returnflag") == "R", "").otherwise(C("l_returnflag"))
    return B.header_names(table(spark, d, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("pos"), name.alias("name")), "k")


@query("""SELECT c_custkey, 'sheet: customers' || chr(10) || 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey
  || CASE WHEN c_mktsegment <> 'BUILDING' THEN chr(10) || 'c_mktsegment: ' || c_mktsegment ELSE '' END AS passage FROM customer""")
def src5_row_passages(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.when(C("c_mktsegment") != "BUILDING", C("c_mktsegment")).alias("c_mktsegment"))
    return rows.select("c_custkey", B.row_text(rows, "customers").alias("passage"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS flag, CASE WHEN strftime(o_orderdate, '%H:%M:%S') = '00:00:00' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS day,
  CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole FROM orders""")
def src6_cell_text(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (C("o_custkey") % 2 == 0).alias("flag"), C("o_orderdate").cast("timestamp").alias("day"), F.floor("o_totalprice").cast("double").alias("whole"))
    return rows.select("o_orderkey", *(B.cell_text(C(f.name), f.dataType).alias(f.name) for f in rows.schema.fields[1:]))


@query("""SELECT conv_id, turn, coalesce(CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS char_offset FROM conversations""")
def src7_timeline(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", C("turn").alias("pos"), "text")
    return G.timeline(rows, "conv_id").select("conv_id", C("pos").alias("turn"), "char_offset")


_CLEAN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\xa0]+', ' ', 'g'))"""
_BARE = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside", "form", "noscript"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"


@query(f"""SELECT page_id, {_CLEAN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages""")
def src8_page_title(spark, d):
    return table(spark, d, "pages").select("page_id", G.main_text(C("html"))["title"].alias("title"))


@query()
def src8_page_text(spark, d):
    """Main text; its nested-tag rules have no short SQL twin, so rows are checked by the unit tests."""
    return table(spark, d, "pages").select("page_id", G.main_text(C("html"))["text"].alias("text"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '([^/]+)/?$', 1), ''), '') AS file_name,
  left(md5(url), 11) AS video_id, sha256(url) AS sheet_id, CAST(page_id AS VARCHAR) AS gid FROM pages""")
def src9_links(spark, d):
    """Each page's own address, and links of both special kinds in four spellings whose ids come from it."""
    name = F.left(F.md5("url"), F.lit(11))
    video = F.when(C("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), name, F.lit("&t=3"))).when(C("page_id") % 4 == 1, F.concat(F.lit("https://youtu.be/"), name, F.lit("?t=1")))
    video = video.when(C("page_id") % 4 == 2, F.concat(F.lit("https://www.youtube.com/embed/"), name)).otherwise(F.concat(F.lit("https://m.youtube.com/watch?app=m&v="), name))
    sheet = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), F.sha2("url", 256), F.when(C("page_id") % 2 == 0, "/edit#gid=").otherwise("/edit?gid="), C("page_id").cast("string"))
    links = table(spark, d, "pages").select("page_id", G.link_parts(C("url")).alias("own"), G.link_parts(video).alias("video"), G.link_parts(sheet).alias("sheet"))
    return links.select("page_id", "own.file_name", "video.video_id", "sheet.sheet_id", "sheet.gid")


_FIGURES = """SELECT l_orderkey AS asset_id, l_linenumber AS page, l_suppkey AS xref, l_quantity * 8 AS width_px, l_quantity * 8 AS height_px, l_quantity AS area FROM lineitem"""


@query(f"""WITH f AS ({_FIGURES}), g AS (SELECT * FROM f WHERE width_px >= 96 AND height_px >= 96 AND area >= 0.02 * 1000),
s AS (SELECT asset_id, xref, count(DISTINCT page) AS on_pages FROM g GROUP BY ALL HAVING count(DISTINCT page) <= 3)
SELECT asset_id, page, xref FROM (SELECT DISTINCT asset_id, page, xref, area FROM g JOIN s USING (asset_id, xref))""")
def src10_figures(spark, d):
    figures = table(spark, d, "lineitem").select(C("l_orderkey").alias("asset_id"), C("l_linenumber").alias("page"), C("l_suppkey").alias("xref"), (C("l_quantity") * 8).alias("width_px"),
                                                 (C("l_quantity") * 8).alias("height_px"), C("l_quantity").alias("area"), F.lit(1000.0).alias("page_area"), C("l_quantity").alias("bbox"))
    return G.kept_figures(figures).select("asset_id", "page", "xref")


@query("""SELECT p_partkey AS asset_id, unnest(generate_series(0, p_size - 1, 8)) AS first, least(unnest(generate_series(0, p_size - 1, 8)) + 8, p_size) AS stop FROM part WHERE p_size > 0""")
def src11_page_batches(spark, d):
    assets = table(spark, d, "part").select(C("p_partkey").alias("asset_id"), C("p_size").cast("bigint").alias("pages"))
    return G.page_batches(assets, 8)


@query("SELECT c_custkey AS asset_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def src12_to_process(spark, d):
    return G.to_process(table(spark, d, "customer").select(C("c_custkey").alias("asset_id")), table(spark, d, "orders").select(C("o_custkey").alias("asset_id")))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, -1 FROM embeddings WHERE label = 0""")
def snk2_upsert(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    changes = rows.where("vec_id % 5 = 0").union(rows.where("label = 0").withColumn("vec_id", C("vec_id") + 1000000)).withColumn("label", F.lit(-1))
    return N.upserted(rows, changes, ["vec_id"])


@query("""SELECT doc_id, CASE WHEN doc_id % 97 = 3 THEN text || '!' ELSE text END AS text, doc_id % 97 = 3 AS touched FROM documents WHERE doc_id % 101 <> 5 UNION ALL SELECT doc_id + 1000000, text, true FROM documents WHERE doc_id % 89 = 1""")
def snk2_bucket_upsert(spark, d):
    """A bucketed table of the documents; all are sent again, some changed and some new, and others are deleted: what is as it was is not built again."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), shared_path(spark, "buckets")
    digested = lambda rows: rows.withColumn("digest", H.content_digest("text"))
    H.create(digested(docs), path, ["doc_id"], "digest", 64, lambda rows: rows.withColumn("touched", F.lit(False)))
    changed = docs.withColumn("text", F.when(C("doc_id") % 97 == 3, F.concat("text", F.lit("!"))).otherwise(C("text"))).union(docs.where("doc_id % 89 = 1").withColumn("doc_id", C("doc_id") + 1000000))
    H.upsert(spark, path, digested(changed), lambda rows: rows.withColumn("touched", F.lit(True)))
    H.delete(spark, path, (C("doc_id") % 101 == 5) & (C("doc_id") < 1000000))
    return H.table(spark, path).select("doc_id", "text", "touched")


@query("SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '7'")
def snk3_delete(spark, d):
    return N.without(table(spark, d, "events"), F.get_json_object("props", "$.k") == "7").select("event_id", "event_type")


@query("SELECT DISTINCT 'collection_' || regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') || '_images' AS collection FROM part")
def snk4_collections(spark, d):
    return table(spark, d, "part").select(N.collection_name(C("p_type"), pictures=True).alias("collection")).distinct()


@query("""SELECT conv_id, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id""")
def snk5_training_lines(spark, d):
    lines = N.conversation_json(table(spark, d, "conversations"), "conv_id")
    back = F.from_json("line", "messages array<struct<role:string,content:string>>").messages
    return lines.select("conv_id", "messages", F.aggregate(back, F.lit(0).cast("bigint"), lambda s, m: s + F.length(m["content"])).alias("characters"))


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'ordered' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def snk7_update_column(spark, d):
    changes = table(spark, d, "orders").select(C("o_custkey").alias("c_custkey")).distinct().withColumn("c_mktsegment", F.lit("ordered"))
    return N.updated(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), changes, "c_custkey", "c_mktsegment")


@query("""SELECT o_custkey, list_sort(list_filter(list_distinct(list_append(list(o_orderkey), 0)), lambda x: x % 4 <> 1)) AS ids FROM orders GROUP BY o_custkey""")
def snk7_update_arrays(spark, d):
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    gone = F.filter("ids", lambda x: x % 4 == 1)
    return grouped.select("o_custkey", F.array_sort(N.array_changed(C("ids"), F.array(F.lit(0).cast("bigint")), gone)).alias("ids"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE length(text) > 1000),
q AS (SELECT doc_id, unnest(list_filter(list_transform(parts, lambda x, i: CASE WHEN i > 1 THEN chr(10) || x ELSE x END), lambda x: x <> '')) AS piece FROM p)
SELECT doc_id, count(*) AS pieces, CAST(sum(length(piece)) AS BIGINT) AS characters, CAST(max(length(piece)) AS BIGINT) AS longest FROM q GROUP BY doc_id""")
def chk1_line_segments(spark, d):
    """Cuts at lines alone, so that SQL can follow; the full chain is chk1_segments."""
    docs = table(spark, d, "documents").where(F.length("text") > 1000)
    pieces = F.explode(F.split("text", r"(?=\n)")).alias("piece")
    return docs.select("doc_id", pieces).groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(F.length("piece")).alias("characters"), F.max(F.length("piece")).cast("bigint").alias("longest"))


@query("""SELECT doc_id, text AS joined, true AS small, CAST(length(text) AS BIGINT) AS characters FROM documents""")
def chk1_segments(spark, d):
    rows = K.segments(table(spark, d, "documents"), ["doc_id"], 1000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id").agg(joined.alias("joined"), (F.max(F.length("text")) <= 1000).alias("small"), F.max(C("start") + F.length("text")).alias("characters"))


@query("""WITH p AS (SELECT doc_id, string_split(text, '. ') AS parts FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, len(parts) AS n, CAST(list_sum(list_transform(parts, lambda x: length(x))) + 6 * (len(parts) - 1) AS BIGINT) AS characters FROM p)
SELECT doc_id, CASE WHEN characters > 40 THEN n ELSE 1 END AS sections, characters FROM c""")
def chk2_markdown(spark, d):
    """Every document's sentences as sections: no piece but a section's first opens with a heading, and no characters are lost."""
    text = F.replace(C("text"), F.lit(". "), F.lit(".\n\n## "))
    docs = table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", F.concat(F.lit(""), text).alias("text"))
    pieces = K.segments_of(C("text"), 40, K.MARKDOWN)
    heads = F.size(F.filter(pieces, lambda p: p.rlike(r"^\n?\n?##"))) + F.when(C("text").rlike(r"^\n?\n?##"), 0).otherwise(1)
    return docs.select("doc_id", heads.cast("bigint").alias("sections"), F.aggregate(pieces, F.lit(0).cast("bigint"), lambda n, p: n + F.length(p)).alias("characters"))


#: Cuts of a page, level by level: characters one a row, then the places where a piece that is still too long may be cut.
_PIECES = """chars AS (SELECT doc_id, n, i, c, coalesce(lead(c) OVER w, '') AS after, coalesce(lag(c) OVER w, '') AS before, coalesce(lag(c, 2) OVER w, '') AS before2
  FROM (SELECT doc_id, len(cs) AS n, unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE length(text) > 0)) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
level0 AS (SELECT *, i = 0 AS cut FROM chars)"""
for _level, _where in enumerate(("c = chr(10) AND after = chr(10)", "c = chr(10)", "before2 = '.' AND before = ' '", "c = ' '", "(i - head) % {size} = 0"), 1):
    _PIECES += f""",
heads{_level} AS (SELECT *, max(CASE WHEN cut THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM level{_level - 1}),
ends{_level} AS (SELECT *, count(*) OVER (PARTITION BY doc_id, head) AS long FROM heads{_level}),
level{_level} AS (SELECT * EXCLUDE (cut, head, long), cut OR (long > {{size}} AND {_where}) AS cut FROM ends{_level})"""

#: The fold over a page's pieces, one a step: what is held, and the passage that a step closes.
_PACKED = """, pieces AS (SELECT doc_id, i AS start, coalesce(lead(i) OVER w, n) - i AS size, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS pieces, n FROM level5 WHERE cut WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
headed AS (SELECT p.*, starts_with(ltrim(substr(d.text, p.start + 1, p.size), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '#') AS opens FROM pieces p JOIN documents d USING (doc_id)),
packed AS (
  SELECT doc_id, k, [{{'s': start, 'opens': opens}}] AS held, NULL::STRUCT(a BIGINT, b BIGINT, opens BOOLEAN) AS closed FROM headed WHERE k = 1
  UNION ALL
  SELECT p.doc_id, h.k, list_append(CASE WHEN h.start + h.size - p.held[1].s > {size} THEN list_filter(p.held, lambda x: h.start - x.s <= least({overlap}, {size} - h.size)) ELSE p.held END, {{'s': h.start, 'opens': h.opens}}),
    CASE WHEN h.start + h.size - p.held[1].s > {size} THEN {{'a': p.held[1].s, 'b': h.start, 'opens': p.held[1].opens}} END
  FROM packed p JOIN headed h ON h.doc_id = p.doc_id AND h.k = p.k + 1),
spans AS (SELECT doc_id, a, b, opens, row_number() OVER (PARTITION BY doc_id ORDER BY b, a) AS k, count(*) OVER (PARTITION BY doc_id) AS spans FROM (
  SELECT doc_id, closed.a AS a, closed.b AS b, closed.opens AS opens FROM packed WHERE closed IS NOT NULL
  UNION ALL SELECT p.doc_id, p.held[1].s, h.n, p.held[1].opens FROM packed p JOIN headed h ON h.doc_id = p.doc_id AND h.k = p.k AND h.pieces = h.k))"""

#: The fold over a page's passages: those under the floor go with the next or the last one, if that stays under the ceiling.
_MERGED = """, ahead AS (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY k) AS next_b FROM spans),
merged AS (
  SELECT doc_id, 0 AS k, NULL::BIGINT AS wait_a, NULL::BOOLEAN AS wait_opens, []::STRUCT(a BIGINT, b BIGINT)[] AS done FROM ahead WHERE k = 1
  UNION ALL
  SELECT doc_id, k, CASE WHEN way = 'forward' THEN a END, CASE WHEN way = 'forward' THEN opens END,
    CASE way WHEN 'forward' THEN done WHEN 'back' THEN list_append(done[:-2], {{'a': done[-1].a, 'b': b}}) ELSE list_append(done, {{'a': a, 'b': b}}) END
  FROM (SELECT *, CASE WHEN b - a >= {least} OR spans = 1 THEN 'own' WHEN forward AND (len(done) = 0 OR opens OR NOT back) THEN 'forward' WHEN back THEN 'back' ELSE 'own' END AS way
    FROM (SELECT *, k < spans AND next_b - a <= {size} + {least} AS forward, len(done) > 0 AND b - done[-1].a <= {size} + {least} AS back
      FROM (SELECT m.doc_id, s.k, coalesce(m.wait_a, s.a) AS a, s.b, coalesce(m.wait_opens, s.opens) AS opens, s.next_b, s.spans, m.done FROM merged m JOIN ahead s ON s.doc_id = m.doc_id AND s.k = m.k + 1))))"""

PASSAGES = ("WITH RECURSIVE " + _PIECES + _PACKED + _MERGED + """
SELECT doc_id, CAST(c - 1 AS INT) AS chunk_no, CAST(done[c].a AS INT) AS start, substr(text, done[c].a + 1, done[c].b - done[c].a) AS content
FROM (SELECT m.doc_id, m.done, unnest(range(1, len(m.done) + 1)) AS c, d.text FROM merged m JOIN ahead s ON s.doc_id = m.doc_id AND s.k = m.k AND s.spans = s.k JOIN documents d ON d.doc_id = m.doc_id)""").format(size=1000, overlap=200, least=100)


@query(PASSAGES)
def chk3_passages(spark, d):
    """Packed and merged passages of every document (CHK3, CHK4)."""
    return K.passages(table(spark, d, "documents").where(F.length("text") > 0), ["doc_id"])


@query("SELECT doc_id, 0 AS broken, CAST(length(text) AS BIGINT) AS reach FROM documents WHERE length(text) > 0")
def chk9_verify(spark, d):
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    chunks = K.passages(docs, ["doc_id"])
    broken = K.broken_passages(chunks, docs, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    reach = chunks.groupBy("doc_id").agg(F.max(C("start") + F.length("content")).cast("bigint").alias("reach"))
    return reach.join(broken, "doc_id", "left").select("doc_id", F.coalesce(C("n").cast("int"), F.lit(0)).alias("broken"), "reach")


@query("""SELECT c_custkey, 'customers · row ' || c_custkey || ' (continued)' || chr(10) || 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment || chr(10) || 'tail' AS content FROM customer""")
def chk5_continuation(spark, d):
    cells = F.array(F.struct(F.lit("name").alias("column"), C("c_name").alias("value")), F.struct(F.lit("notes").alias("column"), F.repeat(F.lit("x"), 100).alias("value")), F.struct(F.lit("segment").alias("column"), C("c_mktsegment").alias("value")))
    return table(spark, d, "customer").select("c_custkey", K.continued(F.lit("tail"), F.lit(900), F.lit("customers"), C("c_custkey"), K.identity(cells)).alias("content"))


@query("""SELECT l_orderkey AS asset_id, l_linenumber AS page, l_returnflag = 'R' AS is_image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag = 'R', l_linenumber) - 1 AS INT) AS chunk_order FROM lineitem""")
def chk6_chunk_order(spark, d):
    rows = table(spark, d, "lineitem").select(C("l_orderkey").alias("asset_id"), C("l_linenumber").alias("page"), F.lit(0).alias("start"), "l_returnflag")
    out = K.ordered_chunks(rows.where("l_returnflag <> 'R'").drop("l_returnflag"), rows.where("l_returnflag = 'R'").drop("l_returnflag"))
    return out.select("asset_id", "page", "is_image", "chunk_order")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '[image, page ' || p_size || ']' END AS content FROM part")
def chk7_image_content(spark, d):
    return table(spark, d, "part").select("p_partkey", K.image_content(F.when(C("p_size") % 2 == 0, C("p_name")).otherwise(F.lit("  ")), C("p_size").cast("string")).alias("content"))


@query("""SELECT l_orderkey AS asset_id, l_linenumber AS page, CASE WHEN l_linestatus = 'F' THEN 'fixed' ELSE l_returnflag END AS text, count(*) OVER (PARTITION BY l_orderkey) AS total_pages FROM lineitem""")
def chk8_assemble(spark, d):
    fixed = F.when(C("l_linestatus") == "F", F.lit("fixed")).otherwise(F.lit(""))
    return K.assembled(table(spark, d, "lineitem").select(C("l_orderkey").alias("asset_id"), C("l_linenumber").alias("page"), C("l_returnflag").alias("text"), fixed.alias("corrected_text")))


@query("""SELECT conv_id AS doc_id, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS pages FROM conversations GROUP BY conv_id""")
def chk10_group_pages(spark, d):
    pairs = table(spark, d, "conversations").select(C("conv_id").alias("doc_id"), C("turn").alias("page"), C("text").alias("damaged"), F.upper("text").alias("corrected"))
    blank = pairs.withColumn("page", C("page") + 1000).withColumn("damaged", F.lit(" "))
    groups = K.grouped_pages(pairs.union(blank), 300)
    parts = groups.withColumn("characters", F.length("damaged") - C("pages") + 1)
    return parts.groupBy("doc_id").agg(F.sum("characters").alias("characters"), F.sum("pages").alias("pages"))
