"""Registered queries over the text, scoring and payload columns, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.functions import payload as P
from textquarry.functions import scoring as S
from textquarry.functions import text as X
from textquarry.plans.registry import query
from textquarry.tables import table

C = F.col


@query("SELECT doc_id, regexp_replace(nfc_normalize(text), '[ \\t\\xa0]+', ' ', 'g') AS clean FROM documents")
def txt1_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(C("text")).alias("clean"))


@query("SELECT doc_id, replace(text, 'e', '') AS bare, [replace(lang, 'e', ''), source] AS tags FROM documents")
def txt2_strip_nulls(spark, d):
    docs = table(spark, d, "documents")
    damaged = docs.select("doc_id", F.replace("text", F.lit("e"), F.lit("\0")).alias("text"), F.array(F.replace("lang", F.lit("e"), F.lit("\0")), "source").alias("tags"))
    return damaged.select("doc_id", X.strip_nulls(C("text")).alias("bare"), X.strip_nulls(C("tags"), damaged.schema["tags"].dataType).alias("tags"))


@query("""SELECT lang, count(*) AS n, count(*) FILTER (lang = 'de') AS damaged,
  count(*) FILTER (regexp_replace(text, '[ \\t\\xa0]+', ' ', 'g') <> text) AS reshaped FROM documents GROUP BY lang""")
def txt3_sanitize(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.when(C("lang") == "de", F.concat(C("text"), F.lit("\0"))).otherwise(C("text")))
    return X.sanitize(docs).groupBy("lang").agg(F.count("*").alias("n"), F.count_if("had_nulls").alias("damaged"), F.count_if("reshaped").alias("reshaped"))


_PROFILE = """SELECT doc_id, length(text) AS characters, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS latin,
  length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits, length(regexp_replace(text, '[^\\s]', '', 'g')) AS spaces,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents"""


@query(_PROFILE)
def txt4_script_profile(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.script_profile(C("text")).alias("p"))
    return p.select("doc_id", *(C(f"p.{k}").cast("bigint").alias(k) for k in ("characters", "latin", "digits", "spaces", "words")))


@query(f"""WITH p AS ({_PROFILE}), r AS (SELECT *, CASE WHEN characters > 0 THEN spaces / characters ELSE 0 END AS ratio FROM p)
SELECT doc_id, ratio AS space_ratio, characters > 80 AND ratio > 0.22 AS fragmented, characters > 80 AND ratio < 0.13 AS run_together,
  NOT (characters > 80 AND (ratio > 0.22 OR ratio < 0.13)) AS usable FROM r""")
def txt5_usability(spark, d):
    p = X.with_usability(table(spark, d, "documents").select("doc_id", "text"))
    return p.select("doc_id", "space_ratio", "fragmented", "run_together", "usable")


_EDGE = """regexp_replace(regexp_replace({}, '^[.,;:!?()\\[\\]{{}}«»"''\\-—…]+', ''), '[.,;:!?()\\[\\]{{}}«»"''\\-—…]+$', '')"""
_RATIO = f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{M}}]')) AS tokens FROM documents),
w AS (SELECT doc_id, len(tokens) AS n, len(list_filter(list_transform(tokens, lambda x: {_EDGE.format('x')}),
  lambda c: regexp_full_match(c, '[\\p{{L}}\\p{{M}}\\-''’]+') AND length(regexp_replace(c, '[\\-''’]', '', 'g')) >= 3)) AS words FROM t)
SELECT doc_id, CAST(words AS INT) AS words, CASE WHEN n > 0 THEN words / n ELSE 0 END AS ratio FROM w"""


@query(_RATIO)
def txt6_word_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_ratio(C("text")).alias("r")).select("doc_id", "r.words", "r.ratio")


@query(f"SELECT doc_id, words >= 2 AND ratio >= 0.5 AS reads FROM ({_RATIO})")
def txt7_reads_as_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.reads_as_text(C("text")).alias("reads"))


_TALK = ", ".join("'" + w.replace("'", "''") + "'" for w in X.SMALL_TALK)
_ASCII_TALK = ", ".join("'" + w.replace("'", "''") + "'" for w in X.SMALL_TALK if w.isascii())


@query(f"""WITH m AS (SELECT conv_id, turn, talk[1 + conv_id % len(talk)] || ' ' || upper(talk[1 + (7 * turn + conv_id) % len(talk)]) || CASE WHEN conv_id % 3 = 0 THEN ' ' || left(text, 40) ELSE '!' END || CASE WHEN turn % 5 = 1 THEN '?' ELSE '' END AS said
  FROM conversations, (SELECT [{_ASCII_TALK}] AS talk)),
w AS (SELECT *, regexp_extract_all(lower(trim(said)), '\\p{{L}}+(?:''[a-z]+)?') AS words FROM m)
SELECT conv_id, turn, said, NOT contains(said, '?') AND len(words) BETWEEN 1 AND 8 AND len(list_filter(words, lambda x: x NOT IN ({_TALK}))) = 0 AS small_talk FROM w""")
def txt8_small_talk(spark, d):
    """Two words of small talk that change from turn to turn, in some turns with the turn's own words or a question mark."""
    talk = F.array(*(F.lit(w) for w in X.SMALL_TALK if w.isascii()))
    n = F.size(talk).cast("bigint")
    word = lambda at: F.element_at(talk, (1 + at % n).cast("int"))
    said = F.concat(word(C("conv_id")), F.lit(" "), F.upper(word(7 * C("turn") + C("conv_id"))), F.when(C("conv_id") % 3 == 0, F.concat(F.lit(" "), F.left("text", F.lit(40)))).otherwise("!"), F.when(C("turn") % 5 == 1, "?").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", said.alias("said"), X.is_small_talk(said).alias("small_talk"))


_HEADS = "[" + ", ".join(f"'{w}'" for w in X.LABEL_KINDS) + "]"
_KINDS = "[" + ", ".join(f"'{k}'" for k in X.LABEL_KINDS.values()) + "]"


@query(f"""WITH h AS (SELECT doc_id, n_chars, {_HEADS} AS heads, {_KINDS} AS kinds, 1 + doc_id % {len(X.LABEL_KINDS)} AS a, 1 + n_chars % {len(X.LABEL_KINDS)} AS b FROM documents),
l AS (SELECT doc_id, kinds[a] AS kind, CAST(n_chars AS VARCHAR) AS number FROM h UNION SELECT doc_id, kinds[b], CAST(doc_id AS VARCHAR) || 'b' FROM h) SELECT * FROM l""")
def txt9_labels(spark, d):
    """Two labels, of all heads in turn, within each document's own text."""
    heads = F.array(*map(F.lit, X.LABEL_KINDS))
    head = lambda at: F.element_at(heads, (1 + at % len(X.LABEL_KINDS)).cast("int"))
    text = F.concat(C("text"), F.lit(" see "), head(C("doc_id")), F.lit(" "), C("n_chars").cast("string"), F.lit(", "), F.left("text", F.lit(50)), F.lit(" and "), F.initcap(head(C("n_chars"))), F.lit(" "), C("doc_id").cast("string"), F.lit("b."))
    return table(spark, d, "documents").select("doc_id", F.inline(X.labels_in(text)))


@query("""SELECT item_id, list_slice([regexp_replace(text, '\\s+', ' ', 'g'), 'more about it'], 1, 2) AS queries FROM benchmark""")
def txt10_distinct_queries(spark, d):
    many = F.array(F.concat(F.lit("  "), "text"), F.lit(""), F.upper("text"), F.lit("more  about it"), F.lit("More about it"), F.lit("third"))
    return table(spark, d, "benchmark").select("item_id", X.distinct_queries(many, 2).alias("queries"))


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN ['q'] ELSE ['q', 'ما هو ' || text] END AS queries FROM benchmark")
def txt11_question_script(spark, d):
    question = F.when(C("item_id") % 2 == 0, C("text")).otherwise(F.concat(F.lit("ما هو "), "text"))
    return table(spark, d, "benchmark").select("item_id", X.with_question(F.array(F.lit("q")), question).alias("queries"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'chitchat' WHEN turn % 3 = 2 THEN 'complex' ELSE 'simple' END AS intent,
  CASE WHEN role = 'system' THEN [] WHEN turn % 3 = 2 THEN ['a', 'b'] WHEN turn % 3 = 1 THEN ['a'] ELSE ['whole'] END AS sub_queries FROM conversations""")
def txt12_plan(spark, d):
    intent = F.when(C("role") == "system", "chitchat").otherwise("simple")
    subs = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (C("turn") % 3).cast("int"))
    p = table(spark, d, "conversations").select("conv_id", "turn", X.plan(intent, F.lit(" whole "), subs, C("text")).alias("p"))
    return p.select("conv_id", "turn", "p.intent", "p.sub_queries")


@query("""SELECT event_id, CASE WHEN value >= 36 THEN format('{:d}:{:02d}:{:02d}', CAST(floor(value * 100) AS BIGINT) // 3600, CAST(floor(value * 100) AS BIGINT) % 3600 // 60, CAST(floor(value * 100) AS BIGINT) % 60)
  ELSE format('{:d}:{:02d}', CAST(floor(value * 100) AS BIGINT) // 60, CAST(floor(value * 100) AS BIGINT) % 60) END AS label FROM events""")
def txt14_time_label(spark, d):
    return table(spark, d, "events").select("event_id", X.time_label(C("value") * 100).alias("label"))


@query("""WITH p AS (SELECT doc_id, text, left(text, CAST(length(text) * (doc_id % 4) / 3 AS INT)) AS fixed FROM documents),
q AS (SELECT *, coalesce(trim(fixed) <> '', false) AND length(fixed) / length(text) BETWEEN 0.5 AND 2 AS ok FROM p)
SELECT doc_id, ok AS accepted, CASE WHEN ok THEN length(text) / length(fixed) ELSE 1.0::DOUBLE END AS scale FROM q""")
def txt15_length_band(spark, d):
    docs = table(spark, d, "documents")
    fixed = F.left(C("text"), F.bround(F.length("text") * (C("doc_id") % 4) / 3).cast("int"))
    return docs.select("doc_id", X.accepted(C("text"), fixed).alias("a")).select("doc_id", "a.accepted", "a.scale")


@query("""SELECT conv_id, substr(trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def txt16_title(spark, d):
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.groupBy("conv_id").agg(X.title_of(F.min_by("text", "turn")).alias("title"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN false ELSE true END AS valid FROM part""")
def txt17_valid_quiz(spark, d):
    wrong = F.array(C("p_type"), F.concat(C("p_name"), F.lit(" x")), F.when(C("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(F.concat(C("p_name"), F.lit(" y"))))
    return table(spark, d, "part").select("p_partkey", X.valid_quiz(F.concat(F.lit("Which is "), C("p_partkey").cast("string"), F.lit("?")), C("p_name"), wrong).alias("valid"))


@query("SELECT doc_id, left(text, 4000) AS head, right(text, 1500) AS tail FROM documents")
def txt19_prompt_item(spark, d):
    return table(spark, d, "documents").select("doc_id", X.prompt_item(C("text"), C("text")).alias("p")).select("doc_id", C("p.text").alias("head"), C("p.context").alias("tail"))


@query("SELECT lang, count(*) FILTER (lang <> 'fr') AS named, count(*) FILTER (lang = 'fr') AS rejected FROM documents GROUP BY lang")
def txt20_rejects(spark, d):
    name = F.when(C("lang") == "fr", F.lit(" \n\t")).otherwise(C("source"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(X.is_named(name)).alias("named"), F.count_if(~X.is_named(name)).alias("rejected"))


@query("SELECT page_id, true AS skips FROM pages WHERE length(url) > 0 UNION ALL SELECT doc_id, source = 'src0' FROM documents")
def txt21_skips_correction(spark, d):
    pages = table(spark, d, "pages").select("page_id", X.skips_correction(F.lit("pdf"), C("url")).alias("skips"))
    docs = table(spark, d, "documents").select(C("doc_id"), X.skips_correction(F.when(C("source") == "src0", "txt").otherwise("pdf"), F.lit("")))
    return pages.union(docs)


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN trim(text) END AS fact FROM conversations")
def txt22_command(spark, d):
    said = F.when(C("role") == "user", F.concat(F.lit(" /Memory "), "text")).otherwise(C("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.command_text(said).alias("fact"))


_PAIRS = "SELECT p_partkey AS k, p_name AS a, p_type AS b FROM part"


def _pairs(spark, d):
    return table(spark, d, "part").select(C("p_partkey").alias("k"), C("p_name").alias("a"), C("p_type").alias("b"))


@query(f"SELECT k, levenshtein(a, b) AS distance FROM ({_PAIRS})")
def mth1_edit_distance(spark, d):
    return _pairs(spark, d).select("k", F.levenshtein("a", "b").cast("bigint").alias("distance"))


@query(f"SELECT k, levenshtein(a, b) / length(a) AS cer FROM ({_PAIRS})")
def mth2_character_error_rate(spark, d):
    return _pairs(spark, d).select("k", S.error_rate(C("a"), C("b")).alias("cer"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1 / len(string_split(p_type || ' ' || p_brand, ' ')) ELSE 0.0 END AS wer FROM part""")
def mth3_word_error_rate(spark, d):
    text = F.concat_ws(" ", "p_type", "p_brand")
    read = F.when(C("p_partkey") % 3 == 0, F.concat_ws(" ", "p_type", F.lit("zzz"))).otherwise(text)
    return table(spark, d, "part").select("p_partkey", S.word_error_rate(text, read).alias("wer"))


@query(f"SELECT k, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS agreement FROM ({_PAIRS})")
def mth4_agreement(spark, d):
    return _pairs(spark, d).select("k", S.agreement(C("a"), C("b")).alias("agreement"))


@query("""WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(left(text, length(text) // 2)), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS a,
  list_distinct(list_filter(string_split(trim(regexp_replace(lower(right(text, length(text) - length(text) // 2)), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS b FROM documents)
SELECT doc_id, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS overlap FROM w""")
def mth5_word_overlap(spark, d):
    half = F.floor(F.length("text") / 2).cast("int")
    return table(spark, d, "documents").select("doc_id", S.word_overlap(F.left("text", half), F.right("text", F.length("text") - half)).alias("overlap"))


@query("""WITH q AS (SELECT vec_id - 1 AS of, embedding::DOUBLE[] AS q FROM embeddings)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine, round(list_inner_product(embedding::DOUBLE[], q), 6) AS dot,
  round(0 - list_distance(embedding::DOUBLE[], q), 6) AS euclid FROM embeddings JOIN q ON q.of = vec_id""")
def mth6_similarity(spark, d):
    vectors = table(spark, d, "embeddings")
    both = vectors.join(vectors.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("q")), "vec_id")
    return both.select("vec_id", *(F.round(S.similarity(C("embedding"), C("q"), m), 6).alias(m) for m in ("cosine", "dot", "euclid")))


@query("SELECT event_id, round(1 / (1 + exp(50 - value)), 9) AS score FROM events")
def mth7_sigmoid(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.sigmoid(C("value") - 50), 9).alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 > 0 THEN round_even(100 * (o_custkey % 7) / (o_custkey % 10), 0) END AS percent FROM orders")
def mth8_progress(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.progress(C("o_custkey") % 7, C("o_custkey") % 10).alias("percent"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity * p / 1e6 AS input_cost, l_extendedprice * 2 * p / 1e6 AS output_cost
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1.5 WHEN 'N' THEN 0.25 END AS p FROM lineitem)""")
def mth9_token_cost(spark, d):
    price = F.when(C("l_returnflag") == "A", 1.5).when(C("l_returnflag") == "N", 0.25)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.token_cost(C("l_quantity"), price).alias("input_cost"), S.token_cost(C("l_extendedprice"), 2 * price).alias("output_cost"))


@query("""WITH g AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size * 10.0 >= 200 THEN p_size * 10.0 - 200 WHEN p_size * 10.0 + 30 <= 100 THEN 100 - (p_size * 10.0 + 30) ELSE 0 END AS gap FROM part)
SELECT p_partkey, CASE WHEN s % 5 = 0 THEN 0.0 WHEN gap <= 250 THEN 1 - gap / 250 ELSE 0.0 END AS near FROM g""")
def mth10_nearness(spark, d):
    left = F.when(C("p_size") % 5 == 0, F.lit(900.0)).otherwise(F.lit(10.0))
    y = C("p_size") * F.lit(10.0)
    rects = F.array(F.array(left, y, left + 50, y + 30))
    return table(spark, d, "part").select("p_partkey", S.nearness(rects, F.array(*(F.lit(float(v)) for v in (0, 100, 300, 200)))).alias("near"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (epoch(now - ts) > 2 * 86400) AS stale, count(*) FILTER (epoch(now - ts) > 10 * 86400) AS removable, count(*) AS n FROM events, n GROUP BY event_type""")
def dat1_retention(spark, d):
    """DAT1: events by both cutoffs, twice a limit of a day and a retention of ten, before the newest event."""
    events = table(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(C("ts").cast("timestamp"))
    past = lambda seconds: F.count_if(age > seconds * 1_000_000)
    return events.groupBy("event_type").agg(past(2 * 86400).alias("stale"), past(10 * 86400).alias("removable"), F.count("*").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def jsn1_json_object(spark, d):
    raw = F.concat(F.lit("Sure! Here it is: ```json\n"), "props", F.lit("\n``` done"))
    return table(spark, d, "events").select("event_id", P.json_object(raw, "k bigint").k.alias("k"))


@query("""SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 THEN [CAST(json_extract_string(props, '$.k') AS BIGINT)] ELSE [] END AS items,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 3 THEN 1 ELSE 2 END AS dropped FROM events""")
def jsn2_salvage(spark, d):
    raw = F.concat(F.lit("["), "props", F.lit(", {\"k\": oops}, {\"k\": 4"))
    s = table(spark, d, "events").select("event_id", P.salvaged(raw, "k bigint", lambda x: F.coalesce(x.k >= 3, F.lit(False))).alias("s"))
    return s.select("event_id", F.transform("s.items", lambda x: x.k).alias("items"), "s.dropped")


@query("SELECT event_type, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') = '7' GROUP BY event_type")
def jsn3_path_filter(spark, d):
    return table(spark, d, "events").where(P.path_is(C("props"), "k", "7")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS entries FROM orders GROUP BY o_custkey")
def jsn4_drop_chunks(spark, d):
    entries = F.array_sort(F.collect_list(F.struct("o_orderkey", F.array("o_orderstatus").alias("chunks"))))
    kept = F.transform(entries, lambda e: e.dropFields("chunks"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(kept, lambda e: e["o_orderkey"]).alias("entries"))


@query("""SELECT c_mktsegment, sha256('{"task":"' || c_mktsegment || '","args":{"a":"1","b":"' || c_mktsegment || '"}}') AS print, count(*) AS n FROM customer GROUP BY c_mktsegment""")
def jsn5_fingerprint(spark, d):
    args = F.create_map(F.lit("b"), C("c_mktsegment"), F.lit("a"), F.lit("1"))
    return table(spark, d, "customer").select("c_mktsegment", P.fingerprint(C("c_mktsegment"), args).alias("print")).groupBy("c_mktsegment", "print").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def jsn6_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", P.content_hash(C("text")).alias("hash"))


@query("""SELECT event_id, [CAST(json_extract_string(props, '$.k') AS BIGINT), 5] AS ks FROM events""")
def jsn7_event_payloads(spark, d):
    body = F.concat(F.lit("event: x\ndata: "), "props", F.lit("\n\n: note\ndata:{\"k\": 5}\n"))
    return table(spark, d, "events").select("event_id", F.transform(P.event_payloads(body, "k bigint"), lambda x: x.k).alias("ks"))


@query("""WITH a AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS items FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_append(items, -1) AS items, len(items) + 1 AS n FROM a""")
def jsn8_array_append(spark, d):
    items = F.array_sort(F.collect_list("o_orderkey"))
    grown = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_append(items, F.lit(-1).cast("bigint")).alias("items"))
    return grown.withColumn("n", F.size("items").cast("bigint"))


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN 'txt' WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'image' ELSE 'other' END AS kind FROM documents""")
def jsn9_asset_type(spark, d):
    mime = F.when(C("lang") == "en", "TEXT/plain").when(C("lang") == "de", "application/pdf").when(C("lang") == "fr", "image/png").otherwise("video/mp4")
    return table(spark, d, "documents").select("doc_id", P.asset_type(mime).alias("kind"))
