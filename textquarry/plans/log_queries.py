"""Registered queries over logs, evaluation records and ownership chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from textquarry.operators import evaluation as E
from textquarry.operators import logs as L
from textquarry.operators import ownership as O
from textquarry.operators import quantiles as Q
from textquarry.plans.registry import query
from textquarry.streaming import once
from textquarry.streaming import timed as S
from textquarry.tables import table

C = F.col
_STATUS = "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'STARTED' WHEN 'error' THEN 'FAILURE' WHEN 'purchase' THEN 'SUCCESS' ELSE 'DEAD' END"
_TASKS = f"""(SELECT event_id, ts, event_id AS task_id, event_type AS task_name, json_extract_string(props, '$.k') AS args_hash, user_id AS project_id, value, {_STATUS} AS status FROM events)"""


def _tasks(spark, d):
    status = F.when(C("event_type") == "view", "QUEUED").when(C("event_type") == "click", "STARTED").when(C("event_type") == "error", "FAILURE").when(C("event_type") == "purchase", "SUCCESS").otherwise("DEAD")
    return table(spark, d, "events").select("event_id", "ts", C("ts").alias("created_at"), C("event_id").alias("task_id"), C("event_type").alias("task_name"), F.get_json_object("props", "$.k").alias("args_hash"), C("user_id").alias("project_id"), "value", status.alias("status"))


@query(f"""SELECT task_name, args_hash, task_id FROM (SELECT *, row_number() OVER (PARTITION BY task_name, args_hash ORDER BY ts DESC, task_id DESC) AS n FROM {_TASKS} WHERE status IN ('QUEUED', 'STARTED')) WHERE n = 1""")
def win1_in_flight(spark, d):
    return L.in_flight(_tasks(spark, d)).select("task_name", "args_hash", "task_id")


@query(f"""SELECT project_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE status WHEN 'STARTED' THEN 0 ELSE 1 END, ts, task_id) AS n FROM {_TASKS} WHERE status IN ('QUEUED', 'STARTED')) WHERE n = 1""")
def win2_active_task(spark, d):
    return L.active_task(_tasks(spark, d)).select("project_id", "task_id")


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def win3_last_messages(spark, d):
    return L.first_of(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")], 4).select("conv_id", "turn", "text")


@query("""SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END
  || CASE WHEN length(t) > 600 THEN left(t, 600) || '…' ELSE t END AS line FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant')) WHERE n <= 4) GROUP BY conv_id""")
def txt13_history(spark, d):
    """TXT13: the last four turns as text."""
    from textquarry.functions.text import squeezed

    last = L.first_of(table(spark, d, "conversations").where("role in ('user', 'assistant')"), ["conv_id"], [F.desc("turn")], 4)
    text = squeezed(C("text"))
    line = F.concat(F.when(C("role") == "user", "User: ").otherwise("Assistant: "), F.when(F.length(text) > 600, F.concat(F.left(text, F.lit(600)), F.lit("…"))).otherwise(text))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS place FROM orders")
def win4_listing(spark, d):
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", place.alias("place"))


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN n <= 3 THEN 0 ELSE (n - 4) // 10 + 1 END AS BIGINT) AS batch FROM n""")
def win6_micro_batches(spark, d):
    return O.micro_batches(table(spark, d, "conversations"), "conv_id", "turn", 10, 3).select("conv_id", "turn", "batch")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 3")
def win7_cap_items(spark, d):
    return L.first_of(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def win10_default_session(spark, d):
    return L.first_of(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 6 AND 10")
def win11_page(spark, d):
    return O.page_of(table(spark, d, "orders"), "o_custkey", "o_orderkey", 2, 5).select("o_custkey", "o_orderkey")


_LADDER = ", ".join(map(str, L.COUNT_BUCKETS))
_BUCKETS = f"""(SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([{_LADDER}, 'inf'::DOUBLE]) AS le) GROUP BY event_type, le)"""


@query(f"SELECT * FROM {_BUCKETS}")
def agg10_buckets(spark, d):
    return L.buckets(table(spark, d, "events"), ["event_type"], "value", L.COUNT_BUCKETS)


@query(f"""WITH m AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS before, max(n) OVER (PARTITION BY event_type) AS total FROM {_BUCKETS} WINDOW w AS (PARTITION BY event_type ORDER BY le)),
h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS r FROM m WHERE n >= 0.95 * total)
SELECT event_type, CASE WHEN le = 'inf' THEN low ELSE coalesce(low + (le - low) * (0.95 * total - before) / nullif(n - before, 0), le) END AS value FROM h WHERE r = 1""")
def agg11_histogram_quantile(spark, d):
    return L.histogram_quantile(agg10_buckets(spark, d), ["event_type"], 0.95)


@query("""SELECT event_type AS handler, count(*) AS requests, count(*) FILTER (event_type <> 'error') / count(*) AS ok_ratio, sum(value) / count(*) AS mean_s FROM events GROUP BY event_type""")
def agg12_requests(spark, d):
    ok = F.count_if(C("event_type") != "error") / F.count("*")
    return table(spark, d, "events").groupBy(C("event_type").alias("handler")).agg(F.count("*").alias("requests"), ok.alias("ok_ratio"), (F.sum("value") / F.count("*")).alias("mean_s"))


@query("""WITH g AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS p FROM events)
SELECT user_id, time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) AS start, round(sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END) / 3600, 9) AS rate FROM g GROUP BY 1, 2""")
def agg13_counter_rate(spark, d):
    rates = L.counter_rate(table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp_ntz")), ["user_id"], "1 hour", 3600)
    return rates.withColumn("rate", F.round("rate", 9))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') / greatest(count(*) FILTER (event_type IN ('view', 'click')), 1e-9) AS hits FROM events GROUP BY user_id")
def agg14_hit_ratio(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(L.share(F.count_if(C("event_type") == "view"), F.count_if(C("event_type").isin("view", "click"))).alias("hits"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * 1.5 / 1e6), 6) AS cost FROM lineitem GROUP BY ALL")
def agg15_counters(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(C("l_extendedprice") * 1.5 / 1e6), 6).alias("cost"))


@query("SELECT source, count(*) FILTER (lang = 'en') * 2 > count(*) AS mostly_english FROM documents GROUP BY source")
def agg16_majority_language(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(E.majority(C("lang") == "en", "mostly_english"))


@query("SELECT c_nationkey, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT c_nationkey, c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) GROUP BY c_nationkey")
def agg17_counts(spark, d):
    per = table(spark, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(per, "c_custkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"))


@query("""SELECT event_type, count(*) AS requests, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS p95, count(*) FILTER (value > 90) AS failures FROM events GROUP BY event_type""")
def agg18_latency(spark, d):
    events = table(spark, d, "events")
    counts = events.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(C("value") > 90).alias("failures"))
    return counts.join(Q.exact(events, ["event_type"], "value", {"median": 0.5, "p95": 0.95}), "event_type").select("event_type", "requests", "median", "p95", "failures")


@query("""WITH e AS (SELECT event_type, value FROM events), q AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.48) AS m0, quantile_cont(value, 0.52) AS m1, quantile_cont(value, 0.93) AS p0, quantile_cont(value, 0.97) AS p1 FROM e GROUP BY 1)
SELECT event_type, n, true AS median_in_bound, true AS p95_in_bound FROM q""")
def agg18_hourly_sketches(spark, d):
    """Sketches of every hour, merged to the whole span: number of values, and whether the quantiles keep a rank error of 0.02."""
    events = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    whole = Q.estimated(Q.merged(Q.sketched(events, ["event_type", "hour"], "value"), ["event_type"]), {"median": 0.5, "p95": 0.95})
    bounds = Q.exact(events, ["event_type"], "value", {"m0": 0.48, "m1": 0.52, "p0": 0.93, "p1": 0.97})
    return whole.join(bounds, "event_type").select("event_type", "n", C("median").between(C("m0"), C("m1")).alias("median_in_bound"), C("p95").between(C("p0"), C("p1")).alias("p95_in_bound"))


@query("""WITH n AS (SELECT event_type AS stage, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS s FROM events)
SELECT stage, count(*) AS n, round(avg(s), 3) AS mean_seconds FROM n WHERE s IS NOT NULL GROUP BY stage""")
def agg19_stage_durations(spark, d):
    return L.stage_durations(table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp")).withColumn("stage", C("event_type")), "user_id").withColumn("mean_seconds", F.round("mean_seconds", 3))


@query("""SELECT l_orderkey AS collection, count(*) AS chunks, count(*) FILTER (l_returnflag <> 'R') AS points, count(*) = count(*) FILTER (l_returnflag <> 'R') AS in_step FROM lineitem GROUP BY l_orderkey""")
def agg2_index_drift(spark, d):
    rows = table(spark, d, "lineitem").select(C("l_orderkey").alias("collection"), F.array(F.lit(1.0)).alias("embedding"), "l_returnflag")
    return O.index_drift(rows, rows.where("l_returnflag <> 'R'")).drop("dimension")


@query("SELECT o_orderstatus, count(*) AS chunks, count(*) FILTER (o_orderpriority = '1-URGENT') AS pending FROM orders GROUP BY o_orderstatus")
def agg1_chunk_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("chunks"), F.count_if(C("o_orderpriority") == "1-URGENT").alias("pending"))


@query("""SELECT l_orderkey AS asset_id, count(DISTINCT l_linenumber) FILTER (l_linestatus = 'F') AS corrected, CAST(max(l_linenumber) AS INT) AS total FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT l_linenumber) FILTER (l_linestatus = 'F') = max(l_linenumber)""")
def agg3_complete(spark, d):
    rows = table(spark, d, "lineitem").select(C("l_orderkey").alias("asset_id"), C("l_linenumber").alias("batch_index"), F.when(C("l_linestatus") == "F", "corrected").otherwise("new").alias("status"), C("l_linenumber").alias("total_batches"))
    return O.complete_assets(rows.union(rows))


@query("""SELECT l_returnflag AS extractor, count(*) AS pages, count(*) FILTER (l_linestatus = 'F') AS ok, quantile_cont(l_quantity, 0.5) AS median_cer, quantile_cont(l_extendedprice, 0.5) AS median_seconds FROM lineitem GROUP BY 1""")
def agg4_engine_summary(spark, d):
    rows = table(spark, d, "lineitem").select(C("l_returnflag").alias("extractor"), C("l_quantity").alias("cer"), C("l_extendedprice").alias("seconds"), F.when(C("l_linestatus") != "F", "failed").alias("error"))
    return E.engine_summary(rows, ["cer", "seconds"]).drop("first_error")


@query("""WITH r AS (SELECT p_partkey AS page, p_brand AS extractor, x AS text FROM (SELECT p_partkey, 'a' AS p_brand, p_name AS x FROM part UNION ALL SELECT p_partkey, 'b', p_name FROM part UNION ALL SELECT p_partkey, 'c', p_name || 'zz' FROM part)),
p AS (SELECT a.extractor, 1 - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) AS s,
  len(list_intersect(list_distinct(string_split(lower(a.text), ' ')), list_distinct(string_split(lower(b.text), ' ')))) / len(list_distinct(string_split(lower(a.text), ' '))) AS o FROM r a JOIN r b USING (page) WHERE a.extractor <> b.extractor)
SELECT extractor, round(avg(greatest(s, o)), 9) AS consensus FROM p GROUP BY extractor""")
def agg5_consensus(spark, d):
    part = table(spark, d, "part")
    engine = lambda name, text: part.select(F.lit("s").alias("source"), C("p_partkey").alias("page"), F.lit(name).alias("extractor"), text.alias("text"))
    rows = engine("a", C("p_name")).union(engine("b", C("p_name"))).union(engine("c", F.concat("p_name", F.lit("zz"))))
    return E.consensus(rows).withColumn("consensus", F.round("consensus", 9))


@query("""SELECT o_custkey AS extractor, o_orderkey AS run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) END DESC NULLS LAST,
  CASE WHEN o_orderstatus <> 'F' THEN epoch_us(o_orderdate) END ASC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1""")
def agg6_merged_runs(spark, d):
    runs = table(spark, d, "orders").select(C("o_custkey").alias("extractor"), C("o_orderkey").alias("run"), C("o_orderdate").cast("timestamp").alias("mtime"), (C("o_orderstatus") == "F").cast("int").alias("ok"))
    return E.merged_runs(runs).select("extractor", "run")


def _records(spark, d):
    rows = table(spark, d, "events")
    scores = F.map_from_arrays(F.array(F.lit("faithfulness"), F.lit("recall")), F.array(C("value") / 100, F.when(C("event_type") != "click", C("value") / 200)))
    return rows.select("event_id", F.when(C("event_type") == "error", "").otherwise("answer").alias("answer"), F.array(F.lit("c")).alias("contexts"), F.when(C("event_type") == "signup", "ref").alias("reference"), F.when(C("event_type") == "purchase", "boom").alias("error"), scores.alias("scores"))


@query("""SELECT 'faithfulness' AS metric, round(avg(value / 100), 9) AS mean, count(*) AS scored FROM events UNION ALL SELECT 'recall', round(avg(value / 200), 9), count(*) FROM events WHERE event_type <> 'click' UNION ALL SELECT 'unseen', NULL, 0""")
def agg7_evaluation_summary(spark, d):
    return E.evaluation_summary(_records(spark, d), ["faithfulness", "recall", "unseen"]).withColumn("mean", F.round("mean", 9))


@query("""SELECT 'faithfulness' AS metric, 0.4::DOUBLE AS floor, (SELECT avg(value / 100) FROM events) >= 0.4 AS passed UNION ALL SELECT 'recall', 0.9, (SELECT avg(value / 200) FROM events WHERE event_type <> 'click') >= 0.9 UNION ALL SELECT 'unseen', 0.0, false""")
def agg8_gate(spark, d):
    floors = spark.createDataFrame([("faithfulness", 0.4), ("recall", 0.9), ("unseen", 0.0)], "metric string, floor double")
    return E.gated(agg7_evaluation_summary(spark, d), floors).drop("mean")


@query("""SELECT event_id, 'faithfulness' AS metric FROM events WHERE event_type NOT IN ('error', 'purchase') UNION ALL SELECT event_id, 'recall' FROM events WHERE event_type = 'signup'""")
def agg9_applicable(spark, d):
    return E.applicable(_records(spark, d), {"faithfulness": False, "recall": True}).select("event_id", "metric")


@query("""WITH a AS (SELECT doc_id, source, sha256(text) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS first_id FROM a GROUP BY ALL) SELECT doc_id AS asset_id, first_id FROM a JOIN f USING (source, h) WHERE doc_id <> first_id""")
def join13_duplicates(spark, d):
    assets = table(spark, d, "documents").select(C("doc_id").alias("asset_id"), C("source").alias("project_id"), F.sha2(C("text").cast("binary"), 256).alias("content_hash"))
    return O.duplicates(assets).select("asset_id", "first_id")


@query(f"""SELECT c_custkey AS asset_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT project_id FROM {_TASKS} WHERE status = 'QUEUED' AND value > 60)
AND c_custkey IN (SELECT project_id FROM {_TASKS} WHERE status IN ('FAILURE', 'DEAD'))""")
def join14_failed_husks(spark, d):
    tasks = _tasks(spark, d).where("status in ('FAILURE', 'DEAD') or (status = 'QUEUED' and value > 60)").select(C("project_id").alias("asset_id"), "status")
    return O.failed_husks(table(spark, d, "customer").select(C("c_custkey").alias("asset_id")), table(spark, d, "orders").select(C("o_custkey").alias("asset_id")), tasks)


@query("""SELECT n_regionkey AS owner, l_orderkey AS id, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def join15_access(spark, d):
    chain = [(table(spark, d, "nation"), "n_nationkey", "n_regionkey"), (table(spark, d, "customer"), "c_custkey", "c_nationkey"), (table(spark, d, "orders"), "o_orderkey", "o_custkey"), (table(spark, d, "lineitem"), "l_orderkey", "l_orderkey")]
    return O.access(chain).groupBy("owner", "id").agg(F.count("*").alias("n"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_name""")
def join16_cascade_counts(spark, d):
    """JOIN16: what goes with each nation's customers, counted level by level before the joins widen."""
    lines = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    orders = table(spark, d, "orders").join(lines, "o_orderkey", "left").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"))
    customers = table(spark, d, "customer").join(orders, "c_custkey", "left").groupBy(C("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "nation").join(customers, "n_nationkey", "left").select("n_name", zero("customers"), zero("orders"), zero("lines"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def join21_user_sources(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), C("o_custkey") == C("c_custkey")).select("c_custkey", "o_orderkey")


@query(f"""SELECT project_id AS task_id, arg_max(status, (ts, event_id)) AS status, min(ts) FILTER (status = 'STARTED') AS started_at, max(ts) FILTER (status IN ('SUCCESS', 'FAILURE', 'DEAD')) AS completed_at FROM {_TASKS} GROUP BY project_id""")
def str6_task_state(spark, d):
    events = _tasks(spark, d).withColumns({"task_id": C("project_id"), "stage": C("task_name"), "done": C("value")})
    return L.task_state(events).select("task_id", "status", "started_at", "completed_at")


@query(f"""WITH n AS (SELECT max(ts) AS now FROM events), a AS (SELECT *, epoch(date_trunc('second', (SELECT now FROM n)) - date_trunc('second', ts)) AS age FROM {_TASKS})
SELECT CASE WHEN (status = 'STARTED' AND age > 172800) OR (status = 'QUEUED' AND age > 604800) THEN 'DEAD' ELSE status END AS status, count(*) AS n FROM a WHERE NOT (status IN ('SUCCESS', 'FAILURE', 'DEAD') AND age > 604800) GROUP BY 1""")
def str7_sweep(spark, d):
    now = F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])
    return L.swept(_tasks(spark, d), now, 86400, 604800).groupBy("status").agg(F.count("*").alias("n"))


_NEWEST = f"""(SELECT project_id AS task_id, arg_max(status, (ts, event_id)) AS status, max(epoch_us(ts)) AS changed_at, min(epoch_us(ts)) FILTER (status = 'STARTED') AS started_at,
  max(epoch_us(ts)) FILTER (status IN ('SUCCESS', 'FAILURE', 'DEAD')) AS completed_at FROM {_TASKS} GROUP BY project_id)"""


@query(f"""WITH w AS (SELECT max(epoch_us(ts)) // 1000 AS wm FROM events),
due AS (SELECT *, status IN ('SUCCESS', 'FAILURE', 'DEAD') AS final, changed_at // 1000 + CASE status WHEN 'STARTED' THEN 7200000 ELSE 21600000 END AS due FROM {_NEWEST}, w)
SELECT task_id, CASE WHEN due <= wm THEN 'DEAD' ELSE status END AS status, CASE WHEN due <= wm THEN 1000 * due ELSE changed_at END AS changed_at, started_at, CASE WHEN due <= wm THEN 1000 * due ELSE completed_at END AS completed_at
FROM due WHERE due > wm OR (NOT final AND due + 21600000 > wm)""")
def str7_sweep_stream(spark, d):
    """The events as a stream, the watermark as its clock: tasks that fell silent are dead or gone."""
    def build(events):
        status = F.when(C("event_type") == "view", "QUEUED").when(C("event_type") == "click", "STARTED").when(C("event_type") == "error", "FAILURE").when(C("event_type") == "purchase", "SUCCESS").otherwise("DEAD")
        return S.task_clock(events.select(C("user_id").alias("task_id"), "event_id", C("ts").cast("timestamp").alias("ts"), status.alias("status")), 3600, 21600)

    return S.newest_states(once.streamed(spark, f"{d}/events.parquet", build))


@query(f"""WITH f AS (SELECT project_id, min(event_id) FILTER (status = 'FAILURE') AS f FROM {_TASKS} GROUP BY project_id)
SELECT event_id, CASE WHEN event_id > f THEN 'DEAD' ELSE status END AS status FROM {_TASKS} t JOIN f USING (project_id)""")
def str8_abandoned(spark, d):
    chain = _tasks(spark, d).select("event_id", C("project_id").alias("chain_id"), C("event_id").alias("pos"), "status")
    return L.abandoned(chain).select("event_id", "status")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
c AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND CURRENT ROW) AS failures FROM r) SELECT user_id, event_id, CAST(failures AS BIGINT) AS failures FROM c WHERE NOT ok AND failures >= 5""")
def str9_locked_logins(spark, d):
    return L.locked_logins(table(spark, d, "events").select("user_id", "event_id", C("ts").cast("timestamp").alias("ts"), (C("event_type") == "purchase").alias("ok")), 864000)


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
c AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND CURRENT ROW) AS failures FROM r)
SELECT user_id, event_id, CAST(failures AS BIGINT) AS failures FROM c WHERE NOT ok AND failures >= 5 AND epoch_us(ts) // 1000 + 1 < (SELECT max(epoch_us(ts)) // 1000 FROM events)""")
def str9_locked_stream(spark, d):
    """The events as a stream: what the watermark, in the end the last event, has passed is decided."""
    def build(events):
        return S.locks(events.select("user_id", "event_id", C("ts").cast("timestamp").alias("ts"), (C("event_type") == "purchase").alias("ok")), 5, 864000, "0 seconds")

    return once.streamed(spark, f"{d}/events.parquet", build)


@query("""SELECT s.start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL '1 hour', ts::TIMESTAMP), time_bucket(INTERVAL '1 hour', ts::TIMESTAMP) - INTERVAL '1 hour']) AS start FROM events) s GROUP BY ALL""")
def str10_rolling(spark, d):
    events = table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp_ntz"))
    return L.rolling(events, "2 hours", "1 hour").withColumn("mean_value", F.round("mean_value", 6))


@query(f"""SELECT task_name, args_hash, min(task_id) AS task_id FROM (SELECT *, first_value(task_id) OVER (PARTITION BY task_name, args_hash ORDER BY ts, task_id) AS f FROM {_TASKS}) WHERE task_id = f GROUP BY ALL""")
def str11_suppressed(spark, d):
    """STR11: the first of each equal call."""
    return L.first_of(_tasks(spark, d), ["task_name", "args_hash"], ["ts", "task_id"]).select("task_name", "args_hash", "task_id")


@query("""SELECT user_id AS answer_id, (min(epoch_us(ts)) FILTER (event_type = 'click') - min(epoch_us(ts))) / 1e6 AS first_token_s, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS total_s, count(*) FILTER (event_type = 'click') AS deltas, bool_or(event_type = 'error') AS error FROM events GROUP BY user_id""")
def str12_answer_times(spark, d):
    events = table(spark, d, "events").select(C("user_id").alias("answer_id"), C("ts").cast("timestamp").alias("ts"), F.when(C("event_type") == "click", "delta").otherwise(C("event_type")).alias("type"))
    return L.answer_times(events)
