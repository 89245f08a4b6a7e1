"""Queries over joins, windows, snapshots, samples, state and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheaf.operators import access, lexical, retrieval, sampling, sets, state
from sheaf.plans.registry import query, table


@query("join_bridge", "SELECT l_orderkey, l_linenumber, p_name, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10")
def join_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return li.join(part.where("p_size < 10"), F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "p_name", "o_orderpriority")


@query("join_left_count", "SELECT c_custkey, count(o_orderkey) AS n_orders, max(o_orderdate) AS last_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"), F.max("o_orderdate").alias("last_order"))
    return table(spark, sf_dir, "customer").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "last_order")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND year(o_orderdate) = 1996)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and year(o_orderdate) = 1996")
    return table(spark, sf_dir, "customer").join(wanted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("join_full_outer", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality, a.toxic, b.n_chars FROM labels a FULL JOIN documents b ON a.doc_id = b.doc_id")
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "full")


@query("join_full_outer_whole", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality, b.n_chars FROM labels a FULL JOIN documents b ON a.doc_id = b.doc_id")
def join_full_outer_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "full")


@query("join_two_keys", "SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS matched, CASE WHEN a.c_custkey IS NOT NULL THEN 'id' WHEN b.c_custkey IS NOT NULL THEN 'key' END AS how FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS k1, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS k2 FROM orders) o LEFT JOIN customer a ON a.c_custkey = o.k1 LEFT JOIN customer b ON b.c_name = o.k2")
def join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("k1"), F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("k2"))
    customer = table(spark, sf_dir, "customer")
    by_id, by_key = customer.select(F.col("c_custkey").alias("a"), F.col("c_custkey").alias("k1")), customer.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("k2"))
    return orders.join(by_id, "k1", "left").join(by_key, "k2", "left").select("o_orderkey", F.coalesce("a", "b").alias("matched"), F.when(F.col("a").isNotNull(), "id").when(F.col("b").isNotNull(), "key").alias("how"))


@query("join_missing_keys", "SELECT k AS wanted FROM (SELECT unnest(range(0, 400, 3))::BIGINT AS k) WHERE k NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def join_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 400, 3).withColumnRenamed("id", "wanted")
    return wanted.join(table(spark, sf_dir, "part").where("p_size > 5"), F.col("p_partkey") == F.col("wanted"), "left_anti")


@query("join_versions", "SELECT a.o_orderstatus || '->' || b.o_orderstatus AS change, count(*) AS n FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 GROUP BY 1")
def join_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("x"))
    b = a.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("x").alias("y"))
    return a.join(b, "o_orderkey").groupBy(F.concat("x", F.lit("->"), "y").alias("change")).agg(F.count("*").alias("n"))


@query("first_per_key", "SELECT * EXCLUDE (r) FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc_nulls_last("o_totalprice"), "o_orderkey"])


@query("sequence_per_key", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, (turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id)) IS TRUE AND role = 'user' AS active FROM conversations")
def sequence_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = state.active_attachment(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return turns.select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("seq"), F.coalesce("active", F.lit(False)).alias("active"))


@query("budget_page", "SELECT conv_id, turn, CASE WHEN rn = 1 AND used > 600 THEN text[1:600] ELSE text END AS text FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE used <= 600 OR rn = 1")
def budget_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page_by_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 600)


@query("trailing_attempts", "SELECT event_id, count(*) OVER w AS failures, count(*) OVER w >= 3 AS locked FROM events WHERE event_type IN ('error', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)")
def trailing_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.attempts(table(spark, sf_dir, "events").where("event_type in ('error', 'click')"), "user_id", "ts", 86400, 3).select("event_id", "failures", "locked")


@query("escaped_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || '_50%'), '_50%') ORDER BY p_partkey LIMIT 20 OFFSET 10")
def escaped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sheaf.functions.text import like_escape

    needle = F.concat(F.lit("%"), like_escape(F.lit("_50%")), F.lit("%"))
    return table(spark, sf_dir, "part").where(F.call_function("like", F.lower(F.concat("p_name", F.lit("_50%"))), needle)).orderBy("p_partkey").offset(10).limit(20).select("p_partkey", "p_name")


@query("row_page", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i BETWEEN 101 AND 300")
def row_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").offset(100).limit(200).select("o_orderkey", "o_totalprice")


OLD = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_custkey % 17 > 0 AS is_active FROM customer WHERE c_custkey % 10 > 0"
NEW = "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 12 > 0"
ACTION = "CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL AND NOT o.is_active THEN 'leave' WHEN n.c_custkey IS NULL THEN 'deactivate' WHEN NOT o.is_active THEN 'reactivate' WHEN (o.c_name, o.c_nationkey, o.c_mktsegment) IS DISTINCT FROM (n.c_name, n.c_nationkey, n.c_mktsegment) THEN 'update' ELSE 'touch' END"


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    old = customer.where(key % 10 > 0).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", (key % 17 > 0).alias("is_active"))
    new = customer.where(key % 12 > 0).select("c_custkey", "c_name", F.when(key % 4 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    return old, new


@query("reconcile", f"SELECT action, count(*) AS n FROM (SELECT {ACTION} AS action FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.c_custkey = n.c_custkey) GROUP BY 1")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return sets.reconcile(old, new, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]).groupBy("action").agg(F.count("*").alias("n"))


@query("reconcile_apply", f"SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_nationkey ELSE o.c_nationkey END AS c_nationkey, n.c_custkey IS NOT NULL AS is_active FROM ({OLD}) o FULL JOIN ({NEW}) n ON o.c_custkey = n.c_custkey")
def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    actions = sets.reconcile(old, new, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])
    return sets.apply_actions(old, new, actions, "c_custkey").select("c_custkey", "c_nationkey", "is_active")


@query("reconcile_guard", f"SELECT CASE action WHEN 'deactivate' THEN 'retain' ELSE action END AS action, count(*) AS n FROM (SELECT {ACTION} AS action FROM ({OLD}) o FULL JOIN (SELECT * FROM ({NEW}) WHERE c_custkey % 3 = 1) n ON o.c_custkey = n.c_custkey) GROUP BY 1")
def reconcile_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(spark, sf_dir)
    return sets.reconcile(old, new.where("c_custkey % 3 = 1"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]).groupBy("action").agg(F.count("*").alias("n"))


@query("upsert", "SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_totalprice ELSE o.o_totalprice END AS o_totalprice, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 3 > 0) o FULL JOIN (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_orderkey % 4 > 0 THEN 'X' END AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0) n ON n.o_orderkey = o.o_orderkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = orders.where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderkey") % 4 > 0, "X").alias("o_orderstatus"))
    return sets.upsert(orders.where("o_orderkey % 3 > 0"), new, ["o_orderkey"], preserve=["o_orderstatus"])


@query("supersession", "WITH d AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'ready' END AS status FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, status ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM d) SELECT o_orderkey, CASE WHEN status = 'pending' THEN 'pending' WHEN r = 1 THEN 'live' ELSE 'archived' END AS outcome FROM m")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("ready").alias("status"))
    return sets.supersede(docs, ["o_custkey"], order=["o_orderdate", "o_orderkey"]).select("o_orderkey", "outcome")


@query("rule_violations", "SELECT 'unique text' AS rule, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM documents WHERE lang = 'en' GROUP BY text HAVING count(*) > 1) UNION ALL SELECT 'short', count(*) FILTER (n_chars > 5000) FROM documents UNION ALL SELECT 'counted', count(*) FILTER (n_chars <> length(text)) FROM documents UNION ALL SELECT 'labelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.violations(table(spark, sf_dir, "documents"), unique={"unique text": (["text"], "lang = 'en'")}, checks={"short": "n_chars <= 5000", "counted": "n_chars = length(text)"}, foreign={"labelled": ("doc_id", table(spark, sf_dir, "labels"), "doc_id")})


@query("hash_draw", "SELECT o_orderkey, o_orderpriority, place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('draw' || chr(31) || 's1' || chr(31) || o_orderkey), o_orderkey)::INT AS place FROM orders) WHERE place <= 25")
def hash_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.draw(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 25, namespace="draw", seed="s1")


@query("stratified_sample")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("cohort"), F.col("p_type").alias("kind"))
    return sampling.stratified(part, ["cohort", "kind"], "p_partkey", 120, floor=2, share="0.06")


@query("job_states", "WITH j AS (SELECT user_id, CASE last(event_type ORDER BY ts, event_id) WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'idle' END AS status FROM events GROUP BY 1) SELECT user_id % 20 AS run, count(*) FILTER (status IN ('queued', 'running')) AS open, count(*) FILTER (status = 'succeeded') AS good, count(*) FILTER (status = 'failed') AS bad, CASE WHEN count(*) FILTER (status IN ('queued', 'running')) > 0 THEN 'awaiting_jobs' WHEN count(*) FILTER (status = 'failed') > 0 AND count(*) FILTER (status = 'succeeded') > 0 THEN 'partial' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' ELSE 'succeeded' END AS run_status FROM j GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = state.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])
    names = F.create_map(*[F.lit(x) for kv in {"signup": "queued", "click": "running", "purchase": "succeeded", "error": "failed"}.items() for x in kv])
    jobs = last.select((F.col("user_id") % 20).alias("run"), F.coalesce(names[F.col("event_type")], F.lit("idle")).alias("status"))
    return state.run_status(jobs, "run", F.lit(0))


@query("queue_claim", "SELECT event_id AS job_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 5")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "signup", "queued").otherwise("done").alias("status"))
    return state.claim(jobs, 5).select("job_id")


@query("stale_jobs", "SELECT event_id AS job_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 600 SECOND")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    jobs = events.where("event_type = 'click'").select(F.col("event_id").alias("job_id"), F.col("ts").alias("heartbeat_at"), F.lit("running").alias("status"))
    now = events.agg(F.max("ts").alias("now"))
    return state.stale(jobs.crossJoin(F.broadcast(now)), F.col("now"), 600).select("job_id")


@query("repeated_calls", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) > 1 AS repeated FROM events")
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.repeats(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.concat_ws("|", "event_type", "props")).select("event_id", "repeated")


@query("delta_fold", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS arguments, arg_max(turn::VARCHAR, turn) FILTER (turn % 2 = 0) AS id FROM conversations GROUP BY 1, 2")
def delta_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.col("text").alias("arguments"), F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("id"), F.lit("f").alias("name"))
    return state.fold_deltas(deltas, ["conv_id", "role"], "turn").select("conv_id", "role", "arguments", "id")


@query("grant_refusals", f"SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 3 <> 2 THEN 'Owner access to this department is required' WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN '{access.MAKES_OWNER}' WHEN n_nationkey % 11 = 0 THEN '{access.TOUCHES_OWNER.replace(chr(39), chr(39) * 2)}' END AS refusal, CASE WHEN n_nationkey % 7 = 0 THEN 'owner' ELSE ['viewer', 'editor', 'owner'][n_nationkey % 3 + 1] END AS level FROM nation")
def grant_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    own = F.element_at(F.array(*map(F.lit, access.LEVELS)), (k % 3 + 1).cast("int"))
    refusal = access.refusal(access.MEMBERSHIP, caller=own, admin=k % 7 == 0, wanted=F.when(k % 2 == 0, "owner").otherwise("editor"), held=F.when(k % 11 == 0, "owner"), own=k % 5 == 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", refusal.alias("refusal"), access.standing(own, k % 7 == 0).alias("level"))


@query("scoped_rows", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0)")
def scoped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("user_id"), F.when(F.col("n_nationkey") % 2 == 0, "editor").otherwise("viewer").alias("role"))
    return access.scoped(table(spark, sf_dir, "customer"), grants, 2, "editor", department="c_nationkey").select("c_custkey")


@query("owned_rows", "SELECT o.o_orderkey, b.o_totalprice, b.o_orderkey IS NOT NULL AS found FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 45) o LEFT JOIN (SELECT * FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) b USING (o_orderkey)")
def owned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    first = orders.agg(F.min("o_custkey").alias("least"))
    mine = orders.join(F.broadcast(first), F.col("o_custkey") == F.col("least")).withColumn("user_id", F.lit(0))
    wanted = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return access.owned(mine, wanted, 0, key="o_orderkey").select("o_orderkey", "o_totalprice", "found")


DENSE = "SELECT vec_id AS id, 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS distance FROM embeddings"


@query("dense_search", f"SELECT id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, id)::INT AS dense_rank FROM ({DENSE} ORDER BY distance, id LIMIT 25)")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    q = emb.where("vec_id = 7").select("embedding")
    return retrieval.dense(emb, q, 25, id_col="vec_id", vector="embedding").withColumn("distance", F.round("distance", 6))


LEX = """w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains([{stop}], x)) AS w FROM documents),
c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'tion')) AS t0, len(list_filter(w, lambda x: x = 'nd')) AS t1 FROM w),
s AS (SELECT count(*) AS d, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
lex AS (SELECT id, round(((1 + ln(t0)) * ln((d + 1) / d0) + (1 + ln(t1)) * ln((d + 1) / d1)) / (1 + ln(n)), 9) AS score FROM c, s WHERE t0 > 0 AND t1 > 0)""".format(stop=", ".join(f"'{w}'" for w in retrieval.STOPWORDS))


@query("lexical_search", f"WITH {LEX} SELECT id, round(score, 6) AS lexical_score, row_number() OVER (ORDER BY score DESC, id)::INT AS lexical_rank FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 30)")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(table(spark, sf_dir, "documents"), "The tion, and ND", 30, id_col="doc_id", text="text").withColumn("lexical_score", F.round("lexical_score", 6))


@query("hybrid_search", f"WITH {LEX}, e AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS dr FROM ({DENSE} ORDER BY distance, id LIMIT 30)), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lr FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 30)), f AS (SELECT coalesce(e.id, l.id) AS id, dr, lr, round(coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0), 12) AS rrf FROM e FULL JOIN l ON e.id = l.id) SELECT id, dr::INT AS dense_rank, lr::INT AS lexical_rank, rrf, row_number() OVER (ORDER BY rrf DESC, id)::INT AS rrf_rank FROM f ORDER BY rrf DESC, id LIMIT 20")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    q = emb.where("vec_id = 7").select("embedding")
    fused = retrieval.fuse(retrieval.dense(emb, q, 30, id_col="vec_id", vector="embedding"), retrieval.lexical(table(spark, sf_dir, "documents"), "The tion, and ND", 30, id_col="doc_id", text="text"), 20)
    return fused.select("id", "dense_rank", "lexical_rank", "rrf", "rrf_rank")


STEM = "CASE WHEN regexp_matches({0}, 'ies$') AND NOT regexp_matches({0}, '[ea]ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, 'es$') AND NOT regexp_matches({0}, '[aeo]es$') THEN regexp_replace({0}, 'es$', 'e') WHEN regexp_matches({0}, 's$') AND NOT regexp_matches({0}, '[us]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"
COVERS = """words AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)),
places AS (SELECT id, {stem} AS term, pos FROM words WHERE NOT list_contains([{stop}], word)),
entries AS (SELECT q, k, t, id, pos, row_number() OVER (PARTITION BY q, id ORDER BY pos) AS i FROM asked JOIN places USING (term)),
lasts AS (SELECT q, id, pos, i, max(CASE WHEN t = 0 THEN pos END) OVER w AS p0, max(CASE WHEN t = 1 THEN pos END) OVER w AS p1, max(CASE WHEN t = 0 THEN i END) OVER w AS i0, max(CASE WHEN t = 1 THEN i END) OVER w AS i1 FROM entries WINDOW w AS (PARTITION BY q, id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT q, id, pos - least(p0, p1) - (i - least(i0, i1)) AS noise, least(p0, p1) AS b, lag(least(p0, p1)) OVER (PARTITION BY q, id ORDER BY pos) AS before FROM lasts WHERE p0 IS NOT NULL AND p1 IS NOT NULL),
lex AS (SELECT q, id, round(sum(0.1::DOUBLE / (1 + noise)), 9) AS score FROM ends WHERE before IS NULL OR b > before GROUP BY q, id)""".format(stem=STEM.format("word"), stop=", ".join(f"'{w}'" for w in retrieval.STOPWORDS))
PAIRS = """texts AS (SELECT item_id, list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: NOT list_contains([{stop}], x)), lambda x: {stem}) AS w FROM benchmark),
pairs AS (SELECT item_id * 100000 + i AS q, w[i] AS x, w[i + 1] AS y FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM texts) WHERE w[i] <> w[i + 1]),
asked AS (SELECT q, 2 AS k, t, CASE t WHEN 0 THEN x ELSE y END AS term FROM pairs, (SELECT unnest([0, 1]) AS t))""".format(stem=STEM.format("x"), stop=", ".join(f"'{w}'" for w in retrieval.STOPWORDS))


def word_pairs(benchmark: DataFrame) -> DataFrame:
    """A query for each two neighbouring different words of each item."""
    w = benchmark.select("item_id", lexical.terms(F.col("text"), lambda w: w).alias("w")).where("size(w) > 1")
    at = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    pairs = at.select((F.col("item_id") * 100000 + F.col("i")).alias("query_id"), F.element_at("w", F.col("i")).alias("x"), F.element_at("w", F.col("i") + 1).alias("y"))
    return pairs.where(lexical.singular(F.col("x")) != lexical.singular(F.col("y"))).select("query_id", F.concat_ws(" ", "x", "y").alias("text"))


@query("cover_search", f"WITH {PAIRS}, {COVERS} SELECT q AS query_id, id, score AS lexical_score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS lexical_rank FROM lex QUALIFY lexical_rank <= 5")
def cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.postings(table(spark, sf_dir, "documents"), id_col="doc_id", text="text")
    return lexical.search(index, word_pairs(table(spark, sf_dir, "benchmark")), 5)


@query("hybrid_cover_search", f"WITH asked AS (SELECT 0 AS q, 2 AS k, t, CASE t WHEN 0 THEN 'tion' ELSE 'nd' END AS term FROM (SELECT unnest([0, 1]) AS t)), {COVERS}, e AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS dr FROM ({DENSE} ORDER BY distance, id LIMIT 30)), l AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lr FROM (SELECT * FROM lex ORDER BY score DESC, id LIMIT 30)), f AS (SELECT coalesce(e.id, l.id) AS id, dr, lr, round(coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0), 12) AS rrf FROM e FULL JOIN l ON e.id = l.id) SELECT id, dr::INT AS dense_rank, lr::INT AS lexical_rank, rrf, row_number() OVER (ORDER BY rrf DESC, id)::INT AS rrf_rank FROM f ORDER BY rrf DESC, id LIMIT 20")
def hybrid_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    near = retrieval.dense(emb, emb.where("vec_id = 7").select("embedding"), 30, id_col="vec_id", vector="embedding")
    query = spark.createDataFrame([(0, "The tion, and ND")], "query_id int, text string")
    found = lexical.search(lexical.postings(docs, id_col="doc_id", text="text"), query, 30).drop("query_id")
    return retrieval.fuse(near, found, 20).select("id", "dense_rank", "lexical_rank", "rrf", "rrf_rank")


SCORED = "SELECT conv_id, turn, turn + 1 AS rrf_rank, (('0x' || sha256(conv_id || ':' || turn)[1:4])::INT % 1000) / 1000.0::DOUBLE AS score FROM conversations"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), 256), 1, 4), 16, 10).cast("int")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("rrf_rank"), (h % 1000 / 1000.0).alias("score"))


@query("rank_decision", f"SELECT conv_id, turn, score, score >= 0.6 AND row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, rrf_rank) <= 2 AS kept, NOT max(score >= 0.6) OVER (PARTITION BY conv_id) AS abstained FROM ({SCORED})")
def rank_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.decide(scored(spark, sf_dir), threshold=0.6, top_k=2, by=["conv_id"]).select("conv_id", "turn", "score", "kept", "abstained")


@query("threshold_sweep", f"SELECT t AS threshold, count(*) FILTER (best >= t) AS answered, count(*) FILTER (best < t) AS abstained FROM (SELECT conv_id, max(score) AS best FROM ({SCORED}) GROUP BY 1), (SELECT unnest(range(1, 10)) / 10.0::DOUBLE AS t) GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = scored(spark, sf_dir).groupBy("conv_id").agg(F.max("score").alias("best"))
    grid = F.explode(F.array(*[F.lit(i / 10.0) for i in range(1, 10)]))  # nine thresholds in one pass
    return best.select("best", grid.alias("threshold")).groupBy("threshold").agg(F.count_if(F.expr("best >= threshold")).alias("answered"), F.count_if(F.expr("best < threshold")).alias("abstained"))


@query("source_rollup", "SELECT user_id AS turn_id, event_type AS document_id, min(event_id) AS ord, list_aggregate(list_transform(list_sort(list(DISTINCT (value * 10)::INT)), lambda x: x::VARCHAR), 'string_agg', ',') AS pages, bool_or(value > 95) AS any_recovered, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id), event_type)::INT AS place FROM (SELECT user_id, event_type, event_id, floor(value / 10) / 10 AS value FROM events) GROUP BY 1, 2")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.floor(F.col("value") / 10) / 10).alias("value"))
    return retrieval.sources(e.select(F.col("user_id").alias("turn_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("document_id"), F.round(F.col("value") * 10).cast("int").alias("page"), (F.col("value") > 95).alias("recovered")))
