"""Upserts, change capture, reconciliation, ledgers and streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.operators import upsert
from souk.plans.base import PRODUCTS, products, query
from souk.plans.base import suppliers as catalogue_suppliers
from souk.plans.catalogue import CFG, SCORED
from souk.session import scratch
from souk.sources.pages import read_table
from souk.sources.store import Store
from souk.streaming import ingest

TRACKED = ["o_orderstatus", "price"]


def before(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return o.withColumn("fingerprint", upsert.fingerprint(o, TRACKED))


def after(spark, d):
    """Every eleventh row gone, every seventh dearer, every ninth of another status, some new."""
    k = F.col("o_orderkey")
    o = read_table(spark, d, "orders").where(k % 11 != 0).select("o_orderkey", F.when(k % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_totalprice").cast("decimal(18,2)") + F.when(k % 7 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("price"))
    o = o.unionByName(o.where(k % 101 == 1).withColumn("o_orderkey", -k - 1))
    return o.withColumn("fingerprint", upsert.fingerprint(o, TRACKED))


SNAPS = """a AS (SELECT o_orderkey, o_orderstatus, o_totalprice::DECIMAL(18,2) AS price FROM orders),
b0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, (o_totalprice::DECIMAL(18,2) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS price FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT * FROM b0 UNION ALL SELECT -o_orderkey - 1, o_orderstatus, price FROM b0 WHERE o_orderkey % 101 = 1),
u AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'untouched' WHEN a.o_orderkey IS NULL THEN 'created' WHEN a.o_orderstatus = b.o_orderstatus AND a.price = b.price THEN 'unchanged' ELSE 'updated' END AS _action,
 coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.price, a.price) AS price, a.price AS old_price, a.o_orderstatus AS old_status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"""


def merged(spark, d):
    return upsert.upsert(before(spark, d), after(spark, d), "o_orderkey", "fingerprint", TRACKED)


@query(f"WITH {SNAPS} SELECT o_orderkey, _action, o_orderstatus, price FROM u")
def up1_up10_upsert(spark, d):
    return merged(spark, d).drop("fingerprint")


# every thirteenth row was archived before; what is seen again is active, and keeps its selection status
BACK_SQL = "SELECT o_orderkey, CASE WHEN old AND _action = 'unchanged' THEN 'updated' ELSE _action END AS _action, NOT (old AND _action = 'untouched') AS active, CASE WHEN old THEN 'Archived' ELSE 'Not Selected' END AS selection_status FROM (SELECT *, o_orderkey >= 0 AND o_orderkey % 13 = 0 AS old FROM u)"


@query(f"WITH {SNAPS} {BACK_SQL}")
def up10_reactivation(spark, d):
    """Archived rows that are seen again become active; their selection status stays Archived."""
    gone = F.col("o_orderkey") % 13 == 0
    old = before(spark, d).select("o_orderkey", *TRACKED, F.when(gone, "archived").otherwise(F.col("fingerprint")).alias("fingerprint"), (~gone).alias("active"), F.when(gone, "Archived").otherwise("Not Selected").alias("selection_status"))
    out = upsert.upsert(old, after(spark, d), "o_orderkey", "fingerprint", TRACKED, create={"selection_status": F.lit("Not Selected")}, touch={"active": F.lit(True)})
    return out.select("o_orderkey", "_action", "active", "selection_status")


@query("SELECT o_orderkey, o_orderstatus, 'New' AS review_status, o_orderkey % 11 <> 0 AS touched FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END, CASE WHEN o_orderkey % 9 = 0 THEN 'Needs Rescore' ELSE 'Scored' END, o_orderkey % 11 <> 0 FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 11 <> 0 UNION ALL SELECT o_orderkey, o_orderstatus, 'Scored', false FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 11 = 0".replace("'New' AS review_status, o_orderkey % 11 <> 0 AS touched FROM orders WHERE o_orderkey % 2 = 0", "'New' AS review_status, true AS touched FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 11 <> 0)"))
def pj7_stored_record(spark, d):
    """Stored rows of odd orders meet all orders seen: what is set on creation, on change and on every sight."""
    old = before(spark, d).where("o_orderkey % 2 = 1").withColumns({"review_status": F.lit("Scored"), "last_seen": F.lit("t0")})
    new = after(spark, d).where("o_orderkey >= 0").withColumn("price", F.lit(0).cast("decimal(18,2)"))
    old = old.withColumn("price", F.lit(0).cast("decimal(18,2)"))
    old, new = (x.withColumn("fingerprint", upsert.fingerprint(x, TRACKED)) for x in (old, new))
    out = upsert.store_records(old, new, "o_orderkey", "fingerprint", TRACKED, initial={"review_status": "New"}, on_change={"review_status": "Needs Rescore"}, seen={"last_seen": "t1"})
    return out.select("o_orderkey", "o_orderstatus", "review_status", (F.col("last_seen") == "t1").alias("touched"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1")
def up2_dedupe_last(spark, d):
    l = read_table(spark, d, "lineitem")
    return upsert.dedupe_last(l, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("SELECT p_partkey, sha256(p_name || chr(31) || least(p_brand, p_type) || chr(30) || greatest(p_brand, p_type) || chr(31) || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE chr(1) END) AS fingerprint FROM part")
def up3_up24_fingerprint(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_name", F.array("p_type", "p_brand").alias("tags"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("\x01").alias("size"))
    return upsert.index(p.withColumn("fingerprint", upsert.fingerprint(p, ["p_name", "tags", "size"])), "p_partkey", "fingerprint")


CATEGORIES = {"o_orderstatus": "Status Changed", "price": "Price Changed"}


@query(f"WITH {SNAPS} SELECT o_orderkey, CASE WHEN old_status <> o_orderstatus AND old_price <> price THEN 'o_orderstatus,price' WHEN old_price <> price THEN 'price' ELSE 'o_orderstatus' END AS changed_fields, CASE WHEN old_status <> o_orderstatus AND old_price <> price THEN 'Multiple' WHEN old_price <> price THEN 'Price Changed' ELSE 'Status Changed' END AS change_type, CASE WHEN old_price <> price THEN old_price::VARCHAR END AS old_price FROM u WHERE _action = 'updated'")
def up4_changes(spark, d):
    out = upsert.detect_changes(before(spark, d), after(spark, d), "o_orderkey", "fingerprint", CATEGORIES)
    return out.select("o_orderkey", F.array_join("changed_fields", ",").alias("changed_fields"), "change_type", F.try_element_at("old_values", F.lit("price")).alias("old_price"))


@query(f"WITH {SCORED} SELECT supplier_key, CASE WHEN substr(supplier_key, 5)::BIGINT % 3 = 0 THEN 'Manually Blocked' ELSE eligibility END AS eligibility FROM scored")
def up5_supplier_overrides(spark, d):
    return _overrides(spark, d)[0].select("supplier_key", "eligibility")


def _overrides(spark, d):
    s = catalogue_suppliers(spark, d)
    bad = s.where(F.substring("supplier_key", 5, 20).cast("long") % 3 == 0).select("supplier_key", F.lit("Block").alias("override"), F.lit("me").alias("actor"))
    return upsert.apply_supplier_overrides(s, bad, CFG)


@query("SELECT 'sid:' || s_suppkey AS supplier_key, 'Block' AS decision, 'me' AS actor FROM supplier WHERE s_suppkey % 3 = 0")
def up5_override_audit(spark, d):
    return _overrides(spark, d)[1]


def _decisions(spark, d):
    o = before(spark, d)
    k = F.col("o_orderkey")
    dec = o.where(k % 5 == 0).select("o_orderkey", F.when(k % 10 == 0, "approve").otherwise("reject").alias("decision"), F.lit("me").alias("actor"), F.lit(None).cast("string").alias("note"))
    return upsert.decide(o, dec.unionByName(dec.where(k % 500 == 0).withColumn("o_orderkey", -k - 7)), "o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Manually Approved' WHEN o_orderkey % 5 = 0 THEN 'Manually Rejected' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def up6_decisions(spark, d):
    return _decisions(spark, d)[0].select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus AS previous_status, CASE WHEN o_orderkey % 10 = 0 THEN 'Manually Approved' ELSE 'Manually Rejected' END AS new_status FROM orders WHERE o_orderkey % 5 = 0")
def up6_audit(spark, d):
    return _decisions(spark, d)[1].select("o_orderkey", "previous_status", "new_status")


@query("SELECT -o_orderkey - 7 AS o_orderkey, 'approve' AS decision FROM orders WHERE o_orderkey % 500 = 0")
def jn11_decisions_without_row(spark, d):
    return _decisions(spark, d)[2]


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'Pinned' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def up7_set_status(spark, d):
    o = read_table(spark, d, "orders")
    return upsert.set_status(o, o.where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o_orderstatus", "Pinned").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Manually Rejected' ELSE 'Shortlisted' END AS status FROM orders")
def up8_preserve_manual(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "Manually Rejected").otherwise("Unscored").alias("status"))
    return upsert.preserve_manual(o, "status", F.lit("Shortlisted"))


@query("SELECT c_custkey, o IS NOT NULL OR c_mktsegment = 'BUILDING' AS active, CASE WHEN o IS NOT NULL OR c_mktsegment = 'BUILDING' THEN 'Not Selected' ELSE 'Archived' END AS selection_status FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01') ON o = c_custkey")
def up9_reconcile(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(True).alias("active"), F.lit("Not Selected").alias("selection_status"), F.lit("f").alias("fingerprint"))
    seen = upsert.since(read_table(spark, d, "orders"), "o_orderdate", "1998-12-31 23:59:59").select(F.col("o_custkey").alias("c_custkey"))
    return upsert.reconcile(c, seen, "c_custkey", True, F.col("c_mktsegment") != "BUILDING").select("c_custkey", "active", "selection_status")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jn4_missing_keys(spark, d):
    urgent = read_table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return upsert.missing_keys(read_table(spark, d, "customer"), urgent, "c_custkey", "o_custkey").select("c_custkey")


@query("WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT 'both' AS kind, k FROM (SELECT k FROM c INTERSECT SELECT k FROM o) UNION ALL SELECT 'first', k FROM (SELECT k FROM c EXCEPT SELECT k FROM o) UNION ALL SELECT 'any', k FROM (SELECT k FROM c UNION SELECT k FROM o)")
def st1_key_sets(spark, d):
    c = read_table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    o = read_table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return upsert.key_sets(c, o, "k")


@query(f"WITH {SNAPS} SELECT o_orderkey FROM b EXCEPT SELECT o_orderkey FROM a")
def up11_new_keys(spark, d):
    return upsert.new_keys(before(spark, d), after(spark, d), "o_orderkey")


def _walk(spark, d):
    """Events as landed pages of 100; the user is the key, known if divisible by 3 (all, from page 40 on)."""
    e = read_table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 100).alias("page"), (F.col("event_id") % 100).alias("pos"))
    known = e.where((F.col("user_id") % 3 == 0) | (F.col("page") >= 40)).select("user_id")
    return e, known


@query("""WITH e AS (SELECT event_id, user_id, event_id // 100 AS page, event_id % 100 AS pos FROM events),
k AS (SELECT DISTINCT user_id FROM e WHERE user_id % 3 = 0 OR page >= 40), f AS (SELECT user_id, min(page) AS first FROM e GROUP BY 1),
m AS (SELECT e.*, (k.user_id IS NULL AND f.first = e.page) AS is_new FROM e LEFT JOIN k ON e.user_id = k.user_id JOIN f ON e.user_id = f.user_id),
r AS (SELECT *, event_id - coalesce(max(CASE WHEN is_new THEN event_id END) OVER (ORDER BY event_id), -1) AS run FROM m),
p AS (SELECT page, arg_max(run, event_id) AS run, count(*) FILTER (is_new) AS news FROM r GROUP BY 1),
q AS (SELECT *, page - coalesce(max(CASE WHEN news > 0 THEN page END) OVER (ORDER BY page), -1) AS fullpages FROM p),
c AS (SELECT min(page) AS cut FROM q WHERE run >= 250 OR fullpages >= 5)
SELECT event_id FROM e, c WHERE cut IS NULL OR page <= cut""")
def up12_early_stop(spark, d):
    e, known = _walk(spark, d)
    return upsert.early_stop(e, known, "user_id", "page", "pos", 250, 5).select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN 'Incomplete' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'Verified Incremental' WHEN o_orderkey % 2 = 0 THEN 'Unverified Incremental' ELSE 'Complete' END AS completeness FROM orders")
def up13_completeness_status(spark, d):
    k = F.col("o_orderkey")
    s = F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed")
    return read_table(spark, d, "orders").select("o_orderkey", upsert.completeness_status(s, k % 3 == 0, k % 2 == 0).alias("completeness"))


@query(f"WITH {SNAPS} SELECT 'r1' AS run_id, 'c1' AS config_hash, '1' AS version, count(*) FILTER (_action <> 'untouched') AS seen, count(*) FILTER (_action = 'created') AS created, count(*) FILTER (_action = 'updated') AS updated, count(*) FILTER (_action = 'unchanged') AS unchanged FROM u")
def up14_run_counts(spark, d):
    return upsert.run_counts(merged(spark, d), "r1", "c1", "1")


LEDGER_SQL = "l AS (SELECT o_orderkey::VARCHAR AS run_id, CASE o_orderstatus WHEN 'O' THEN 'Running' WHEN 'F' THEN 'Completed' ELSE 'Failed' END AS status, o_orderdate AS started_at, CASE WHEN o_orderkey % 2 = 0 THEN 'c' END AS cursor FROM orders)"


def _ledger(spark, d):
    s = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "F", "Completed").otherwise("Failed")
    return read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), s.alias("status"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderkey") % 2 == 0, "c").alias("cursor"))


@query(f"WITH {LEDGER_SQL} SELECT run_id, status, status IN ('Running', 'Failed') AND cursor IS NOT NULL AS resumable FROM l ORDER BY started_at DESC, run_id LIMIT 25")
def up15_runs(spark, d):
    return upsert.runs(_ledger(spark, d), 25).select("run_id", "status", "resumable")


@query(f"WITH {LEDGER_SQL} SELECT run_id, status, cursor FROM l WHERE run_id = '6'")
def up15_show_run(spark, d):
    return upsert.show_run(_ledger(spark, d), "6").select("run_id", "status", "cursor")


@query(f"WITH {LEDGER_SQL} SELECT run_id, status FROM l WHERE status = 'Failed' ORDER BY started_at DESC, run_id DESC LIMIT 1")
def up15_latest_run(spark, d):
    return upsert.latest_run(_ledger(spark, d).withColumn("kind", F.col("status")), "Failed").select("run_id", "status")


@query(f"WITH {LEDGER_SQL} SELECT run_id, CASE WHEN run_id = '5' THEN 'Completed' ELSE status END AS status, CASE WHEN run_id = '5' THEN 'Complete' END AS completeness FROM l UNION ALL SELECT 'new', 'Running', NULL")
def up23_open_close(spark, d):
    l = _ledger(spark, d).withColumn("started_at", F.col("started_at").cast("string"))
    return upsert.close_run(upsert.open_run(l, "new", "Full Scan", "2024-01-01"), "5", "Completed", "Complete").select("run_id", "status", "completeness")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Not Selected' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def up16_reset_candidates(spark, d):
    return upsert.reset_candidates(read_table(spark, d, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_orderstatus")


@query(f"WITH {PRODUCTS} SELECT product_key, coalesce(CASE WHEN substr(product_key, 5)::BIGINT % 2 = 0 THEN 'detail ' || brand END, description) AS description, brand FROM prod")
def up17_enrich(spark, d):
    p = products(spark, d).select("product_key", "description", "brand")
    even = F.substring("product_key", 5, 20).cast("long") % 2 == 0
    detail = p.select("product_key", F.when(even, F.concat(F.lit("detail "), F.col("brand"))).alias("description"), F.lit(None).cast("string").alias("brand"))
    return upsert.enrich(p, detail, "product_key", ["description", "brand"])


@query("SELECT s_suppkey, coalesce(n, s_name) AS s_name FROM supplier LEFT JOIN (SELECT l_suppkey, arg_min(CASE WHEN l_linenumber <> 3 THEN l_returnflag END, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS n FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem) WHERE false GROUP BY 1) ON l_suppkey = s_suppkey".replace("WHERE false GROUP", "GROUP"))
def up17_enrich_suppliers(spark, d):
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_name")
    det = read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("s_name"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_linenumber <> 3")
    return upsert.enrich_suppliers(s, det, "s_suppkey", ["s_name"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])


@query(f"WITH {SNAPS} SELECT o_orderkey, 'added' AS side FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) UNION ALL SELECT o_orderkey, 'removed' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def up18_snapshot_diff(spark, d):
    return upsert.snapshot_diff(before(spark, d), after(spark, d), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'")
def up19_since(spark, d):
    return upsert.since(read_table(spark, d, "orders"), "o_orderdate", "1998-06-01").select("o_orderkey")


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR (c_custkey % 7 = 0)")
def up20_needs_rescore(spark, d):
    k, t = F.col("o_orderkey"), F.lit("2024-01-02").cast("timestamp")
    p = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("supplier_key"), F.when(k % 4 != 0, t).alias("scored_at"), (F.when(k % 3 == 0, F.lit("2024-01-03")).otherwise("2024-01-01")).cast("timestamp").alias("changed_at"), F.when(k % 5 == 0, "v1").otherwise("v2").alias("score_version"))
    s = read_table(spark, d, "customer").select(F.col("c_custkey").alias("supplier_key"), F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-09")).otherwise("2023-01-01").cast("timestamp").alias("eligibility_changed_at"))
    known = p.join(s.select("supplier_key"), "supplier_key", "left_semi")
    return upsert.needs_rescore(known, s, "v2").select("o_orderkey")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 5 <> 0")
def up21_previous_state(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")).alias("raw"))
    return upsert.previous_state(e, "raw", "event_id", {"k": "k"}).select("event_id", "k")


@query("SELECT o_orderkey, substr(sha256('r|' || o_orderkey), 1, 20) AS log_id FROM orders")
def up22_append_log(spark, d):
    rows = read_table(spark, d, "orders").select("o_orderkey")
    empty = rows.limit(0).withColumn("log_id", F.lit(""))
    once = upsert.append_log(empty, rows.where("o_orderkey % 2 = 0"), "r", "o_orderkey")
    return upsert.append_log(once, rows, "r", "o_orderkey")


def _landed(spark, d):
    """Events by user in the stored shape, pages of 500 events."""
    return read_table(spark, d, "events").select("user_id", "event_type", "value", F.floor(F.col("event_id") / 500).alias("page_no"), (F.col("event_id") % 500).alias("pos"))


LAST_SQL = "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"
KINDS = {"event_type": "Kind Changed", "value": "Value Changed"}


def _stream(spark, d, log=False):
    """Three runs of the stream over a third of the pages each; each run takes what is new."""
    landed, root = _landed(spark, d), scratch(spark)
    store, third = f"{root}/store", landed.agg(F.max("page_no")).first()[0] // 3 + 1
    for n in range(3):
        landed.where(F.floor(F.col("page_no") / third) == n).write.parquet(f"{root}/landing/part={n}")
        q = ingest.ingest_stream(spark, f"{root}/landing", store, f"{root}/cp", landed.schema, "user_id", list(KINDS), "parquet", files_per_batch=100_000, log=f"{root}/log" if log else None, categories=KINDS)
        q.awaitTermination()
    if log:
        return spark.read.parquet(f"{root}/log")
    return ingest.read_store(spark, store, ingest.stored_schema(landed.schema), "user_id")


@query(LAST_SQL)
def ss1_ingest_stream(spark, d):
    return _stream(spark, d).select("user_id", "event_type", "value")


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS t, lag(value) OVER w AS v, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id // 500 AS page_no, event_id % 500 AS pos, CASE WHEN r = 1 THEN 'New Product' WHEN t <> event_type AND v <> value THEN 'Multiple' WHEN t <> event_type THEN 'Kind Changed' ELSE 'Value Changed' END AS change_type,
 CASE WHEN r = 1 THEN '' WHEN t <> event_type AND v <> value THEN 'event_type,value' WHEN t <> event_type THEN 'event_type' ELSE 'value' END AS fields,
 CASE WHEN r > 1 AND t <> event_type THEN t END AS old_type, CASE WHEN r > 1 AND t <> event_type THEN event_type END AS new_type
FROM e WHERE r = 1 OR t <> event_type OR v <> value""")
def ss2_change_stream(spark, d):
    """Every change of every user's events, in sequence, whatever batches they came in."""
    old, new = (F.try_element_at(c, F.lit("event_type")) for c in ("old_values", "new_values"))
    return _stream(spark, d, log=True).select("user_id", "page_no", "pos", "change_type", F.array_join("changed_fields", ",").alias("fields"), old.alias("old_type"), new.alias("new_type"))


@query(f"WITH {SNAPS} SELECT o_orderkey, _action, o_orderstatus, price FROM u")
def up1_bucketed_upsert(spark, d):
    """The upsert of up1 in a bucketed store, in eight batches of neighbouring keys' hashes; the batches' actions, and untouched rows' as stored."""
    old, new = before(spark, d), after(spark, d)
    store = Store(spark, scratch(spark), "o_orderkey", old.schema, buckets=32)
    store.write(old, range(store.buckets))
    done = None
    for k in range(8):
        batch = new.where(F.floor(store.bucket() / 4) == k)
        part = upsert.upsert_into(store, batch, "fingerprint", TRACKED)
        done = part if done is None else done.unionByName(part)
    return store.read().join(done.select(F.col("o_orderkey").alias("_k"), "_action"), F.col("o_orderkey") == F.col("_k"), "left").select("o_orderkey", F.coalesce("_action", F.lit("untouched")).alias("_action"), "o_orderstatus", "price")
