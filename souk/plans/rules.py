"""Column rules as table jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from souk.functions import rules as R
from souk.plans.base import PRODUCTS, SUPPLIERS, products, query, suppliers
from souk.sources import pages as P
from souk.sources.pages import read_table

#: White space as the rule has it, for an engine whose classes are ASCII's.
WHITE = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
TEXT = lambda c: f"nullif(trim(regexp_replace({c}, '{WHITE}', ' ', 'g')), '')"
HTML = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''")):
    HTML = f"replace({HTML}, '{_e}', '{_c}')"
SLUG = lambda c: f"trim(regexp_replace(regexp_replace(lower(strip_accents({c})), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


#: Every character that a rule's tables know, in 64 stretches; documents take them in turn.
STRETCHES = 64


def _stretches(chars: str, before: str, after: str) -> list[str]:
    return ["".join(before + c + after for c in chars[i::STRETCHES]) for i in range(STRETCHES)]


COMPOSED = _stretches(R.composing(), "e", " ")
FOLDED = _stretches("".join(R.folds()[0]) + "".join(R.folds()[1]), "", "-q")
SQL_LIST = lambda texts: "[" + ", ".join(f"'{t}'" for t in texts) + "]"


def _with_stretch(docs, texts, *before):
    """Documents' texts, each with one of the stretches after it."""
    stretch = F.element_at(F.array(*map(F.lit, texts)), (F.col("doc_id") % STRETCHES + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", *map(F.lit, before), stretch).alias("text"))


@query(f"SELECT doc_id, {TEXT('nfc_normalize(text)')} AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(replace(text, 'é', 'e' || chr(769)), 'ö', 'o' || chr(776)) ELSE text END || chr(28) || ' ' || {SQL_LIST(COMPOSED)}[(doc_id % {STRETCHES} + 1)::INT] AS text FROM documents)")
def cr1_text(spark, d):
    """Every third text with é and ö as letter and mark; each with a stretch of what NFC may change."""
    t = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ö"), F.lit("o\u0308"))
    docs = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, t).otherwise(F.col("text")).alias("text"))
    return _with_stretch(docs, COMPOSED, "\x1c ").select("doc_id", R.text(F.col("text")).alias("text"))


@query(f"SELECT page_id, {TEXT(HTML)} AS text FROM pages")
def cr2_strip_html(spark, d):
    return read_table(spark, d, "pages").select("page_id", R.strip_html(F.col("html")).alias("text"))


#: The rule character by character: each is looked up among all that decompose to ASCII; other letters drop.
SLUG_SQL = f"""WITH names AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{p.replace(chr(39), chr(39) * 2)}')" for m in R.folds() for c, p in m.items())}) AS t(c, p)),
t AS (SELECT doc_id, text || ' ' || {SQL_LIST(FOLDED)}[(doc_id % {STRETCHES} + 1)::INT] AS text FROM documents),
one AS (SELECT doc_id, i, text[i] AS c FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM t)),
plain AS (SELECT doc_id, string_agg(coalesce(p, CASE WHEN unicode(one.c) < 128 THEN one.c END), '' ORDER BY i) AS s FROM one LEFT JOIN names ON one.c = names.c GROUP BY 1)
SELECT doc_id, coalesce(trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM t LEFT JOIN plain USING (doc_id)"""


@query(SLUG_SQL)
def cr3_slug(spark, d):
    """Whole texts, each with a stretch of what has an ASCII form."""
    return _with_stretch(read_table(spark, d, "documents"), FOLDED, " ").select("doc_id", R.slug(F.col("text")).alias("slug"))


#: url, and four more forms of it, by page
URL_FORMS = """u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN ' ' || url || '?q=a%20b&r=%7E&UTM_source=x&gclid=1&e=&n&p=a+b&s=*&z=%zz&b=' || page_id || '&a=' || chr(252) || '#top'
  WHEN 2 THEN 'HTTPS://Shop.Example:443/?ref=1' WHEN 3 THEN 'shop.example/x/' || page_id || '//' ELSE '//CDN.example/P/' || page_id || '/?b=2&b=1' END AS url FROM pages)"""
DECODE = lambda c: f"url_decode(replace(regexp_replace({c}, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)', '%25\\1', 'g'), '+', ' '))"
ENCODE = lambda c: f"replace(url_encode({c}), '%20', '+')"
URL_SQL = URL_FORMS + f""",
parts AS (SELECT page_id, trim(url) AS raw, lower(regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?', 1)) AS scheme, lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1)) AS host,
  regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) AS q FROM u),
pairs AS (SELECT page_id, {DECODE("split_part(p, '=', 1)")} AS k, {DECODE("regexp_replace(p, '^[^=]*=', '')")} AS v FROM (SELECT page_id, unnest(string_split(q, '&')) AS p FROM parts) WHERE regexp_matches(p, '=.')),
kept AS (SELECT page_id, string_agg({ENCODE("k")} || '=' || {ENCODE("v")}, '&' ORDER BY k, v) AS q FROM pairs WHERE NOT regexp_matches(lower(k), '^(utm_|mc_|pk_)|^(gclid|fbclid|ref|referrer|source|_ga|yclid|msclkid)$') GROUP BY 1)
SELECT page_id, CASE WHEN scheme = '' AND host = '' THEN rtrim(raw, '/') ELSE CASE WHEN scheme = '' THEN 'https' ELSE scheme END || '://' || host || CASE WHEN length(path) > 1 THEN rtrim(path, '/') ELSE path END || coalesce('?' || kept.q, '') END AS url FROM parts LEFT JOIN kept USING (page_id)"""


def _urls(spark, d):
    k = F.col("page_id").cast("string")
    long = F.concat(F.lit(" "), "url", F.lit("?q=a%20b&r=%7E&UTM_source=x&gclid=1&e=&n&p=a+b&s=*&z=%zz&b="), k, F.lit("&a=ü#top"))
    n = F.col("page_id") % 5
    form = F.when(n == 0, F.col("url")).when(n == 1, long).when(n == 2, "HTTPS://Shop.Example:443/?ref=1").when(n == 3, F.concat(F.lit("shop.example/x/"), k, F.lit("//"))).otherwise(F.concat(F.lit("//CDN.example/P/"), k, F.lit("/?b=2&b=1")))
    return read_table(spark, d, "pages").select("page_id", form.alias("url"))


@query(f"WITH {URL_SQL}")
def cr4_url(spark, d):
    return _urls(spark, d).select("page_id", R.url(F.col("url")).alias("url"))


@query(f"WITH c AS (WITH {URL_SQL}) SELECT page_id, 'purl:' || substr(sha256(url), 1, 20) AS product_key, 'surl:' || substr(sha256(url), 1, 20) AS supplier_key FROM c")
def cr12_link_keys(spark, d):
    none, u = F.lit(None).cast("string"), F.col("url")
    return _urls(spark, d).select("page_id", R.product_key(F.lit("sid:1"), none, none, u, F.lit("n"), F.array(none)).alias("product_key"), R.supplier_key(none, u, F.lit("n"), none).alias("supplier_key"))


SAMPLES = ("deutschland", " U.S. ", "great britain", "new zealand", "France", "España", "")


@query("SELECT c_custkey, CASE k WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' WHEN 2 THEN 'United Kingdom' WHEN 3 THEN 'New Zealand' WHEN 4 THEN 'France' WHEN 5 THEN 'Spain' END AS country, CASE k WHEN 0 THEN 'Germany; Italy' WHEN 1 THEN 'United States; Italy' WHEN 2 THEN 'United Kingdom; Italy' WHEN 3 THEN 'New Zealand; Italy' WHEN 4 THEN 'France; Italy' WHEN 5 THEN 'Spain; Italy' ELSE 'Italy' END AS countries FROM (SELECT c_custkey, c_custkey % 7 AS k FROM customer)")
def cr5_cr6_countries(spark, d):
    raw = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("c_custkey") % 7 + 1).cast("int"))
    both = F.concat(raw, F.lit(" | italia, "), raw, F.lit("/Italy"))
    # "U.S." loses its outer dots first, so it stays as it is and is not an alias
    fixed = F.when(F.col("c_custkey") % 7 == 1, "usa").otherwise(raw)
    many = F.when(F.col("c_custkey") % 7 == 1, F.lit("usa;italia;USA")).otherwise(both)
    return read_table(spark, d, "customer").select("c_custkey", R.country(fixed).alias("country"), F.array_join(R.country_list(many), "; ").alias("countries"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE l_extendedprice END AS price FROM lineitem")
def cr7_price(spark, d):
    v = F.col("l_extendedprice").cast("decimal(18,2)")
    dots = F.format_number(v, 2)
    n = F.col("l_linenumber") % 4
    said = F.when(n == 0, F.concat(F.lit("EUR "), F.translate(dots, ",.", ".,"))).when(n == 1, F.concat(F.lit("$"), dots)).when(n == 2, F.translate(v.cast("string"), ".", ",")).otherwise("n/a")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.price(said).alias("price"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate END AS ts FROM orders")
def cr8_timestamps(spark, d):
    n, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(n == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format(t, "yyyy-MM-dd")).when(n == 2, F.unix_timestamp(t).cast("string")).otherwise("soon")
    return read_table(spark, d, "orders").select("o_orderkey", R.ts_utc(said).alias("ts"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false END AS flag FROM orders")
def cr9_booleans(spark, d):
    said = F.element_at(F.array(*map(F.lit, ("Yes", "out of stock", " 1 ", "FALSE", "maybe"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return read_table(spark, d, "orders").select("o_orderkey", R.tri_bool(said).alias("flag"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, trunc(value)::INT AS v, true AS held FROM events")
def cr10_cr11_numbers(spark, d):
    e = read_table(spark, d, "events")
    return e.select("event_id", R.as_int(F.get_json_object("props", "$.k")).alias("k"), R.as_int(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("v"), R.present(F.col("event_type")).alias("held"))


D20 = lambda *p: f"substr(sha256(concat_ws('|', {', '.join(p)})), 1, 20)"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'pid:' || p_partkey WHEN p_partkey % 3 = 1 THEN 'psku:' || {D20(chr(39) + 'sid:9' + chr(39), 'p_brand')} ELSE 'phash:' || {D20(chr(39) + 'sid:9' + chr(39), SLUG('p_name'), D20(SLUG('p_type')))} END AS product_key, 'shash:' || {D20(SLUG('p_brand'), SLUG('p_type'))} AS supplier_key FROM part")
def cr12_keys(spark, d):
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    return read_table(spark, d, "part").select(
        "p_partkey",
        R.product_key(F.lit("sid:9"), F.when(k % 3 == 0, k.cast("string")), F.when(k % 3 == 1, F.col("p_brand")), none, F.col("p_name"), F.array("p_type")).alias("product_key"),
        R.supplier_key(none, none, F.col("p_brand"), F.col("p_type")).alias("supplier_key"),
    )


@query("SELECT p_partkey, p_size || ' × 20 × 3cm' AS dimensions, p_size || 'kg' AS weight FROM part")
def cr14_dimensions(spark, d):
    said = F.concat(F.lit("box "), F.col("p_size").cast("string"), F.lit(" x 20 x 3 cm, "), F.col("p_size").cast("string"), F.lit(" kg"))
    out = F.replace(R.dimensions(said), F.lit("  "), F.lit(" "))  # the doubled blanks stay in the rule
    return read_table(spark, d, "part").select("p_partkey", out.alias("dimensions"), R.weight(said).alias("weight"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source || ',English' ELSE source || ',' || lang || ',English' END AS tags FROM documents")
def cr16_merge_tags(spark, d):
    src = F.col("source")
    first = F.when(F.col("lang") == "en", F.array(src)).otherwise(F.array(src, F.col("lang")))
    return read_table(spark, d, "documents").select("doc_id", F.array_join(R.merge_tags(first, F.array(F.upper(src), F.lit(" English"), F.lit("english"), F.lit(""))), ",").alias("tags"))


@query("SELECT doc_id, CASE WHEN length(t) <= 40 THEN t ELSE regexp_replace(substr(t, 1, 40), '[\\s,.;:\\-]+$', '') END AS clipped FROM (SELECT doc_id, trim(text) AS t FROM documents)")
def cr18_clip(spark, d):
    return read_table(spark, d, "documents").select("doc_id", R.clip(F.col("text"), 40).alias("clipped"))


@query("""SELECT event_id, '{"api_key": "***REDACTED***","in":[{"X-Auth":"***REDACTED***"},{"n":' || k || ',"Set-Cookies" : "***REDACTED***"}],"k":' || k || ',"PASSWORD_2":"***REDACTED***" }' AS props FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def cr19_redact(spark, d):
    """Texts, numbers, lists and objects under secret names, at any depth."""
    k = F.get_json_object("props", "$.k")
    secret = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"v":['), k, F.lit(',"}"]}'))).when(F.col("event_id") % 3 == 1, F.lit('"a, \\"b\\"]"')).otherwise(k)
    raw = F.concat(F.lit('{"api_key": '), secret, F.lit(',"in":[{"X-Auth":'), secret, F.lit('},{"n":'), k, F.lit(',"Set-Cookies" : ["a",'), secret, F.lit(']}],"k":'), k, F.lit(',"PASSWORD_2":null }'))
    return read_table(spark, d, "events").select("event_id", R.redact_json(raw).alias("props"))


@query(f"SELECT 'url' AS column_name, count(*) FILTER (url IS NULL) AS nulls, count(*) FILTER ({TEXT('url')} <> url) AS changed, count(*) FILTER ({TEXT('url')} IS NULL) AS unparseable FROM pages UNION ALL SELECT 'html', count(*) FILTER (html IS NULL), count(*) FILTER ({TEXT(HTML)} <> html), count(*) FILTER ({TEXT(HTML)} IS NULL AND html IS NOT NULL) FROM pages")
def cr0_quality_report(spark, d):
    return R.normalize_table(read_table(spark, d, "pages"), {"url": R.text, "html": R.strip_html})[1]


@query(f"WITH {PRODUCTS} SELECT product_key, round_even((((product_name IS NOT NULL)::INT + (description IS NOT NULL)::INT + (stock_status IS NOT NULL)::INT + (len(image_urls) > 0)::INT + (supplier_price IS NOT NULL)::INT) * 100 / 5)::DECIMAL(18,6), 1)::DECIMAL(5,1) AS pct FROM prod")
def pj5_completeness(spark, d):
    h = R.holds
    p = products(spark, d)
    return p.select("product_key", R.completeness(h(F.col("product_name")), h(F.col("description")), h(F.col("stock_status")), h(F.col("image_urls"), True), h(F.col("supplier_price"))).alias("pct"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'In Stock' WHEN 'F' THEN 'Out Of Stock' ELSE 'Unknown' END AS stock, CASE o_orderkey % 5 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'Out Of Stock' WHEN 2 THEN 'Low Stock' ELSE 'Unknown' END AS spelled FROM orders")
def pj8_stock_status(spark, d):
    """Stock words as the order's status says them, and every spelling by turns."""
    status = F.col("o_orderstatus")
    said = F.when(status == "O", " in STOCK").when(status == "F", "Out of Stock").otherwise("?")
    spelled = F.get(F.array(*map(F.lit, ("in STOCK", "Out of Stock", "low stock", "outofstock"))), F.col("o_orderkey") % 5)
    return read_table(spark, d, "orders").select("o_orderkey", R.stock_status(F.btrim(said)).alias("stock"), R.stock_status(spelled).alias("spelled"))


@query("SELECT p_partkey, p_brand AS brand, 'none' AS colour, 'https://shop/p/' || p_partkey AS link, 'EUR' AS currency FROM part")
def pj1_pj3_paths(spark, d):
    p = read_table(spark, d, "part")
    raw = p.select("p_partkey", F.to_json(F.struct(F.array(F.struct(F.col("p_brand").alias("NAME"))).alias("BRANDS"))).alias("raw"))
    out = P.map_paths(raw, "raw", {"brand": "BRANDS.0.NAME", "colour": "LOOK.COLOUR", "currency": "CURRENCY"}, {"colour": "none", "currency": "EUR"})
    return out.select("p_partkey", "brand", "colour", P.url_template("https://shop/p/{id}", F.col("p_partkey")).alias("link"), "currency")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def pj1_map_paths(spark, d):
    return P.map_paths(read_table(spark, d, "events"), "props", {"k": "k"}).select("event_id", "k")


@query("WITH z AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS cost, l_linenumber AS lo, l_linenumber + 5 AS hi, l_returnflag AS loc, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity) AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT l_orderkey, max(cost) AS cost, min(lo)::INT AS min_days, max(hi)::INT AS max_days, count(*)::INT AS covered FROM z WHERE r = 1 GROUP BY 1")
def pj6_market_shipping(spark, d):
    l = read_table(spark, d, "lineitem")
    zone = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_quantity", F.array("l_returnflag").alias("locations"))
    z = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(zone)).alias("z"))
    zones = F.transform("z", lambda x: F.struct((x["l_discount"] * 100).alias("cost"), x["l_linenumber"].alias("min_days"), (x["l_linenumber"] + 5).alias("max_days"), x["locations"].alias("locations")))
    return z.select("l_orderkey", P.market_shipping(zones, ["A", "R", "Q"]).alias("w")).where("w.covered > 0").select("l_orderkey", "w.*")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2) GROUP BY 1")
def st2_ordered_distinct(spark, d):
    """A user's kinds of events as first met; kinds are few, however many events a user has."""
    first = read_table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    kinds = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("seen"))
    return kinds.select("user_id", F.array_join("seen.event_type", ",").alias("kinds"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || ',' END || p_type || ',plain' AS names FROM part")
def pj2_pull_item_field(spark, d):
    p = read_table(spark, d, "part")
    brand = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(F.lit(1).alias("id")))).otherwise(F.to_json(F.struct(F.col("p_brand").alias("value"))))
    items = F.array(brand, F.to_json(F.struct(F.col("p_type").alias("value"))), F.lit("plain"))
    return p.select("p_partkey", F.array_join(F.filter(P.pull_item_field(items, "value"), lambda x: x.isNotNull()), ",").alias("names"))
