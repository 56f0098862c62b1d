"""Queries from landed feature pages to stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.functions.text import first_filled, is_target_request, normalize_text, parse_variant_time
from cellweft.operators import events, keys, quality
from cellweft.plans import inputs
from cellweft.plans.inputs import cells_sql, sql_lat, sql_lon
from cellweft.plans.registry import query
from cellweft.session import scratch_path
from cellweft.sources import pages as page_source
from cellweft.sources import tables

PAGE_KEYS = 1_000

# One row per order as a request: the type sits in one of three alias fields.
_REQUESTS_SQL = f"""
SELECT o_orderkey AS k,
  CASE o_orderpriority WHEN '1-URGENT' THEN ' water   main break ' WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN 'WATER SERVICE'
    WHEN '5-LOW' THEN 'OTHER' END AS reqtype,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'Main Break' END AS req_type,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'water break' END AS request_type,
  o_orderstatus || ' water' AS category, o_orderdate AS created,
  {sql_lon('o_orderkey')} + CASE WHEN o_orderkey % 10 = 3 THEN 5 ELSE 0 END AS lon, {sql_lat('o_orderkey')} AS lat
FROM orders"""
_TARGET = "upper(trim(regexp_replace(coalesce(nullif(reqtype, ''), nullif(req_type, ''), nullif(request_type, ''), ''), '\\s+', ' ', 'g'))) IN ('MAIN BREAK', 'WATER BREAK', 'WATER MAIN', 'WATER MAIN BREAK')"


def requests(spark, folder) -> DataFrame:
    """The Spark twin of the requests above."""
    k, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    shifted = inputs.lon(k) + F.when(k % 10 == 3, 5.0).otherwise(0.0)
    return inputs.table(spark, folder, "orders").select(
        k.alias("k"),
        F.when(priority == "1-URGENT", " water   main break ").when(priority == "2-HIGH", "")
        .when(priority == "3-MEDIUM", "WATER SERVICE").when(priority == "5-LOW", "OTHER").alias("reqtype"),
        F.when(priority == "2-HIGH", "Main Break").alias("req_type"),
        F.when(priority == "4-NOT SPECIFIED", "water break").alias("request_type"),
        F.concat("o_orderstatus", F.lit(" water")).alias("category"),
        F.col("o_orderdate").alias("created"), shifted.alias("lon"), inputs.lat(k).alias("lat"),
    )


def _created_json(k: Column, created: Column) -> Column:
    """Created time as JSON: epoch milliseconds, ISO text or something unusable."""
    millis = F.unix_millis(created.cast("timestamp")).cast("string")
    text = F.concat(F.lit('"'), F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))
    return F.when(k % 5 == 0, text).when(k % 5 == 4, F.lit('"soon"')).otherwise(millis)


def feature_json(rows: DataFrame) -> DataFrame:
    """Each request as the JSON text of a feature, in its page of at most 1,000 keys."""
    k = F.col("k")
    quoted = [
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f', "{c}": '), F.to_json(F.array(F.col(c))))).otherwise(F.lit(""))
        for c in ("reqtype", "req_type", "request_type", "category")
    ]
    attributes = F.concat(
        F.lit('{"objectid": '), F.when(k % 7 == 0, F.lit("null")).otherwise(k.cast("string")),
        *[F.regexp_replace(c, r"\[(.*)\]$", "$1") for c in quoted],
        F.lit(', "description": "not to be kept", "createddate": '), _created_json(k, F.col("created")), F.lit("}"),
    )
    point = F.concat(F.lit('{"x": '), F.col("lon").cast("string"), F.lit(', "y": '), F.col("lat").cast("string"), F.lit("}"))
    geometry = F.when(k % 11 == 0, F.lit("null")).otherwise(point)
    text = F.concat(F.lit('{"attributes": '), attributes, F.lit(', "geometry": '), geometry, F.lit("}"))
    return rows.select(F.floor(k / PAGE_KEYS).cast("int").alias("page"), k.alias("k"), text.alias("feature"))


def write_pages(spark, rows: DataFrame, label: str) -> str:
    """Land (page, k, feature) rows as JSON pages, one page per line; keys bound a page."""
    last = rows.agg(F.max("page").alias("last")).scalar()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "feature"))), lambda f: f["feature"])
    grouped = rows.groupBy("page").agg(F.array_join(listed, ", ").alias("items"))
    more = F.when(F.col("page") < last, "true").otherwise("false")
    text = F.concat(F.lit('{"page": '), F.col("page").cast("string"), F.lit(', "exceededTransferLimit": '), more,
                    F.lit(', "features": ['), F.col("items"), F.lit("]}"))
    path = scratch_path(spark, label)
    grouped.select(text.alias("value")).write.text(path)
    return path


def landed_features(spark, folder) -> DataFrame:
    path = write_pages(spark, feature_json(requests(spark, folder)), "pages")
    return page_source.page_features(page_source.read_pages(spark, path, multi_line=False))


_JSON_SQL = f"""
SELECT k, CASE WHEN k % 7 <> 0 THEN k END AS objectid, reqtype, req_type, request_type, category,
  CASE WHEN k % 5 <> 4 THEN created END AS createddate, CASE WHEN k % 11 <> 0 THEN lon END AS lon,
  CASE WHEN k % 11 <> 0 THEN lat END AS lat FROM ({_REQUESTS_SQL})"""


@query("json_pages", f"""
SELECT objectid, reqtype, req_type, request_type, category, createddate, lon AS x, lat AS y,
  lon IS NOT NULL AS has_geometry, (k // {PAGE_KEYS})::INT AS arrival_page FROM ({_JSON_SQL})""")
def json_pages(spark, folder):
    rows = landed_features(spark, folder)
    return rows.select(
        F.try_variant_get("objectid", "$", "bigint").alias("objectid"), "reqtype", "req_type", "request_type", "category",
        parse_variant_time(F.col("createddate")).cast("timestamp_ntz").alias("createddate"),
        F.col("x").cast("double"), F.col("y").cast("double"), "has_geometry", "arrival_page",
    )


@query("page_envelopes", f"""
SELECT CASE page % 5 WHEN 1 THEN 'error envelope' WHEN 2 THEN 'no features list' WHEN 3 THEN 'feature is not an object'
  WHEN 4 THEN 'not a JSON object' ELSE 'none' END AS problem, count(*) AS pages
FROM (SELECT DISTINCT o_orderkey // {PAGE_KEYS} AS page FROM orders) GROUP BY 1""")
def page_envelopes(spark, folder):
    """Pages landed with each kind of damage in turn."""
    rows = feature_json(requests(spark, folder)).groupBy("page").agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("items"))
    items, kind = F.col("items"), F.col("page") % 5
    text = (
        F.when(kind == 1, F.lit('{"error": {"code": 400}}'))
        .when(kind == 2, F.concat(F.lit('{"features": {"first": '), F.to_json(F.array(items)), F.lit("}}")))
        .when(kind == 3, F.concat(F.lit('{"features": ['), items, F.lit(", 7]}")))
        .when(kind == 4, F.concat(F.lit('{"features": ['), items))
        .otherwise(F.concat(F.lit('{"features": ['), items, F.lit("]}")))
    )
    path = scratch_path(spark, "damaged")
    rows.select(text.alias("value")).write.text(path)
    return page_source.envelope_report(page_source.read_pages(spark, path, multi_line=False))


@query("page_audit", f"""
WITH base AS (SELECT (o_orderkey // {PAGE_KEYS})::INT AS page, count(*) AS n FROM orders GROUP BY 1),
pages AS (SELECT 'orders' AS source, page, page AS body, n FROM base UNION ALL
  SELECT 'stuck', 2 * page + s.i::INT, page, n FROM base, range(2) AS s(i)),
marked AS (SELECT *, page < max(page) OVER (PARTITION BY source) AS exceeded FROM pages),
paired AS (SELECT a.*, b.body = a.body AS repeated, b.page IS NOT NULL AND (NOT b.exceeded OR b.n < {PAGE_KEYS}) AS after_last
  FROM marked a LEFT JOIN marked b ON a.source = b.source AND b.page = a.page - 1)
SELECT source, count(*) AS pages, sum(n)::BIGINT AS features, bool_or(exceeded) AS exceeded_transfer_limit,
  count(*) FILTER (WHERE coalesce(repeated, false)) AS repeated_pages, count(*) FILTER (WHERE after_last) AS pages_after_last, count(*) > 500 AS over_page_cap
FROM paired GROUP BY source""")
def page_audit(spark, folder):
    """One sound page set and one whose source sent every page twice."""
    rows = feature_json(requests(spark, folder))
    twice = rows.select(F.explode(F.array(F.col("page") * 2, F.col("page") * 2 + 1)).alias("page"), "k", "feature")
    parts = [
        page_source.read_pages(spark, write_pages(spark, part, name), multi_line=False, source=name)
        for name, part in (("orders", rows), ("stuck", twice))
    ]
    return page_source.page_audit(parts[0].unionByName(parts[1]), PAGE_KEYS)


@query("normalize_text", """
SELECT p_partkey, upper(p_name) AS name, upper(p_type) || ' ' || upper(p_brand) AS kind FROM part""")
def normalize(spark, folder):
    spaced = F.concat(F.lit("\t "), F.regexp_replace("p_name", " ", "  \n "), F.lit("  "))
    return inputs.table(spark, folder, "part").select(
        "p_partkey", normalize_text(spaced).alias("name"),
        normalize_text(F.concat_ws(" ", "p_type", "p_brand")).alias("kind"),
    )


@query("event_filter", f"""
SELECT k, coalesce(nullif(reqtype, ''), nullif(req_type, ''), nullif(request_type, '')) AS used FROM ({_REQUESTS_SQL}) WHERE {_TARGET}""")
def event_filter(spark, folder):
    aliases = [F.col(c) for c in ("reqtype", "req_type", "request_type")]
    return requests(spark, folder).filter(is_target_request(*aliases)).select("k", first_filled(*aliases).alias("used"))


@query("date_range", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1998-07-01'""")
def date_range(spark, folder):
    orders = inputs.table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return orders.filter(events.date_range("o_orderdate", "1996-02-01", "1998-06-30"))


@query("parse_time", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN o_orderdate END AS parsed FROM orders""")
def parse_time(spark, folder):
    k, created = F.col("o_orderkey"), F.col("o_orderdate")
    millis = F.unix_millis(created.cast("timestamp")).cast("string")
    text = (
        F.when(k % 6 == 0, millis).when(k % 6 == 1, F.concat(millis, F.lit(".0")))
        .when(k % 6 == 2, F.concat(F.lit('"'), F.date_format(created, "yyyy-MM-dd HH:mm:ss"), F.lit('"')))
        .when(k % 6 == 3, F.lit("true")).when(k % 6 == 4, F.lit('"yesterday"')).otherwise(F.lit("null"))
    )
    parsed = parse_variant_time(F.parse_json(text)).cast("timestamp_ntz")
    return inputs.table(spark, folder, "orders").select("o_orderkey", parsed.alias("parsed"))


@query("bbox_filter", f"""
SELECT objectid, lon, lat FROM (SELECT o_orderkey AS objectid, {sql_lon('o_orderkey')} + (o_orderkey % 3 - 1) * 0.3::DOUBLE AS lon,
  {sql_lat('o_orderkey')} + (o_orderkey % 5 - 2) * 0.1::DOUBLE AS lat FROM orders)
WHERE lon BETWEEN -76.35 AND -75.50 AND lat BETWEEN 45.25 AND 45.60""")
def bbox_filter(spark, folder):
    k = F.col("o_orderkey")
    rows = inputs.table(spark, folder, "orders").select(
        k.alias("objectid"), (inputs.lon(k) + (k % 3 - 1) * F.lit(0.3)).alias("lon"),
        (inputs.lat(k) + (k % 5 - 2) * F.lit(0.1)).alias("lat"),
    )
    return rows.filter(events.in_extent(F.col("lon"), F.col("lat")))


_JUDGED_SQL = f"""
SELECT *, CASE WHEN objectid IS NULL THEN 'missing objectid' WHEN lon IS NULL THEN 'no point geometry'
  WHEN lon > -75.50 THEN 'outside the extent' WHEN createddate IS NULL THEN 'invalid createddate' ELSE 'accepted' END AS reason
FROM ({_JSON_SQL}) WHERE {_TARGET}"""


@query("reject_report", f"SELECT reason, count(*) AS rows FROM ({_JUDGED_SQL}) GROUP BY 1")
def reject_report(spark, folder):
    return events.reject_report(events.judge_features(landed_features(spark, folder)))


@query("minimize_events", f"""
SELECT objectid, coalesce(upper(trim(regexp_replace(reqtype, '\\s+', ' ', 'g'))), '') AS reqtype, upper(category) AS category,
  createddate, cell_id FROM ({cells_sql(f"(SELECT * FROM ({_JUDGED_SQL}) WHERE reason = 'accepted')")})""")
def minimize_events(spark, folder):
    kept = events.minimize_events(landed_features(spark, folder))
    return kept.withColumn("createddate", F.col("createddate").cast("timestamp_ntz"))


@query("cap_records", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 4321""")
def cap_records(spark, folder):
    rows = inputs.table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return events.cap_records(rows, 4321, ("o_orderdate", "o_orderkey"))


@query("upsert", """
SELECT coalesce(n.k, b.k) AS k, CASE WHEN n.k IS NULL THEN b.name ELSE n.name END AS name,
  CASE WHEN n.k IS NULL THEN b.amount ELSE n.amount END AS amount
FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount FROM customer) b
FULL JOIN (SELECT p_partkey + 700 AS k, p_name AS name, p_retailprice AS amount FROM part) n USING (k)""")
def upsert(spark, folder):
    """Customers replaced and joined by parts, through a stored table."""
    base = inputs.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    new = inputs.table(spark, folder, "part").select(
        (F.col("p_partkey") + 700).alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("amount"))
    stored = tables.write_table(base, scratch_path(spark, "base"), order=["k"])
    return spark.read.parquet(tables.upsert_table(spark, stored, new, ["k"]))


_UPSERT_SQL = """
SELECT coalesce(n.k, b.k) AS k, CASE WHEN n.k IS NULL THEN b.name ELSE n.name END AS name,
  CASE WHEN n.k IS NULL THEN b.amount ELSE n.amount END AS amount
FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount FROM customer) b
FULL JOIN (SELECT s_suppkey + 700 AS k, s_name AS name, s_acctbal AS amount FROM supplier) n USING (k)"""


@query("upsert_ranges", _UPSERT_SQL)
def upsert_ranges(spark, folder):
    """Customers in folders of 250 keys; suppliers touch a few of them, and the others keep their files."""
    base = inputs.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"))
    new = inputs.table(spark, folder, "supplier").select(
        (F.col("s_suppkey") + 700).alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("amount"))
    stored = tables.write_keyed(base, scratch_path(spark, "keyed"), "k div 250")
    tables.merge_keyed(spark, stored, new, ["k"], "k div 250")
    return spark.read.parquet(stored).select("k", "name", "amount")


@query("fk_cascade", """
WITH moved AS (SELECT s_suppkey AS old_key, CASE WHEN s_suppkey % 7 = 0 THEN s_suppkey + 100000 WHEN s_suppkey % 7 = 1 THEN s_suppkey + 1
  WHEN s_suppkey % 7 = 2 AND s_suppkey > 1 THEN s_suppkey - 1 ELSE s_suppkey END AS new_key, s_name FROM supplier)
SELECT new_key AS s_suppkey, any_value(s_name) AS s_name, count(l_orderkey) AS lines
FROM moved LEFT JOIN lineitem ON l_suppkey = old_key GROUP BY 1""")
def fk_cascade(spark, folder):
    """Every seventh supplier gets a far key and two neighbours swap theirs; the line items follow."""
    suppliers = inputs.table(spark, folder, "supplier").select("s_suppkey", "s_name")
    lines = inputs.table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    k = F.col("s_suppkey")
    new_key = F.when(k % 7 == 0, k + 100000).when(k % 7 == 1, k + 1).when((k % 7 == 2) & (k > 1), k - 1)
    changes = suppliers.select(k.alias("old_key"), new_key.alias("new_key")).filter("new_key IS NOT NULL")
    parent, children = keys.cascade_update(suppliers, "s_suppkey", {"lines": (lines, "l_suppkey")}, changes)
    counts = children["lines"].groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("l_orderkey").alias("lines"))
    return parent.join(counts, "s_suppkey", "left").select("s_suppkey", "s_name", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("one_to_one", """
SELECT c_custkey, c_name, orders, spent FROM customer LEFT JOIN
  (SELECT o_custkey AS c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (c_custkey)""")
def one_to_one(spark, folder):
    totals = inputs.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    customers = inputs.table(spark, folder, "customer").select("c_custkey", "c_name")
    return keys.one_to_one_left(customers, totals, ["c_custkey"])


@query("constraint_audit", """
WITH rows AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS flag, l_quantity, l_discount FROM lineitem)
SELECT count(*) AS row_count, count(*) FILTER (WHERE flag IS NULL) AS null_flag, count(*) FILTER (WHERE l_quantity IS NULL) AS null_l_quantity,
  count(*) FILTER (WHERE l_quantity > 40) AS check_quantity, count(*) FILTER (WHERE l_discount NOT BETWEEN 0.02 AND 0.08) AS check_discount,
  count(*) FILTER (WHERE flag <> 'A') AS check_flag,
  (SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM rows) AS duplicate_keys FROM rows""")
def constraint_audit(spark, folder):
    rows = inputs.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("R")).alias("flag"), "l_quantity", "l_discount")
    checks = {"quantity": F.col("l_quantity") <= 40, "discount": F.col("l_discount").between(0.02, 0.08),
              "flag": F.col("flag") == "A"}
    return quality.contract_audit(rows, ["flag", "l_quantity"], checks, ["l_orderkey", "l_linenumber"])


@query("fk_orphans", """
SELECT l_partkey, count(*) AS rows FROM lineitem WHERE l_partkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def fk_orphans(spark, folder):
    lines, parents = inputs.table(spark, folder, "lineitem"), inputs.table(spark, folder, "supplier")
    return quality.orphan_keys(lines.select("l_partkey"), parents.select("s_suppkey"), "l_partkey", "s_suppkey")
