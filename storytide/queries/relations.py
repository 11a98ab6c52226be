"""Joins, sets, windows and JSON of the relational kit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsondoc
from ..functions.numeric import half_up
from ..operators import relational
from ..plans import views
from .registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-08'")
def bounded_day_scan(spark, d):
    o = views.table(spark, d, "orders")
    return o.where((F.col("o_orderdate") >= F.lit("1997-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-03-08").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 8, 13, 21, 34, 55, 89)")
def point_lookup(spark, d):
    return views.table(spark, d, "customer").where(F.col("c_custkey").isin(1, 5, 8, 13, 21, 34, 55, 89)).select("c_custkey", "c_name")


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def semi_join_with_text(spark, d):
    return views.table(spark, d, "documents").join(views.table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_uncovered(spark, d):
    return views.table(spark, d, "documents").select("doc_id").join(views.table(spark, d, "labels"), "doc_id", "left_anti")


@query("WITH " + views.EVIDENCE_SQL + """, rules AS (SELECT * FROM (VALUES ('click', 5), ('view', 10), ('error', 20)) t(rule, days)), covered AS (SELECT document_id, rule FROM evidence CROSS JOIN rules WHERE document_id % 3 <> 0 OR rule = 'view')
SELECT DISTINCT document_id FROM (SELECT document_id, rule FROM evidence, rules WHERE date >= DATE '2024-01-30' - days EXCEPT SELECT document_id, rule FROM covered)""")
def eligibility_division(spark, d):
    e = views.evidence(spark, d).select("document_id", "date")
    rules = spark.createDataFrame([("click", 5), ("view", 10), ("error", 20)], "rule string, days int")
    covered = e.join(F.broadcast(rules)).where("document_id % 3 <> 0 or rule = 'view'").select("document_id", "rule")  # three rules
    return relational.eligible_within(e, "document_id", "date", rules, "rule", "days", covered, "2024-01-30")


@query("SELECT n.n_name, r.r_name, count(DISTINCT c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY 1, 2")
def hierarchy_join(spark, d):
    t = lambda n: views.table(spark, d, n)
    c = t("customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    x = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return x.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("SELECT p.n_name AS child, q.n_name AS parent FROM nation p LEFT JOIN nation q ON q.n_nationkey = p.n_regionkey")
def parent_self_join(spark, d):
    n = views.table(spark, d, "nation")
    return n.alias("p").join(n.alias("q"), F.col("q.n_nationkey") == F.col("p.n_regionkey"), "left").select(F.col("p.n_name").alias("child"), F.col("q.n_name").alias("parent"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)")
def lateral_top_orders(spark, d):
    o = relational.top_per(views.table(spark, d, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"))
    return views.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("WITH RECURSIVE links AS (SELECT c_custkey AS id, c_custkey - (c_custkey % 5 + 1) AS target FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey > 20), w AS (SELECT id, target, 1 AS steps FROM links UNION ALL SELECT w.id, l.target, steps + 1 FROM w JOIN links l ON w.target = l.id WHERE steps < 20) SELECT id, arg_max(target, steps) AS target, max(steps) AS steps FROM w GROUP BY 1")
def bounded_chain(spark, d):
    c = views.table(spark, d, "customer").where("c_custkey % 7 <> 0 AND c_custkey > 20")
    links = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - (F.col("c_custkey") % 5 + 1)).alias("target"))
    return relational.resolve_chain(links, "id", "target", 20)


@query("SELECT id, count(*) AS n FROM (SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation) GROUP BY 1")
def union_source_ids(spark, d):
    t = lambda n, c: views.table(spark, d, n).select(F.col(c).alias("id"))
    return t("customer", "c_nationkey").union(t("supplier", "s_nationkey")).union(t("nation", "n_nationkey")).distinct().groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large, CAST(floor(avg(o_totalprice) FILTER (o_orderstatus = 'O') * 100 + 0.5) AS BIGINT) AS open_mean_cents FROM orders GROUP BY 1")
def filter_aggregates(spark, d):
    o = views.table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.floor(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))) * 100 + 0.5).alias("open_mean_cents"))


@query("SELECT l_returnflag, floor(median(l_quantity) * 100 + 0.5) / 100.0 AS median_quantity, floor(stddev_samp(l_extendedprice) * 100 + 0.5) / 100.0 AS deviation, floor(sum(l_extendedprice * l_quantity) / sum(l_quantity) * 100 + 0.5) / 100.0 AS weighted_price FROM lineitem GROUP BY 1")
def robust_aggregates(spark, d):
    from ..functions.numeric import sample_deviation, weighted_mean

    x = views.table(spark, d, "lineitem").groupBy("l_returnflag")
    return x.agg(half_up(F.median("l_quantity")).alias("median_quantity"), half_up(sample_deviation(F.col("l_extendedprice"))).alias("deviation"), half_up(weighted_mean(F.col("l_extendedprice"), F.col("l_quantity"))).alias("weighted_price"))


@query("WITH m AS (SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l.l_returnflag, floor(median(abs(l_quantity - m)) * 1.4826 * 1000 + 0.5) / 1000.0 AS mad FROM lineitem l JOIN m ON l.l_returnflag = m.l_returnflag GROUP BY 1")
def median_absolute_deviation(spark, d):
    x = views.table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    m = x.groupBy("l_returnflag").agg(F.median("l_quantity").alias("m"))
    return x.join(m, "l_returnflag").groupBy("l_returnflag").agg(half_up(F.median(F.abs(F.col("l_quantity") - F.col("m"))) * 1.4826, 3).alias("mad"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS total, count(*) FILTER (json_exists(props, '$.k')) AS with_key FROM events GROUP BY 1")
def json_metadata_access(spark, d):
    e = views.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(jsondoc.number(F.col("props"), "k")).alias("total"), F.count_if(jsondoc.has_key(F.col("props"), "k")).alias("with_key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(event_id % 3 AS VARCHAR) AS third FROM events")
def json_merge(spark, d):
    e = views.table(spark, d, "events")
    merged = jsondoc.merged(F.col("props"), F.to_json(F.struct((F.col("event_id") % 3).cast("string").alias("third"))))
    x = e.select("event_id", merged.alias("m"))
    return x.select("event_id", jsondoc.get(F.col("m"), "k").alias("k"), jsondoc.get(F.col("m"), "third").alias("third"))


@query("SELECT count(*) AS changed FROM orders o JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice END AS p, CASE WHEN o_orderkey % 15 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders) n ON o.o_orderkey = n.k WHERE (o.o_totalprice, o.o_orderstatus) IS DISTINCT FROM (n.p, n.s)")
def row_value_comparison(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    n = o.select(k, F.when(k % 10 == 0, None).otherwise(F.col("o_totalprice")).alias("p"), F.when(k % 15 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return o.join(n, "o_orderkey").where(~F.struct("o_totalprice", "o_orderstatus").eqNullSafe(F.struct(F.col("p").alias("o_totalprice"), F.col("s").alias("o_orderstatus")))).agg(F.count("*").alias("changed"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def case_insensitive_search(spark, d):
    return views.table(spark, d, "customer").where(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lower(F.lit("Build")))).select("c_custkey")


@query("SELECT p_partkey, p_retailprice, n, true AS has_more FROM (SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS n FROM part) WHERE n > 24 AND n <= 48")
def paged_rows(spark, d):
    x = relational.page(views.table(spark, d, "part").select("p_partkey", "p_retailprice"), 24, 1, F.desc("p_retailprice"), F.asc("p_partkey"))
    from pyspark.sql import Window

    return x.withColumn("n", 24 + F.row_number().over(Window.orderBy(F.desc("p_retailprice"), F.asc("p_partkey"))))


@query("SELECT page_id FROM pages WHERE regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '(^|\\.)thth[a-z]*\\.example\\.com$')")
def host_pattern_filter(spark, d):
    from ..functions.address import hostname

    return views.table(spark, d, "pages").where(hostname(F.col("url")).rlike(r"(^|\.)thth[a-z]*\.example\.com$")).select("page_id")


@query("SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def latest_event_state(spark, d):
    return relational.latest_state(views.table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", F.col("o_orderdate"), F.col("o_orderkey")).withColumnRenamed("o_orderstatus", "status")
