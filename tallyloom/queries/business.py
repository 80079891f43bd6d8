"""Business roll-ups, semi and anti joins, keyed unions, and the guarded SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import business
from ..plans import readonly_sql
from ..sources import merges
from .registry import query, table


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS closed, count(DISTINCT CASE WHEN o_totalprice > 100000 THEN c_custkey END) AS large FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def conditional_distinct(spark, sf_dir) -> DataFrame:
    """Conditional distinct counts over left joins."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    joined = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("n_name").agg(
        F.count_distinct("c_custkey").alias("customers"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("closed"), F.count_distinct(F.when(F.col("o_totalprice") > 100000, F.col("c_custkey"))).alias("large")
    )


@query("SELECT c_custkey, o_orderkey, o_orderdate, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1")
def latest_per_key(spark, sf_dir) -> DataFrame:
    """The latest order of each customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_orderstatus")
    return business.latest_per_key(table(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", ["o_orderdate", "o_orderkey"])


@query("SELECT n_nationkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = n_nationkey ORDER BY s_acctbal, s_suppkey LIMIT 1) AS s_suppkey FROM nation")
def correlated_top1(spark, sf_dir) -> DataFrame:
    """The first supplier of each nation."""
    first = business.first_per_key(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_acctbal", "s_suppkey"], "s_suppkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return n.join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "s_suppkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark, sf_dir) -> DataFrame:
    """J08, P19."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def not_exists_anti(spark, sf_dir) -> DataFrame:
    """J09, P20."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT DISTINCT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'O'")
def scoped_distinct(spark, sf_dir) -> DataFrame:
    """Distinct ids over three tables."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")  # noqa: E741
    return l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("l_suppkey").distinct()


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def having_duplicates(spark, sf_dir) -> DataFrame:
    """A12."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT o_orderpriority AS label, count(*) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY value DESC, label LIMIT 50")
def grouped_count(spark, sf_dir) -> DataFrame:
    """Counts by one of the allowed columns."""
    return business.grouped_count(table(spark, sf_dir, "orders"), "o_orderpriority", ("o_orderstatus", "o_orderpriority"), 50, F.col("o_orderstatus") == "O")


@query("SELECT status, count(*) AS value, (SELECT count(*) FROM orders) AS denominator FROM (SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'other' END AS status FROM orders) GROUP BY status")
def status_distribution(spark, sf_dir) -> DataFrame:
    """A06."""
    return business.status_shares(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O"))


@query("SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS suppliers, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS parts, (SELECT count(*) FROM events) AS events")
def overview_metrics(spark, sf_dir) -> DataFrame:
    """Scalar measures of the overview."""
    for t in ("customer", "orders", "supplier", "lineitem", "events"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"overview_{t}")
    return spark.sql(
        "SELECT (SELECT count(*) FROM overview_customer) AS customers, (SELECT count(*) FROM overview_orders) AS orders, (SELECT count(*) FROM overview_supplier WHERE s_acctbal > 0) AS suppliers, "
        "(SELECT count(DISTINCT l_partkey) FROM overview_lineitem) AS parts, (SELECT count(*) FROM overview_events) AS events"
    )


@query("SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS cents FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def business_star(spark, sf_dir) -> DataFrame:
    """Roll-up of the star, orders summed by customer before the wide join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    by_nation = c.groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("customers"), F.sum("n").alias("orders"), F.sum("cents").alias("cents"))
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    joined = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), zero("customers"), zero("orders"), zero("cents"))


@query("SELECT count(*) FILTER (na > nb)::BIGINT AS only_a, count(*) FILTER (nb > na)::BIGINT AS only_b, false AS equal FROM (SELECT coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT doc_id, count(*) AS na FROM documents GROUP BY 1) a FULL JOIN (SELECT vec_id, count(*) AS nb FROM embeddings GROUP BY 1) b ON doc_id = vec_id)")
def two_way_diff(spark, sf_dir) -> DataFrame:
    """Rows of one table that the other lacks."""
    return merges.two_way_difference(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("SELECT l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) = 1")
def exactly_one(spark, sf_dir) -> DataFrame:
    """Keys with one value only."""
    return business.exactly_one(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("SELECT user_id AS source, min(context) AS context FROM events JOIN (SELECT floor(value) AS token, min(event_type) AS context FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 1) ON floor(value) = token GROUP BY user_id HAVING count(DISTINCT context) = 1")
def signature_contexts(spark, sf_dir) -> DataFrame:
    """Contexts by tokens that occur in one only."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.floor("value").alias("token"), F.col("event_type").alias("context"))
    return business.signature_contexts(e.select("source", "token"), e.select("token", "context"))


@query("SELECT p_brand, min(p_partkey) AS position, arg_max(p_name, struct_pack(a := p_size, b := p_partkey)) AS p_name, max(p_size) AS p_size FROM part GROUP BY p_brand")
def last_wins_union(spark, sf_dir) -> DataFrame:
    """The row of greatest priority at the first position."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("position"), "p_name", "p_size")
    return business.last_wins(p, "p_brand", "p_size", "position")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET 200")
def offset_page(spark, sf_dir) -> DataFrame:
    """The third page of a hundred."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(200).limit(100)


@query("SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1 ORDER BY customers DESC, segment LIMIT 200")
def readonly_question(spark, sf_dir) -> DataFrame:
    """A template question through the read-only gate, in a session that sees the
    listed tables alone."""
    tables = {"customer": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders")}
    return readonly_sql.answer("customers by segment", tables)


@query("SELECT n_name, to_json(list_sort(list(s_suppkey))) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def json_collection(spark, sf_dir) -> DataFrame:
    """An array as JSON."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.sort_array(F.collect_list("s_suppkey"))).alias("suppliers"))
    return table(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "suppliers")


@query("SELECT event_id, CASE WHEN (props::JSON->>'n')::BIGINT IS DISTINCT FROM event_id % 100 THEN 'pending' ELSE 'approved' END AS status FROM events WHERE event_type IS DISTINCT FROM 'click' AND lower(coalesce(props::JSON->>'kind', '')) NOT IN ('rejected', 'deleted')")
def json_predicates(spark, sf_dir) -> DataFrame:
    """Null-safe inequality, negative lists and fields of JSON."""
    e = table(spark, sf_dir, "events")
    n, kind = F.get_json_object("props", "$.n").cast("long"), F.lower(F.coalesce(F.get_json_object("props", "$.kind"), F.lit("")))
    kept = e.filter(~F.col("event_type").eqNullSafe("click") & ~kind.isin("rejected", "deleted"))
    return kept.select("event_id", F.when(~n.eqNullSafe(F.col("event_id") % 100), "pending").otherwise("approved").alias("status"))
