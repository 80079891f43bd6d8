"""Claims, units and intervals over lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import claims, intervals
from .registry import query, table

_UNIT = "CASE l_linenumber % 4 WHEN 0 THEN 'W' WHEN 1 THEN 'kW' WHEN 2 THEN 'Hz' ELSE '' END"
_INF = "'infinity'::DOUBLE"


@query(f"SELECT u AS unit, count(*) AS n, count(*) FILTER (u = 'kW') AS same, count(*) FILTER (u = 'W') AS converted, count(*) FILTER (u = 'Hz') AS unavailable, count(*) FILTER (u = '') AS one_sided, round(sum(l_quantity * CASE u WHEN 'kW' THEN 1000 ELSE 1 END), 2) AS total FROM (SELECT *, {_UNIT} AS u FROM lineitem) GROUP BY u")
def unit_convert_compare(spark, sf_dir) -> DataFrame:
    """Each line's unit against kW."""
    l = table(spark, sf_dir, "lineitem").withColumn("unit", F.expr(_UNIT))  # noqa: E741
    how = claims.unit_alignment(F.col("unit"), F.lit("kW"))
    count = lambda k: F.count_if(how == k).alias(k)
    return l.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), count("same"), count("converted"), count("unavailable"), count("one_sided"), F.round(F.sum(claims.in_base(F.col("l_quantity"), F.col("unit"))), 2).alias("total"))


_REL = """WITH r AS (SELECT l_linenumber % 5 AS k, l_quantity AS la, l_quantity + l_partkey % 20 AS ha, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 10.0::DOUBLE END AS lb, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE 30.0::DOUBLE END AS hb FROM lineitem),
x AS (SELECT la, ha, coalesce(lb, -INF) AS lb, coalesce(hb, INF) AS hb, CASE WHEN lb IS NULL THEN 0 ELSE greatest(1e-6, abs(lb) * 1e-4) END AS tl, CASE WHEN hb IS NULL THEN 0 ELSE greatest(1e-6, abs(hb) * 1e-4) END AS th FROM r)""".replace("INF", _INF)


@query(_REL + " SELECT CASE WHEN abs(la - lb) <= greatest(1e-6, abs(lb) * 1e-4) AND lb > -'infinity'::DOUBLE AND abs(ha - hb) <= greatest(1e-6, abs(hb) * 1e-4) AND hb < 'infinity'::DOUBLE THEN 'equal' WHEN la >= lb - tl AND ha <= hb + th THEN 'subset' WHEN ha < lb - tl OR la > hb + th THEN 'disjoint' WHEN la <= lb + tl AND ha >= hb - th THEN 'superset' ELSE 'overlap' END AS relation, count(*) AS n FROM x GROUP BY 1")
def interval_relation(spark, sf_dir) -> DataFrame:
    """lines' intervals against [10, 30], open at some ends."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    low, high = F.when(F.col("l_suppkey") % 7 != 0, 10.0), F.when(F.col("l_suppkey") % 11 != 0, 30.0)
    rel = claims.interval_relation(F.col("l_quantity"), F.col("l_quantity") + F.col("l_partkey") % 20, low, high)
    return l.groupBy(rel.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


_Q = "CAST(l_partkey + CAST(l_quantity AS BIGINT) AS STRING)"
_RAW = f"CASE (l_partkey + l_linenumber) % 10 WHEN 0 THEN {_Q} || '(1±10%) kV' WHEN 1 THEN '≤' || {_Q} WHEN 2 THEN {_Q} || '±2' WHEN 3 THEN '5≤t≤' || {_Q} WHEN 4 THEN {_Q} || 'μs～60μs' WHEN 5 THEN '≥' || {_Q} || '（1-20％）' WHEN 6 THEN {_Q} || '，' || l_returnflag || '3' WHEN 7 THEN {_Q} || '至' || CAST(l_partkey + 70 AS STRING) || ' kV' WHEN 8 THEN {_Q} || '(允许偏差+5%)' ELSE 'IEC 60076 ≤ ' || {_Q} END"
_FOUND = r"""WITH r AS (SELECT raw, count(*) AS n, replace(translate(raw, '（）％～', '()%~'), 'IEC 60076 ', '') AS t FROM (SELECT RAW AS raw FROM lineitem) GROUP BY raw),
m AS (SELECT raw, n, CASE WHEN t LIKE '%≤%≤%' THEN 'two_sided_comparator' WHEN t LIKE '%(1±%' THEN 'relative_symmetric' WHEN t LIKE '%(1-%' THEN 'relative_one_sided' WHEN t LIKE '%(允许偏差+%' THEN 'above' WHEN t LIKE '%±%' THEN 'absolute_symmetric' WHEN t LIKE '%~%' OR t LIKE '%至%' THEN 'range' WHEN t LIKE '≤%' THEN 'bound' END AS form,
  list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: x::DOUBLE) AS v FROM r),
k AS (SELECT *, v[1] AS a, v[len(v)] AS z FROM m)
SELECT raw, n, CASE form WHEN 'above' THEN 'relative_one_sided' ELSE coalesce(form, CASE WHEN len(list_distinct(v)) = 1 THEN 'scalar' END) END AS form,
  round(CASE form WHEN 'relative_symmetric' THEN a * 0.9::DOUBLE WHEN 'relative_one_sided' THEN a * 0.8::DOUBLE WHEN 'above' THEN a WHEN 'absolute_symmetric' THEN a - z WHEN 'bound' THEN NULL ELSE CASE WHEN form IS NULL THEN CASE WHEN len(list_distinct(v)) = 1 THEN a END ELSE least(a, z) END END, 6) AS low,
  round(CASE form WHEN 'relative_symmetric' THEN a * 1.1::DOUBLE WHEN 'relative_one_sided' THEN NULL WHEN 'above' THEN a * 1.05::DOUBLE WHEN 'absolute_symmetric' THEN a + z WHEN 'bound' THEN a ELSE CASE WHEN form IS NULL THEN CASE WHEN len(list_distinct(v)) = 1 THEN a END ELSE greatest(a, z) END END, 6) AS high FROM k""".replace("RAW", _RAW)


@query(_FOUND)
def interval_parse(spark, sf_dir) -> DataFrame:
    """Values with tolerances, bounds, deviations and ranges as intervals. Each text is parsed once,
    however many lines have it."""
    texts = table(spark, sf_dir, "lineitem").groupBy(F.expr(_RAW).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    i = texts.select("raw", "n", claims.interval(F.col("raw")).alias("i"))
    return i.select("raw", "n", "i.form", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query("SELECT CASE WHEN o NOT IN ('lt', 'gt') AND near THEN 'equal' WHEN o IN ('le', 'lt') AND a < b OR o IN ('ge', 'gt') AND a > b THEN 'stricter' WHEN o = 'eq' THEN 'different' ELSE 'looser' END AS tightness, o AS operator, count(*) AS n FROM (SELECT l_quantity AS a, 25.0::DOUBLE AS b, abs(l_quantity - 25) <= greatest(1e-12, greatest(l_quantity, 25) * 1e-9) AS near, list_extract(['le', 'ge', 'lt', 'gt', 'eq'], (l_linenumber % 5 + 1)::INT) AS o FROM lineitem) GROUP BY 1, 2")
def bound_tightness(spark, sf_dir) -> DataFrame:
    """D12."""
    op = F.element_at(F.array(*map(F.lit, ("le", "ge", "lt", "gt", "eq"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    l = table(spark, sf_dir, "lineitem").withColumn("operator", op)  # noqa: E741
    t = claims.bound_tightness(F.col("l_quantity"), F.lit(25.0), F.col("operator"))
    return l.groupBy(t.alias("tightness"), "operator").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN list_contains(s, 'unresolved') THEN 'unresolved' WHEN list_contains(s, 'failed') THEN 'not_applicable' ELSE 'applicable' END AS state, count(*) AS n FROM (SELECT [CASE WHEN l_suppkey % 9 = 0 THEN 'unresolved' WHEN l_quantity <= 30 THEN 'satisfied' ELSE 'failed' END, CASE WHEN l_discount >= 0.02 THEN 'satisfied' ELSE 'failed' END] AS s FROM lineitem) GROUP BY 1")
def constraint_states(spark, sf_dir) -> DataFrame:
    """Unknown values leave a constraint unresolved."""
    q = F.when(F.col("l_suppkey") % 9 != 0, F.col("l_quantity"))
    s = F.array(claims.constraint_state(q, F.lit("le"), F.lit(30.0)), claims.constraint_state(F.col("l_discount"), F.lit("ge"), F.lit(0.02)))
    return table(spark, sf_dir, "lineitem").groupBy(claims.applicability(s).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT l_quantity AS a, CASE WHEN l_linenumber % 4 = 0 THEN 'kW' ELSE 'W' END AS ua FROM lineitem), w AS (SELECT *, a * CASE ua WHEN 'kW' THEN 1000 ELSE 1 END AS x FROM v), r AS (SELECT CASE WHEN abs(x - 25) <= greatest(1e-6, greatest(x, 25) * 1e-4) THEN CASE WHEN ua = 'W' THEN 'equal' ELSE 'unit_equivalent' END WHEN x <= 25 THEN 'within_standard' WHEN x / 25 >= 10 OR x / 25 <= 0.1 THEN 'magnitude_error' ELSE 'numeric_looser' END AS kind FROM w) SELECT kind, CASE WHEN kind IN ('equal', 'unit_equivalent', 'within_standard') THEN 'match' ELSE 'mismatch' END AS verdict, CASE WHEN kind IN ('equal', 'unit_equivalent', 'within_standard') THEN 'supported' ELSE 'mismatch' END AS reported, count(*) AS n FROM r GROUP BY kind")
def scalar_verdicts(spark, sf_dir) -> DataFrame:
    """A line's value against at most 25 W."""
    unit = F.when(F.col("l_linenumber") % 4 == 0, "kW").otherwise("W")
    v = claims.scalar_verdict(F.col("l_quantity"), unit, F.lit(25.0), F.lit("W"), F.lit("le"))
    rows = table(spark, sf_dir, "lineitem").select(v.alias("v")).select("v.kind", "v.verdict")
    return rows.groupBy("kind", "verdict", claims.reported(F.col("verdict")).alias("reported")).agg(F.count(F.lit(1)).alias("n"))


_TEXT = "CASE o_orderkey % 5 WHEN 0 THEN '≤' WHEN 1 THEN '不小于' WHEN 2 THEN '<' WHEN 3 THEN '>' ELSE ':' END || CAST(o_orderkey AS STRING) || ' kV, 1 234,5 and -2; ' || o_orderpriority || ' x' || CAST(o_custkey % 100 AS STRING) || '.25'"


@query(r"SELECT o_orderkey, len(v)::INT AS n, round(list_sum(v), 6) AS total, CASE WHEN regexp_matches(t, '≤|<=') THEN 'le' WHEN regexp_matches(t, '≥|>=|不小于') THEN 'ge' WHEN t LIKE '%<%' THEN 'lt' WHEN t LIKE '%>%' THEN 'gt' WHEN regexp_matches(t, '至|到|~') THEN 'between' ELSE 'eq' END AS comparator FROM (SELECT o_orderkey, t, list_transform(regexp_extract_all(regexp_replace(t, '([0-9])\s+([0-9]{3}(?:[^0-9]|$))', '\1\2', 'g'), '[-+]?\d+(?:[.,]\d+)?'), lambda n: replace(n, ',', '.')::DOUBLE) AS v FROM (SELECT o_orderkey, " + _TEXT + " AS t FROM orders))")
def number_extraction(spark, sf_dir) -> DataFrame:
    """The numbers and the comparator of a text."""
    t = F.expr(_TEXT)
    found = claims.numbers(t)
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(found).alias("n"), F.round(total, 6).alias("total"), claims.comparator(t).alias("comparator"))


_COMPARED = r"""WITH b AS (SELECT (l_partkey % 5)::INT AS k, (l_orderkey % 4)::INT AS r, floor(l_quantity) AS a, (20 + l_suppkey % 5 * 5)::DOUBLE AS s, CASE WHEN l_partkey % 5 = 0 AND l_returnflag = 'R' THEN -floor(l_quantity) ELSE floor(l_quantity) END AS c FROM lineitem),
i AS (SELECT *, CASE k WHEN 0 THEN c - abs(c) * 0.05::DOUBLE WHEN 1 THEN NULL ELSE a END AS l0, CASE k WHEN 0 THEN c + abs(c) * 0.05::DOUBLE WHEN 2 THEN a + 10 WHEN 4 THEN NULL ELSE a END AS h0, CASE WHEN k IN (0, 3) THEN c END AS lc0,
  CASE r WHEN 0 THEN s * 0.95::DOUBLE WHEN 1 THEN NULL ELSE s END AS l1, CASE r WHEN 0 THEN s * 1.05::DOUBLE WHEN 3 THEN NULL ELSE s END AS h1, k = 0 AND r <> 0 AND abs(c - s) <= greatest(1e-6, s * 1e-4) AS unrecorded, r = 2 AND k IN (1, 4) AS to_right, k = 3 AND r IN (1, 3) AS to_left FROM b),
d AS (SELECT *, CASE WHEN to_left AND r = 1 THEN NULL ELSE l0 END AS la, CASE WHEN to_left AND r = 3 THEN NULL ELSE h0 END AS ha, CASE WHEN to_right AND k = 1 THEN NULL ELSE l1 END AS lb, CASE WHEN to_right AND k = 4 THEN NULL ELSE h1 END AS hb FROM i),
p AS (SELECT *, (k IN (0, 2) OR k = 3 AND NOT to_left) AND coalesce(ha < 0, false) AND coalesce(lb >= 0, false) AS mirrored FROM d),
m AS (SELECT * REPLACE (CASE WHEN mirrored THEN -ha ELSE la END AS la, CASE WHEN mirrored THEN -la ELSE ha END AS ha), CASE WHEN mirrored THEN -lc0 ELSE lc0 END AS lc FROM p),
x AS (SELECT *, coalesce(la, -INF) AS x0, coalesce(ha, INF) AS x1, coalesce(lb, -INF) AS y0, coalesce(hb, INF) AS y1, coalesce(lc, (la + ha) / 2, la, ha) AS lm, coalesce(CASE WHEN r IN (0, 2) THEN s END, (lb + hb) / 2, lb, hb) AS rm FROM m),
t AS (SELECT *, CASE WHEN lb IS NULL THEN 0 ELSE greatest(1e-6, abs(lb) * 1e-4) END AS tl, CASE WHEN hb IS NULL THEN 0 ELSE greatest(1e-6, abs(hb) * 1e-4) END AS th FROM x),
q AS (SELECT *, CASE WHEN (CASE WHEN isinf(x0) OR isinf(y0) THEN x0 = y0 ELSE abs(x0 - y0) <= tl END) AND (CASE WHEN isinf(x1) OR isinf(y1) THEN x1 = y1 ELSE abs(x1 - y1) <= th END) THEN 'equal' WHEN x0 >= y0 - tl AND x1 <= y1 + th THEN 'subset' WHEN x1 < y0 - tl OR x0 > y1 + th THEN 'disjoint' WHEN x0 <= y0 + tl AND x1 >= y1 - th THEN 'superset' ELSE 'overlap' END AS sets,
  CASE WHEN k = 0 AND r = 0 THEN CASE WHEN abs(lc - s) <= greatest(1e-6, s * 1e-4) THEN 'equal' ELSE 'different' END END AS center FROM t),
v AS (SELECT *, coalesce(center = 'different', false) AS off, CASE WHEN center = 'different' THEN lc ELSE lm END AS da, CASE WHEN center = 'different' THEN s ELSE rm END AS db FROM q),
o AS (SELECT CASE WHEN unrecorded THEN 'not_comparable' WHEN off THEN 'different' WHEN sets = 'equal' THEN 'equal' WHEN sets = 'subset' THEN 'supports' ELSE 'conflicts' END AS relation, CASE WHEN unrecorded THEN NULL WHEN off THEN 'different' WHEN sets = 'equal' THEN 'equal' WHEN sets = 'subset' THEN 'stricter' ELSE 'looser' END AS tightness,
  CASE WHEN NOT unrecorded THEN sets END AS interval_relation, CASE WHEN NOT unrecorded THEN center END AS center_relation, CASE WHEN unrecorded THEN NULL WHEN abs(da - db) <= greatest(1e-6, abs(db) * 1e-4) THEN 'within_display_tolerance' WHEN da = 0 OR db = 0 THEN 'other' WHEN abs(da) / abs(db) >= 10 OR abs(da) / abs(db) <= 0.1 THEN 'magnitude' ELSE 'other' END AS delta,
  NOT unrecorded AND NOT off AND sets IN ('superset', 'overlap') AS band_decides, NOT unrecorded AND (to_left OR to_right) AS direction_resolved, NOT unrecorded AND mirrored AS polarity_normalized, CASE WHEN unrecorded THEN 'standard_tolerance_not_recorded' END AS reason FROM v)
SELECT *, CASE WHEN relation = 'not_comparable' THEN 'applicability_undetermined' WHEN relation IN ('equal', 'supports') THEN CASE WHEN interval_relation = 'subset' THEN 'exact' WHEN tightness = 'stricter' THEN 'within_standard' ELSE 'exact' END WHEN delta = 'magnitude' THEN 'magnitude_error' WHEN band_decides THEN 'bandwidth_exceeded' ELSE 'numeric_looser' END AS kind, count(*) AS n FROM o GROUP BY ALL""".replace("INF", _INF)


@query(_COMPARED)
def interval_comparison(spark, sf_dir) -> DataFrame:
    """Reported bands, bounds, ranges and numbers against recorded ones with and without tolerance. A pair
    of texts is compared once, however many lines have it."""
    a, k, r = F.floor("l_quantity").cast("string"), F.col("l_partkey") % 5, F.col("l_orderkey") % 4
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("")
    raw = F.when(k == 0, F.concat(sign, a, F.lit("（1±5％）"))).when(k == 1, F.concat(F.lit("≤"), a)).when(k == 2, F.concat(a, F.lit("~"), (F.floor("l_quantity") + 10).cast("string"))).when(k == 3, a).otherwise(F.concat(F.lit("≥"), a))
    op = F.when(r == 1, "le").when(r == 3, "ge").otherwise("eq")
    rows = table(spark, sf_dir, "lineitem").groupBy(raw.alias("raw"), (20 + F.col("l_suppkey") % 5 * 5).alias("s"), op.alias("op"), F.when(r == 0, "±5%").alias("tolerance")).agg(F.count(F.lit(1)).alias("n"))
    own = claims.comparator(F.col("raw"))
    right = intervals.standard_interval(F.col("s").cast("string"), F.col("s").cast("double"), F.col("tolerance"), F.col("op"))
    got = rows.select("n", intervals.compare_intervals(intervals.interval(F.col("raw"), own), right, own, F.col("op"), F.col("tolerance").isNotNull()).alias("c")).select("n", "c.*")
    kind = intervals.verdict(*[F.col(c) for c in ("relation", "tightness", "interval_relation", "delta")], F.lit(False), F.col("band_decides"), F.lit("same"))["kind"]
    kept = [c for c in got.columns if c != "n"]
    return got.withColumn("kind", kind).groupBy(*kept, "kind").agg(F.sum("n").alias("n"))


_SCALARS = """WITH b AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS a0, (l_suppkey % 5 * 10)::DOUBLE AS b, list_extract(['le', 'ge', 'eq', 'between', 'lt', 'gt'], (l_partkey % 6 + 1)::INT) AS lo, coalesce(list_extract(['le', 'ge', 'eq', NULL, 'tolerance'], (l_orderkey % 5 + 1)::INT), 'eq') AS ro FROM lineitem),
d AS (SELECT *, lo IN ('eq', 'between') AND ro IN ('eq', 'tolerance') AND a0 < 0 AND b >= 0 AS flip, CASE WHEN lo IN ('le', 'lt') THEN 'upper' WHEN lo IN ('ge', 'gt') THEN 'lower' WHEN lo = 'eq' THEN 'exact' END AS ld, CASE ro WHEN 'le' THEN 'upper' WHEN 'ge' THEN 'lower' WHEN 'eq' THEN 'exact' END AS rd FROM b),
e AS (SELECT *, CASE WHEN flip THEN abs(a0) ELSE a0 END AS a, coalesce(ld = 'exact' AND rd IN ('upper', 'lower'), false) AS br, coalesce(rd = 'exact' AND ld IN ('upper', 'lower'), false) AS bl FROM d),
f AS (SELECT *, NOT br AND NOT bl AND coalesce(ld <> rd, false) AS against, CASE WHEN bl THEN lo ELSE ro END AS op FROM e),
g AS (SELECT *, CASE WHEN op NOT IN ('lt', 'gt') AND abs(a - b) <= greatest(1e-12, greatest(abs(a), abs(b)) * 1e-9) THEN 'equal' WHEN op IN ('le', 'lt') AND a < b OR op IN ('ge', 'gt') AND a > b THEN 'stricter' WHEN op IN ('le', 'lt', 'ge', 'gt') THEN 'looser' ELSE 'different' END AS t0,
  CASE WHEN abs(a - b) <= greatest(1e-6, abs(b) * 1e-4) THEN 'within_display_tolerance' WHEN a = 0 OR b = 0 THEN 'other' WHEN abs(a) / abs(b) >= 10 OR abs(a) / abs(b) <= 0.1 THEN 'magnitude' ELSE 'other' END AS delta FROM f),
h AS (SELECT *, NOT against AND t0 IN ('looser', 'different') AND delta = 'within_display_tolerance' AS near, CASE WHEN near THEN 'equal' ELSE t0 END AS t FROM g)
SELECT CASE WHEN against THEN 'conflicts' WHEN op IN ('le', 'lt', 'ge', 'gt') THEN CASE WHEN t IN ('equal', 'stricter') THEN 'supports' ELSE 'conflicts' END ELSE CASE WHEN t = 'equal' THEN 'equal' ELSE 'different' END END AS relation, CASE WHEN NOT against THEN t END AS tightness, CASE WHEN against THEN 'flipped' WHEN br OR bl OR ld IS NOT DISTINCT FROM rd THEN 'aligned' ELSE 'mixed' END AS comparator_state,
  CASE WHEN NOT against THEN op END AS operator, delta, flip AS polarity_normalized, near AS display_tolerance, NULL::VARCHAR AS reason, count(*) AS n FROM h GROUP BY ALL"""


@query(_SCALARS)
def scalar_comparison(spark, sf_dir) -> DataFrame:
    """Numbers with borrowed and opposite directions, polarity and display tolerance."""
    a = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    c = intervals.compare_scalars(a, (F.col("l_suppkey") % 5 * 10).cast("double"), pick(("le", "ge", "eq", "between", "lt", "gt"), F.col("l_partkey") % 6), pick(("le", "ge", "eq", None, "tolerance"), F.col("l_orderkey") % 5))
    got = table(spark, sf_dir, "lineitem").select(c.alias("c")).select("c.*")
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n"))
