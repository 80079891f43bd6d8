"""Claims parsed from statements about parts and orders, compared, and decided by tables.

Statements are made of the tables' values by one SQL expression that both engines read; each parses them on
its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statements, text
from ..operators import tables
from .registry import query, table
from .texts import PLAIN

_S, _MORE = "CAST(p_size AS STRING)", "CAST(p_size + 5 AS STRING)"
STATEMENT = f"""CASE p_partkey % 10 WHEN 0 THEN p_type || ': ≤ ' || {_S} || ' kW' WHEN 1 THEN '<b>' || p_type || '</b>：' || {_S} || '~' || {_MORE} || ' Hz'
WHEN 2 THEN p_brand || '应为' || {_S} || ' V，允许偏差±2%' WHEN 3 THEN '连接类别: AX' || {_S} WHEN 4 THEN '额定电压不小于' || {_S} || ' A' WHEN 5 THEN '&lt; ' || {_S}
WHEN 6 THEN p_name || '应符合规定的方法' WHEN 7 THEN p_type || ': (a+b)*' || {_S} WHEN 8 THEN '总计' || {_S} || '次，每模块' || CAST(p_size % 5 AS STRING) || '次' ELSE '当电压<=' || {_S} || 'kV且容量=' || {_MORE} || 'kva时适用' END"""
EVIDENCE = f"""CASE p_partkey % 4 WHEN 0 THEN p_type || ': 不应超过' || CAST(p_size * 990 + p_partkey % 3 * 10 * p_size AS STRING) || ' W' WHEN 1 THEN p_type || '：≥' || {_S} || ' Hz' WHEN 2 THEN 'another thing: 5 V' ELSE '连接类别: AX' || CAST(p_size % 9 AS STRING) END"""

_NUM, _HAN = r"[-+]?\d+(?:[.,]\d+)?", r"\x{4e00}-\x{9fff}"
_FIELD = rf"(?i)([A-Za-z_][A-Za-z0-9_]*|[{_HAN}]{{2,20}})\s*({statements.SIGNS})\s*({_NUM})\s*([A-Za-zμ%]+)?"
_OP = "CASE WHEN regexp_matches({0}, '≤|<=|不大于|不应超过') THEN 'le' WHEN regexp_matches({0}, '≥|>=|不小于|不低于') THEN 'ge' WHEN {0} LIKE '%<%' THEN 'lt' WHEN {0} LIKE '%>%' THEN 'gt' WHEN regexp_matches({0}, '至|到|~|～') THEN 'between' ELSE 'eq' END"
_NUMS = "list_transform(regexp_extract_all({0}, '" + _NUM + "'), lambda n: replace(n, ',', '.')::DOUBLE)"
_KIND = "CASE WHEN regexp_matches({0}, '[A-Za-z]') AND regexp_matches({0}, '[+*×÷/()]') THEN 'expression' WHEN regexp_full_match({0}, '[A-Za-z][A-Za-z0-9_.-]*') THEN 'enum' WHEN regexp_matches({0}, '[0-9]') THEN CASE WHEN regexp_matches({0}, '至|到|~|～') OR len(regexp_extract_all({0}, '" + _NUM + "')) >= 2 AND regexp_matches({0}, '[≤<≥>]') THEN 'range' ELSE 'quantity' END ELSE 'text' END"
_UNIT = f"nullif(regexp_extract(lower({{0}}), '{text.UNIT_WORDS}'), '')"
_COLON, _WORD = r"(?s)^([^:：]*)[:：]\s*(.+)$", r"^(.{1,120}?)(?:应为|为|等于)\s*(.+)$"
_TRIM = "regexp_replace({0}, '^[ ，,。;]+|[ ，,。;]+$', '', 'g')"
_CONCEPT = "replace(replace(lower({0}), ' ', ''), '_', '')"


def _claim_sql(p: str) -> str:
    """Columns prop and raw of plain text ``p``."""
    return f"""CASE WHEN regexp_matches({p}, '{_COLON}') THEN {_TRIM.format(f"regexp_extract({p}, '{_COLON}', 1)")} WHEN regexp_matches({p}, '{_WORD}') THEN {_TRIM.format(f"regexp_extract({p}, '{_WORD}', 1)")} ELSE {p} END AS prop,
    trim(CASE WHEN regexp_matches({p}, '{_COLON}') THEN regexp_extract({p}, '{_COLON}', 2) WHEN regexp_matches({p}, '{_WORD}') THEN regexp_extract({p}, '{_WORD}', 2) ELSE '' END) AS raw"""


def tokens_sql(x: str) -> str:
    """Concept tokens of plain text ``x``."""
    bare = f"regexp_replace({_CONCEPT.format(x)}, '{text.UNIT_WORDS}', '', 'g')"
    han = f"regexp_replace({bare}, '[^{_HAN}]', '', 'g')"
    return f"list_distinct(list_concat(list_filter(regexp_extract_all({bare}, '[a-z][a-z0-9_]*'), lambda t: length(t) > 1), CASE WHEN length({han}) = 1 THEN [{han}] ELSE list_transform(range(1, length({han})), lambda i: substr({han}, i, 2)) END))"


def similarity_sql(a: str, b: str, ta: str, tb: str) -> str:
    """Of texts a and b with their tokens."""
    x, y = _CONCEPT.format(a), _CONCEPT.format(b)
    share = f"len(list_intersect({ta}, {tb})) / least(len({ta}), len({tb}))"
    return f"CASE WHEN least(len({ta}), len({tb})) = 0 THEN 0 WHEN contains({x}, {y}) OR contains({y}, {x}) THEN greatest({share}, 0.9) ELSE {share} END"


_PARTS = f"s AS (SELECT p_partkey, {PLAIN.format(f'({STATEMENT})')} AS p, CASE p_partkey % 3 WHEN 0 THEN 'W' WHEN 1 THEN '/' END AS u, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name FROM part)"


def _parts(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumn("s", F.expr(STATEMENT))
    return rows.withColumn("u", F.when(F.col("p_partkey") % 3 == 0, "W").when(F.col("p_partkey") % 3 == 1, "/")).withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))


_TOTAL = "CASE WHEN len({0}) > 0 THEN list_sum({0}) ELSE 0 END"


@query(f"WITH {_PARTS}, c AS (SELECT p_partkey, p, {_claim_sql('p')} FROM s) SELECT p_partkey, prop AS property, raw, {_KIND.format('raw')} AS kind, {_TOTAL.format(_NUMS.format('raw'))}::DOUBLE AS total, coalesce({_UNIT.format('raw')}, {_UNIT.format('p')}) AS unit, {_OP.format('raw')} AS operator FROM c")
def statement_claims(spark, sf_dir) -> DataFrame:
    """Statements as property, value, kind, unit and comparator."""
    rows = _parts(spark, sf_dir).select("p_partkey", statements.claim(F.col("s")).alias("c")).select("p_partkey", "c.*")
    return rows.select("p_partkey", "property", "raw", "kind", F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x).alias("total"), "unit", "operator")


_REQUIREMENT = f"""WITH {_PARTS}, h AS (SELECT *, trim(regexp_extract(p, '{_WORD}', 2)) AS w, regexp_matches(p, '[0-9]') OR {_OP.format('p')} <> 'eq' AS valued, regexp_extract(p, '{_FIELD}', 0) AS con FROM s),
k AS (SELECT *, CASE WHEN regexp_matches(p, '{_COLON}') THEN 'separator' WHEN regexp_matches(p, '{_WORD}') AND (regexp_matches(w, '[0-9]') OR regexp_full_match(w, '[A-Za-z][A-Za-z0-9_.-]*')) THEN 'prescribed' WHEN con <> '' THEN 'constraint'
  WHEN valued AND name IS NOT NULL THEN 'project_and_text' WHEN valued THEN 'value_only' WHEN name IS NOT NULL THEN 'unstructured_with_project' ELSE 'unparsed' END AS split FROM h),
c AS (SELECT *, CASE split WHEN 'separator' THEN {_TRIM.format(f"regexp_extract(p, '{_COLON}', 1)")} WHEN 'prescribed' THEN {_TRIM.format(f"regexp_extract(p, '{_WORD}', 1)")} WHEN 'constraint' THEN regexp_extract(con, '{_FIELD}', 1) WHEN 'value_only' THEN '' WHEN 'unparsed' THEN p ELSE name END AS property,
  CASE split WHEN 'separator' THEN trim(regexp_extract(p, '{_COLON}', 2)) WHEN 'prescribed' THEN w WHEN 'constraint' THEN trim(substr(p, strpos(p, con) + length(regexp_extract(con, '{_FIELD}', 1)))) ELSE p END AS raw FROM k),
v AS (SELECT *, {_KIND.format('raw')} AS kind, {_NUMS.format('raw')} AS nums, coalesce({_UNIT.format('raw')}, {_UNIT.format('p')}, CASE WHEN u <> '/' THEN {_UNIT.format('u')} END) AS unit FROM c)
SELECT p_partkey, split, property, raw, kind, unit, {_OP.format('raw')} AS operator, CASE WHEN kind = 'expression' THEN 'expression' WHEN kind IN ('quantity', 'range') THEN CASE WHEN len(nums) = 1 THEN 'scalar_quantity' WHEN len(nums) > 1 THEN 'multiple_numbers' ELSE 'missing_number' END
  WHEN kind = 'enum' OR kind = 'text' AND regexp_full_match(raw, '[A-Za-z0-9_.+-]+') THEN 'categorical' ELSE 'unstructured_text' END AS reason FROM v"""


@query(_REQUIREMENT)
def requirement_claims(spark, sf_dir) -> DataFrame:
    """Requirements with the unit and project beside them, and whether they can be compared."""
    r = _parts(spark, sf_dir).select("p_partkey", statements.requirement(F.col("s"), F.col("u"), F.col("name")).alias("r"))
    return r.select("p_partkey", "r.split", "r.claim.property", "r.claim.raw", "r.claim.kind", "r.claim.unit", "r.claim.operator", "r.reason")


_SCOPED = r"(?:总(?:计|共|数|数量|次数)?|共)\s*\d+(?:\.\d+)?|(?:每|各)\s*[\x{4e00}-\x{9fff}A-Za-z][\x{4e00}-\x{9fff}A-Za-z_-]{0,15}(?:\s*\d+(?:\.\d+)?)?"


@query(f"WITH {_PARTS}, m AS (SELECT p_partkey, list_filter(regexp_extract_all(p, '{_SCOPED}'), lambda x: NOT regexp_matches(x, '^[每各]')) AS t, list_filter(regexp_extract_all(p, '{_SCOPED}'), lambda x: regexp_matches(x, '^[每各]')) AS e FROM s)"
       " SELECT p_partkey, CASE WHEN len(t) > 0 AND len(e) > 0 THEN 'mixed' WHEN len(t) > 0 THEN 'total' WHEN len(e) > 0 THEN 'per_entity' ELSE 'unknown' END AS basis, " + r"array_to_string(list_transform(t, lambda x: regexp_extract(x, '(\d+(?:\.\d+)?)$', 1)::DOUBLE::INT), ',') AS totals, array_to_string(list_transform(e, lambda x: regexp_extract(x, '^[每各]\s*([^0-9\s]+)', 1)), ',') AS entities FROM m")
def statement_scopes(spark, sf_dir) -> DataFrame:
    """Counts in all and counts for each of an entity."""
    rows = _parts(spark, sf_dir).select("p_partkey", statements.scope(F.col("s")).alias("c"))
    return rows.select("p_partkey", "c.basis", F.array_join(F.transform("c.totals", lambda x: x.cast("int").cast("string")), ",").alias("totals"), F.array_join("c.per.entity", ",").alias("entities"))


@query(f"WITH {_PARTS}, m AS (SELECT p_partkey, unnest(regexp_extract_all(p, '{_FIELD}')) AS x FROM s) SELECT p_partkey, x AS source, regexp_extract(x, '{_FIELD}', 1) AS field, {_OP.format(f'''regexp_extract(x, '{_FIELD}', 2)''')} AS operator, replace(regexp_extract(x, '{_FIELD}', 3), ',', '.')::DOUBLE AS value, nullif(lower(regexp_extract(x, '{_FIELD}', 4)), '') AS unit FROM m")
def statement_constraints(spark, sf_dir) -> DataFrame:
    """Explicit predicates, one a row."""
    return _parts(spark, sf_dir).select("p_partkey", F.explode(statements.constraints(F.col("s"))).alias("c")).select("p_partkey", "c.*")


_BASE = "CASE {0} " + " ".join(f"WHEN '{u}' THEN '{b}'" for u, (b, _) in statements.claims.UNITS.items()) + " END"
_SCALE = "CASE {0} " + " ".join(f"WHEN '{u}' THEN {k}" for u, (_, k) in statements.claims.UNITS.items()) + " END::DOUBLE"
_COMPARED = f"""WITH s AS (SELECT p_partkey, {PLAIN.format(f'({STATEMENT})')} AS p, {PLAIN.format(f'({EVIDENCE})')} AS q FROM part),
a AS (SELECT p_partkey, p, q, {_claim_sql('p')} FROM s), b AS (SELECT p_partkey, prop AS pa, raw AS ra, p, q, {_claim_sql('q').replace('AS prop', 'AS pb').replace('AS raw', 'AS rb')} FROM a),
c AS (SELECT *, {_KIND.format('ra')} AS ka, {_KIND.format('rb')} AS kb, {_NUMS.format('ra')} AS na, {_NUMS.format('rb')} AS nb, coalesce({_UNIT.format('ra')}, {_UNIT.format('p')}) AS ua, coalesce({_UNIT.format('rb')}, {_UNIT.format('q')}) AS ub, {_OP.format('ra')} AS oa, {_OP.format('rb')} AS ob, {tokens_sql('pa')} AS ta, {tokens_sql('pb')} AS tb FROM b),
d AS (SELECT *, {similarity_sql('pa', 'pb', 'ta', 'tb')} AS sim, ua <> ub AND ({_BASE.format('ua')} IS NULL OR {_BASE.format('ub')} IS NULL OR {_BASE.format('ua')} <> {_BASE.format('ub')}) AS apart, CASE WHEN ua <> ub THEN {_SCALE.format('ua')} ELSE 1 END AS fa, CASE WHEN ua <> ub THEN {_SCALE.format('ub')} ELSE 1 END AS fb,
  CASE WHEN oa IN ('le', 'lt') THEN 'upper' WHEN oa IN ('ge', 'gt') THEN 'lower' WHEN oa = 'eq' THEN 'exact' END AS da, CASE WHEN ob IN ('le', 'lt') THEN 'upper' WHEN ob IN ('ge', 'gt') THEN 'lower' WHEN ob = 'eq' THEN 'exact' END AS db FROM c),
e AS (SELECT *, CASE WHEN db = 'exact' AND da IN ('upper', 'lower') THEN oa ELSE ob END AS op, na[1] * fa AS x, nb[1] * fb AS y, abs(x - y) <= greatest(1e-12, greatest(abs(x), abs(y)) * 1e-9) AS same FROM d),
f AS (SELECT *, CASE WHEN op NOT IN ('lt', 'gt') AND same THEN 'equal' WHEN op IN ('le', 'lt') AND x < y OR op IN ('ge', 'gt') AND x > y THEN 'stricter' WHEN op IN ('le', 'lt', 'ge', 'gt') THEN 'looser' ELSE 'different' END AS tight,
  CASE WHEN sim < 0.35 THEN 'property_not_bound' WHEN ka IN ('enum', 'text') OR kb IN ('enum', 'text') THEN 'label' WHEN coalesce(apart, false) THEN 'unit_conversion_unavailable' WHEN len(na) <> 1 OR len(nb) <> 1 THEN 'non_scalar_or_ambiguous'
  WHEN da <> db AND NOT (da = 'exact' AND db IN ('upper', 'lower')) AND NOT (db = 'exact' AND da IN ('upper', 'lower')) THEN 'operator_direction_conflict' END AS why FROM e)
SELECT p_partkey, CASE why WHEN 'label' THEN CASE WHEN {_CONCEPT.format('ra')} = {_CONCEPT.format('rb')} THEN 'equal' ELSE 'different' END WHEN 'operator_direction_conflict' THEN 'conflicts' ELSE CASE WHEN why IS NOT NULL THEN 'not_comparable' WHEN op IN ('le', 'lt', 'ge', 'gt') THEN CASE WHEN tight IN ('equal', 'stricter') THEN 'supports' ELSE 'conflicts' END WHEN tight = 'equal' THEN 'equal' ELSE 'different' END END AS relation,
  CASE why WHEN 'label' THEN CASE WHEN {_CONCEPT.format('ra')} = {_CONCEPT.format('rb')} THEN 'equal' ELSE 'different' END WHEN 'operator_direction_conflict' THEN 'different' ELSE CASE WHEN why IS NOT NULL THEN 'not_comparable' ELSE tight END END AS tightness, nullif(why, 'label') AS reason FROM f"""


@query(_COMPARED)
def claim_comparisons(spark, sf_dir) -> DataFrame:
    """A part's claim against its evidence."""
    rows = table(spark, sf_dir, "part").select("p_partkey", statements.claim(F.expr(STATEMENT)).alias("a"), statements.claim(F.expr(EVIDENCE)).alias("b"))
    return rows.select("p_partkey", statements.compared(F.col("a"), F.col("b")).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, CASE WHEN a = b THEN 'equal' WHEN contains(a, b) OR contains(b, a) THEN NULL ELSE 'different' END AS relation, CASE WHEN a <> b AND (contains(a, b) OR contains(b, a)) THEN 'categorical_enumeration_ambiguous' END AS reason FROM (SELECT p_partkey, replace(lower(p_type), ' ', '') AS a, replace(lower(CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' ' || p_brand ELSE p_brand END), ' ', '') AS b FROM part)")
def categorical_comparison(spark, sf_dir) -> DataFrame:
    """Labels equal, different, or one within the other."""
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_type", "p_brand")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", statements.categorical(F.col("p_type"), other).alias("r")).select("p_partkey", "r.*")


_ROLE = " || ".join(f"CASE WHEN regexp_matches(p, '{words}'){' OR t' if role == 'nominal_rule' else ''} THEN ',{role}' ELSE '' END" for role, words in statements.ROLES.items())


@query(f"SELECT p_partkey, CASE WHEN r = '' THEN 'method_rule' ELSE substr(r, 2) END AS roles FROM (SELECT p_partkey, {_ROLE} AS r FROM (SELECT p_partkey, p_partkey % 7 = 0 AS t, {PLAIN.format(f'({STATEMENT})')} AS p FROM part))")
def evidence_role_kinds(spark, sf_dir) -> DataFrame:
    """What a text is evidence of."""
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(statements.evidence_roles(F.col("s"), F.col("p_partkey") % 7 == 0), ",").alias("roles"))


_HEADERS = {"l_quantity": "额定数量(kW)", "l_discount": "折扣比例(%)", "l_linenumber": "系统标称电压(kV)"}
_ASK = "CASE o_orderkey % 5 WHEN 0 THEN '额定数量:≤25 kW' WHEN 1 THEN '折扣比例: 0.05' WHEN 2 THEN '其他属性: 5' WHEN 3 THEN '应符合规定' ELSE '额定数量不小于10' END"
_TABLE_CLAIMS = """WITH r AS (SELECT o_orderkey AS claim_id, o_orderkey % 5 AS f, count(l_orderkey) AS cells, count(*) FILTER (l_linenumber = 2) AS n, max(l_quantity) FILTER (l_linenumber = 2) AS q, max(l_discount) FILTER (l_linenumber = 2) AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
c AS (SELECT *, CASE f WHEN 0 THEN CASE WHEN q = 25 THEN 'equal' WHEN 25 < q THEN 'stricter' ELSE 'looser' END WHEN 1 THEN CASE WHEN abs(d - 0.05) <= 1e-9 THEN 'equal' ELSE 'different' END WHEN 4 THEN CASE WHEN q = 10 THEN 'equal' WHEN 10 > q THEN 'stricter' ELSE 'looser' END END AS t FROM r),
x AS (SELECT *, CASE WHEN f = 3 THEN 'requirement_not_program_ready' WHEN f = 2 OR cells = 0 THEN 'property_not_bound' WHEN n = 0 THEN 'row_not_bound' WHEN n > 1 THEN 'row_ambiguous' ELSE t END AS reason FROM c)
SELECT claim_id, CASE WHEN reason = t THEN 'programmatic_table' ELSE 'fallback' END AS mode, CASE WHEN reason = t THEN CASE WHEN t IN ('equal', 'stricter') THEN 'supported' ELSE 'mismatch' END END AS status, reason FROM x"""


@query(_TABLE_CLAIMS)
def table_claims(spark, sf_dir) -> DataFrame:
    """An order's requirement against the table of its lines, whose line numbers are the
    voltages that the sample's 2 kV picks a row by."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.monotonically_increasing_id().alias("row"), *_HEADERS)
    # A column each, so that what is asked of some headers leaves the others unread.
    each = [lines.select("table_id", "row", F.lit(i).alias("col"), F.lit(h).alias("header"), F.col(c).cast("string").alias("value")) for i, (c, h) in enumerate(_HEADERS.items())]
    cells = each[0].unionAll(each[1]).unionAll(each[2])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderkey").alias("table_id"), F.lit("订单明细").alias("title"), F.expr(_ASK).alias("text"), F.lit("/").alias("unit"), F.lit(None).cast("string").alias("project"))
    profile = orders.select("table_id", F.lit(0).alias("place"), F.lit("voltage").alias("parameter"), F.lit(2.0).alias("target"))
    return tables.table_claims(orders, cells, profile, [_HEADERS["l_linenumber"]])
