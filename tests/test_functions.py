"""Literal cases of functions, sequences, fusion and the read-only gate."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import checks, claims, intervals, statements, text
from tallyloom.operators import evalmetrics, evidence, fusion, ledger, matching, ops, review, sequences, tables, vectors
from tallyloom.plans import readonly_sql
from tallyloom.sources import merges, readers
from tallyloom.streaming import state


def value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw,low,high,form",
    [
        ("15≤t≤60", 15, 60, "two_sided_comparator"), ("3μs~6μs", 3, 6, "range"), ("4.0(1±10%)", 3.6, 4.4, "relative_symmetric"), ("≤0.16(1+30%)", None, 0.208, "relative_one_sided"),
        ("0.3（构造值：0.3m）", 0.3, 0.3, "scalar"), ("≤1.8", None, 1.8, "bound"), ("5±0.5", 4.5, 5.5, "absolute_symmetric"), ("10至20 kV", 10, 20, "range"), ("20 kV 到 -10", -10, 20, "range"), ("100(允许偏差+5%)", 100, 105, "relative_one_sided"),
        ("IEC 60076 ≤ 15", None, 15, "bound"), ("GB/T 1094.1-2013 ≥3", 3, None, "bound"), ("≥10（1-20％）", 8, None, "relative_one_sided"), ("80 ± 5 %", 76, 84, "relative_symmetric"), ("-75.0（1±3％）", -77.25, -72.75, "relative_symmetric"), ("3 < x <= 9 mm", 3, 9, "two_sided_comparator"),
        ("4(2±10%)", 1.8, 2.2, "relative_symmetric"), ("1±0.5", 0.5, 1.5, "absolute_symmetric"), ("100（公差 - 4%）", 96, 100, "relative_one_sided"), ("-2.5", -2.5, -2.5, "scalar"), ("12 dB(A)", 12, 12, "scalar"),
    ],
)
def test_intervals(spark, raw, low, high, form):
    got = value(spark, claims.interval(F.col("x")), x=raw)
    assert got.form == form
    assert (got.low is None) == (low is None) and (low is None or abs(got.low - low) < 1e-9)
    assert (got.high is None) == (high is None) and (high is None or abs(got.high - high) < 1e-9)


@pytest.mark.parametrize("raw", ["120*(额定频率/试验频率),但不少于15s", "", None, "no number", "1, 2", "15（约 20）", "10-20"])
def test_no_interval(spark, raw):
    assert value(spark, claims.interval(F.col("x").cast("string")), x=raw) is None


@pytest.mark.parametrize("a,b,relation", [((12, 18), "10 20", "subset"), ((10, 20), "10 20", "equal"), ((5, 25), "10 20", "superset"), ((15, 25), "10 20", "overlap"), ((30, 40), "10 20", "disjoint")])
def test_interval_relation(spark, a, b, relation):
    low, high = map(float, b.split())
    assert value(spark, claims.interval_relation(*map(F.lit, (float(a[0]), float(a[1]), low, high)))) == relation


def comparison(spark, raw, value_=None, operator="eq", tolerance=None, report_operator=None, scale=1.0):
    i = lambda c, o=None: intervals.interval(F.lit(c), o)
    rop = claims.comparator(F.lit(raw)) if report_operator is None else F.lit(report_operator)
    number = F.lit(value_).cast("double")
    right = intervals.standard_interval(number.cast("string"), number, F.lit(tolerance).cast("string"), F.lit(operator))
    return value(spark, intervals.compare_intervals(i(raw, rop), right, rop, F.lit(operator), F.lit(tolerance is not None), F.lit(scale)))


def test_interval_comparison(spark):
    got = comparison(spark, "-75.0（1±3％）", 75.0, tolerance="±3%")
    assert (got.relation, got.polarity_normalized, got.center_relation) == ("equal", True, "equal")
    got = comparison(spark, "-76.0（1±3％）", 75.0, tolerance="±3%")
    assert (got.relation, got.center_relation, got.band_decides, got.delta) == ("different", "different", False, "other")
    got = comparison(spark, "≤0.18（1+30%）", 0.8)
    assert (got.relation, got.interval_relation, got.direction_resolved) == ("supports", "subset", True)
    got = comparison(spark, "≤0.18（1+30%）", 0.18, "le")
    assert (got.relation, got.reason) == ("not_comparable", "standard_tolerance_not_recorded")
    assert comparison(spark, "≤0.18（1+30%）", 0.18, "le", "+30%").relation == "equal"
    assert comparison(spark, "10~30", 20.0, "ge").interval_relation == "overlap" and comparison(spark, "10~30", 20.0, "ge").band_decides
    assert comparison(spark, "10~30", 5000.0, "le", scale=1000.0).interval_relation == "disjoint"
    assert comparison(spark, "words", 5.0).reason == "left_interval_unparseable" and comparison(spark, "1~2").reason == "right_interval_unparseable"


def test_scalar_comparison(spark):
    got = lambda a, b, o, p: value(spark, intervals.compare_scalars(F.lit(a), F.lit(b), F.lit(o), F.lit(p).cast("string")))
    flipped = got(1000.0, 1000.0, "le", "ge")
    assert (flipped.relation, flipped.comparator_state, flipped.delta) == ("conflicts", "flipped", "within_display_tolerance")
    assert got(-75.0, 75.0, "eq", "eq").polarity_normalized and got(-75.0, 75.0, "eq", "eq").relation == "equal"
    borrowed = got(1.8, 2.0, "eq", "le")
    assert (borrowed.relation, borrowed.tightness, borrowed.operator) == ("supports", "stricter", "le")
    assert got(2.5, 2.0, "le", "eq").operator == "le" and got(2.5, 2.0, "le", None).relation == "conflicts"
    near = got(60.001, 60.0, "eq", "eq")
    assert (near.relation, near.display_tolerance) == ("equal", True)
    assert got(2700.0, 270.0, "le", "le").delta == "magnitude" and got(None, 1.0, "eq", "eq").relation == "not_comparable"


def test_verdicts_of_comparisons(spark):
    v = lambda *c: tuple(value(spark, intervals.verdict(*[F.lit(x) for x in c])))
    assert v("supports", "stricter", "subset", "other", False, False, "same") == ("match", "exact", True)
    assert v("supports", "stricter", None, "other", False, False, "same") == ("match", "within_standard", True)
    assert v("equal", "equal", None, None, False, False, "converted") == ("match", "unit_equivalent", False)
    assert v("conflicts", "looser", "overlap", "other", False, True, "same") == ("mismatch", "bandwidth_exceeded", False)
    assert v("conflicts", None, None, "within_display_tolerance", True, False, "same")[1] == "comparator_flip"
    assert v("not_comparable", None, None, None, None, None, "same")[:2] == ("unevaluable", "applicability_undetermined")


def test_units_fold(spark):
    how = lambda a, b: value(spark, claims.unit_alignment(F.lit(a), F.lit(b)))
    assert [how(*p) for p in (("℃", "°C"), ("dB(A)", "dB（A）"), ("μs", "us"), ("μs", "ms"), ("MΩ", "MΩ"), ("℃", "K"), (" kV ", "V"))] == ["same", "same", "same", "converted", "same", "unavailable", "converted"]


def test_verdicts(spark):
    verdict = lambda r, ru, s, su: tuple(value(spark, claims.scalar_verdict(F.lit(r), F.lit(ru), F.lit(s), F.lit(su), F.lit("le"))))
    assert verdict(1.8, "%", 2.0, "%") == ("match", "within_standard")
    assert verdict(2.2, "%", 2.0, "%") == ("mismatch", "numeric_looser")
    assert verdict(270.0, "W", 0.27, "kW") == ("match", "unit_equivalent")
    assert verdict(270.0, "W", 0.27, "Hz") == ("unevaluable", "unit_mismatch")
    assert verdict(27.0, "kW", 0.27, "kW") == ("mismatch", "magnitude_error")


def test_texts(spark):
    assert value(spark, text.canonical(F.col("x")), x=" a　 b c\n") == "a b c"
    assert value(spark, text.standard_no(F.col("x")), x="GBT 6451-2023 oil.pdf") == "GB/T 6451-2023"
    assert value(spark, text.standard_no(F.col("x")), x="Q/GDW 12126.4-2024.pdf") == "Q/GDW 12126.4-2024"
    assert value(spark, text.standard_no(F.col("x")), x="notes.pdf") is None
    assert value(spark, text.table_references(F.col("x")), x="见表3, 如表01所示, 表2所列, 见表3") == ["3", "1", "2"]
    assert value(spark, text.first_row_columns(F.col("x")), x="<table><tr><th>A</th><td> </td><td>B&lt;</td></tr><tr><td>1</td></tr></table>") == ["A", "B<"]
    assert value(spark, text.latex(F.col("x")), x=r"\frac{\text{a}}{b} \leq 3 \times \sqrt{2}") == "(a)/(b) ≤ 3 × sqrt(2)"
    assert value(spark, text.numbered_references(F.col("x"), "clause"), x="clause 3~5, clause 7") == [3, 4, 5, 7]
    assert value(spark, text.windows(F.col("x"), F.lit("kv"), 2, 2), x="10 kV and 20 KV") == ["0 kV a", "0 KV"]
    assert value(spark, text.windows(F.col("x"), F.lit("a.b"), 2), x="aXb") == []
    assert value(spark, text.latex(F.col("x")), x=r"\mathrm{{kV}} \(U_{m}\) \leqslant 24\%") == "kV U_m ≤ 24%"
    assert value(spark, claims.numbers(F.col("x")), x="1 234,5 and -2") == [1234.5, -2.0]


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0])], "id long, v array<float>")
    got = vectors.knn(spark.createDataFrame([(9, [1.0, 0.0])], "id long, v array<float>"), rows, 5, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]
    assert value(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0
    blob = spark.createDataFrame([(bytes.fromhex("0000803f000020c0"),)], "b binary")
    assert blob.select(readers.floats(F.col("b")).alias("v")).first().v == [1.0, -2.5]


def test_unknown_types_take_places_in_turn(spark):
    rows = spark.createDataFrame([(1, i, t, i) for i, t in enumerate(["x", "table", "x", "section", "x", "table"])], "query_id long, id long, type string, rank long")
    kept = sorted(r.id for r in fusion.typed_quota_with_unknown(rows, "query_id", 2, 2).collect())
    assert kept == [0, 1, 2, 4]


def test_reserves_count_once_or_twice(spark):
    pool = spark.createDataFrame([(1, 10, 0.5)], "query_id long, id long, rrf double")
    special = spark.createDataFrame([(1, 10, 0.1, 1, 1.0), (1, 11, 0.2, 2, 1.0)], "query_id long, id long, rrf double, route_rank int, score double")
    once = {r.id: r.rrf for r in fusion.with_reserves(pool, special, ["query_id"], 3).collect()}
    twice = {r.id: r.rrf for r in fusion.with_reserves(pool, special, ["query_id"], 3, double_count=True).collect()}
    assert once == {10: 0.5, 11: 0.2} and twice == {10: 0.6, 11: 0.2}


def test_first_write_wins(spark):
    e = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "request_id string, at int, n int")
    assert sorted(map(tuple, ledger.first_writes(e, "request_id", "at").collect())) == [("a", 1, 5), ("b", 1, 7)]


def test_percentiles(spark):
    df = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "v double")
    assert df.agg(ops.percentile("v", 0.95).alias("p")).first().p == 300.0


def test_two_way_difference(spark):
    a, b = (spark.createDataFrame(x, "k int") for x in ([(1,), (1,), (None,)], [(1,), (2,)]))
    assert tuple(merges.two_way_difference(a, b).first()) == (2, 1, False)


def test_section_paths(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, "9"), (1, 1, None, "t"), (1, 2, 1.0, "11"), (1, 3, 2.0, "11.1"), (1, 4, None, "u")], "f long, o long, level double, title string")
    assert [r.path for r in sequences.section_paths(rows, "f", "o", "level", "title").orderBy("o").collect()] == ["9", "9", "11", "11 / 11.1", "11 / 11.1"]
    packed = sequences.packed(spark.createDataFrame([(1, i, 40) for i in range(5)], "k long, o long, n long"), "k", "o", "n", 100)
    assert [r.part for r in packed.orderBy("o").collect()] == [0, 0, 1, 1, 2]


def test_metrics(spark):
    best = spark.createDataFrame([(1, 0, 1), (1, 1, None), (2, 0, 4)], "case_id long, group_id long, best_rank int")
    got = {r.k: r for r in evalmetrics.recall_at(best, (1, 5)).collect()}
    assert (got[1].any_hit, got[1].strict_recall, got[5].group_recall) == (0.5, 0.0, round(2 / 3, 6))
    assert got[5].mrr == 0.625


def test_quality_tags(spark):
    df = spark.createDataFrame([("x",)], "t string").select(evidence.quality_tags({"short_text": F.length("t") < 20, "not_approved": F.lit(True), "latex_residue": F.lit(None).cast("boolean")}).alias("tags"))
    r = df.select("tags", evidence.indexable(F.col("tags")).alias("i"), evidence.needs_review(F.col("tags")).alias("n")).first()
    assert r.tags == ["short_text", "not_approved"] and not r.i and not r.n


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT 'drop'", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1", "SELECT replace('a', 'a', 'b')"])
def test_gate_rejects(sql):
    with pytest.raises(ValueError):
        readonly_sql.validate(sql)


def test_gate_session_sees_listed_tables_only(spark):
    spark.range(3).createOrReplaceTempView("hidden")
    shown = {"orders": spark.createDataFrame([("O",), ("F",), ("O",)], "o_orderstatus string")}
    rows = readonly_sql.answer("orders by status", shown)
    assert [tuple(r) for r in rows.collect()] == [("O", 2), ("F", 1)]
    assert readonly_sql.chart(rows)["denominator"] == 3
    with pytest.raises(Exception, match="hidden"):
        readonly_sql.run("SELECT * FROM hidden", shown).collect()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"u{i % 3}", i, f"2024-01-01 00:{i:02d}:00") for i in range(50)]
    events = spark.createDataFrame(rows, "key string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = state.run_to_end(state.rate_limited_stream(stream, 2, 600), spark, f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, state.rate_limited(events, 2, 600).collect()))
    once = state.run_to_end(state.reserved_once(stream, "1 hour"), spark, f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert once.count() == 3


@pytest.fixture
def odd_events(spark, tmp_path):
    """Events, and what a query's SQL gives for them with windows of an hour: a key over many batches, no key, no time, no
    id, equal times, and an hour that a clock has twice."""
    at = lambda m: f"2024-11-03 {4 + m // 60:02d}:{m % 60:02d}:00+00:00"
    rows = [("hot", i, at(7 * i % 240)) for i in range(200)] + [(None, 1, at(0)), (None, 2, at(1)), ("a", 3, None), ("a", 4, at(5)), ("a", None, at(5)), ("a", 5, at(65)), ("a", 6, at(184)), ("b", 7, None)]
    events = spark.createDataFrame(rows, "key string, event_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.select(F.col("key").alias("user_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield events, lambda name, hours: duckdb.sql(queries.oracle_sql()[name].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'").replace(f"INTERVAL {hours} HOUR", "INTERVAL 1 HOUR")).fetchall()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_limits_of_odd_events(odd_events):
    events, by_sql = odd_events
    got = sorted(map(tuple, state.rate_limited(events, 5, 3600).collect()), key=repr)
    assert got == sorted(by_sql("rate_limiter", 6), key=repr) and len(got) == 204


def test_reservations_of_odd_events(odd_events):
    events, by_sql = odd_events
    got = sorted(map(tuple, state.reserved(events, 3600).collect()), key=repr)
    assert got == sorted(by_sql("idempotency_keys", 24), key=repr) and len(got) == 7


def test_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"scope": "full", "finished_at": "2024-01-02", "cases": [{"case_id": "1", "status": "match"}]}')
    (tmp_path / "b.json").write_text('{"scope": "full"}')
    (tmp_path / "c.json").write_text("not json")
    (tmp_path / "d.checkpoint.json").write_text('{"cases": []}')
    assert [r.file for r in readers.newest_first(readers.reports(spark, str(tmp_path))).collect()] == ["a.json"]
    p = readers.prices(spark, '[{"provider": "P", "model": "M", "aliases": ["x"], "input": "1.5"}]')
    assert sorted((r.key, float(r.rate_input)) for r in p.collect()) == [("p/m", 1.5), ("x", 1.5)]


@pytest.mark.parametrize(
    "raw,kind,numbers,operator,unit",
    [("连接类别: AX12", "enum", [12.0], "eq", "a"), ("温升: 不应超过60 K", "quantity", [60.0], "le", None), ("空载损耗P0(kW):≤0.370", "quantity", [0.37], "le", "kw"), ("电压：3~6 kV", "range", [3.0, 6.0], "between", "kv"), ("值: (a+b)*2", "expression", [2.0], "eq", "a"), ("绝缘电阻应符合规定", "text", [], "eq", None)],
)
def test_claims(spark, raw, kind, numbers, operator, unit):
    c = value(spark, statements.claim(F.col("x")), x=raw)
    assert (c.kind, c.numbers, c.operator, c.unit) == (kind, numbers, operator, unit)


def test_requirements(spark):
    of = lambda t, u, p: value(spark, statements.requirement(F.col("t"), F.lit(u), F.lit(p)), t=t)
    r = of("≤ 480", "W", "空载损耗")
    assert (r.split, r.ready, r.reason, r.claim.property, r.claim.numbers, r.claim.unit) == ("project_and_text", True, "scalar_quantity", "空载损耗", [480.0], "w")
    r = of("空载损耗P0(kW):≤0.370", "kW", "完全不同的项目名称")
    assert (r.split, r.claim.property, r.claim.operator) == ("separator", "空载损耗P0(kW)", "le")
    r = of("绝缘电阻应符合规定", "/", "绝缘电阻")
    assert (r.ready, r.reason) == (False, "unstructured_text")


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("温升: 61 K", "温升: 不应超过60 K", ("conflicts", "looser", None)), ("空载损耗P0(kW):≤0.370", "空载损耗p0(W): 370", ("supports", "equal", None)), ("限值: 10 kW", "限值: 10 s", ("not_comparable", "not_comparable", "unit_conversion_unavailable")),
        ("限值: ≤10 kW", "限值: ≥10 kW", ("conflicts", "different", "operator_direction_conflict")), ("连接类别: AX12", "连接类别: AX13", ("different", "different", None)), ("温升: 61 K", "another: 60 K", ("not_comparable", "not_comparable", "property_not_bound")),
    ],
)
def test_compared_claims(spark, a, b, want):
    assert tuple(value(spark, statements.compared(statements.claim(F.col("a")), statements.claim(F.col("b"))), a=a, b=b)) == want


def test_scopes_and_roles(spark):
    s = value(spark, statements.scope(F.col("x")), x="总计12次，每模块3次")
    assert (s.basis, s.totals, [tuple(p) for p in s.per]) == ("mixed", [12.0], [("模块", 3.0)])
    text_ = "当条件成立时，应为50 kV，允许偏差±2%；按照规定方法进行测量。"
    assert value(spark, statements.evidence_roles(F.col("x"), F.lit(False)), x=text_) == ["nominal_rule", "tolerance_rule", "method_rule", "applicability_rule"]
    assert value(spark, statements.evidence_roles(F.col("x"), F.lit(False)), x="plain") == ["method_rule"]


def table_of(spark, headers, rows):
    cells = [(1, r, c, h, v) for r, row in enumerate(rows) for c, (h, v) in enumerate(zip(headers, row))]
    return spark.createDataFrame(cells, "table_id long, row long, col int, header string, value string")


@pytest.mark.parametrize(
    "rows,asked,want",
    [
        ([["12", "0.20"], ["24", "0.370"]], "空载损耗P0(KW):≤0.370", ("programmatic_table", "supported", "equal")), ([["12", "0.20"], ["24", "0.370"]], "空载损耗P0(kW): 0.5", ("programmatic_table", "mismatch", "different")),
        ([["24", "0.20"], ["24", "0.370"]], "空载损耗P0(kW): 0.5", ("fallback", None, "row_ambiguous")), ([["≤35", "1"], ["24", "0.5"]], "空载损耗P0(kW): 0.5", ("programmatic_table", "supported", "equal")),
        ([["10", "0.2"]], "空载损耗P0(kW): 0.5", ("fallback", None, "row_not_bound")), ([["24", "1"]], "持续时间(s): 5", ("fallback", None, "property_not_bound")), ([["24", "1"]], "应符合规定", ("fallback", None, "requirement_not_program_ready")),
    ],
)
def test_table_claims(spark, rows, asked, want):
    cells = table_of(spark, ["系统标称电压(kV)", "空载损耗P0(kW)"], rows)
    r = spark.createDataFrame([(7, 1, None, asked, "/", None)], "claim_id long, table_id long, title string, text string, unit string, project string")
    profile = spark.createDataFrame([(1, 0, "voltage", 24.0)], "table_id long, place int, parameter string, target double")
    (got,) = tables.table_claims(r, cells, profile, ["系统标称电压(kV)"]).collect()
    assert (got.mode, got.status, got.reason) == want


def test_a_fold_goes_by_batches_and_not_by_keys(spark):
    """Short keys share a batch, long ones have many; null keys are one, and a null size ends what is told by sizes."""
    sizes = {k: [(i * 7 + (k or 3)) % 50 for i in range((k or 0) % 9 * 3 + 1)] for k in [None, *range(60)]}
    rows = spark.createDataFrame([(k, i, n) for k, ns in sizes.items() for i, n in enumerate(ns)] + [(99, 0, 90), (99, 1, None), (99, 2, 90)], "k long, o long, n long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = sequences.packed(rows, "k", "o", "n", 100, 4)
        got = {(r.k, r.o): r.part for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()  # a table of pandas' for each key took a millisecond
    for k, ns in sizes.items():
        part, held, n = 0, 0, 0
        for i, s in enumerate(ns):
            if n and (held + s > 100 or n >= 4):
                part, held, n = part + 1, 0, 0
            held, n = held + s, n + 1
            assert got[k, i] == part
    assert [got[99, i] for i in range(3)] == [0, 0, 0]


def test_patterns_of_words_and_of_none(spark):
    docs = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (2, "xone two  three"), (3, None), (4, "")], "doc_id long, text string")
    patterns = spark.createDataFrame([(10, "ne two thr"), (11, "two"), (12, ""), (13, None), (14, "one two three"), (15, "a b c"), (16, " two ")], "pattern_id long, text string")
    got = sorted(map(tuple, matching.containing(docs, patterns).collect()))
    assert got == [(10, 1), (10, 1), (11, 1), (11, 1), (11, 2), (14, 1), (14, 1), (16, 1), (16, 1), (16, 2)]


def test_few_patterns_shuffle_nothing(spark, monkeypatch):
    """They are looked for where texts are read, with the same rows as by keys and blocks."""
    texts = ["one two three four five " * 3, "two three", None, "xone two three fourx", "", "five one"]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    patterns = spark.createDataFrame([(i % 90, f"{w} two three f" if i % 7 == 0 else f"{w}{i}") for i, w in enumerate(["one", "two", "five"] * 40)], "pattern_id long, text string")
    found = matching.containing(docs, patterns)
    got = sorted(map(tuple, found.collect()))
    assert got and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "CHARS", 10)
    assert got == sorted(map(tuple, matching.containing(docs, patterns).collect()))


def test_many_short_patterns(spark, monkeypatch):
    import random

    rng = random.Random(9)
    texts = ["".join(rng.choice("abé \n") for _ in range(rng.randrange(60))) for _ in range(50)] + [None, "aé"]
    short = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = spark.createDataFrame([(i, t) for i, t in enumerate(short)], "pattern_id long, text string")
    want = sorted((p, d) for p, t in enumerate(short) for d, x in enumerate(texts) if x and t in x)
    assert sorted(map(tuple, matching.containing(docs, patterns).collect())) == want
    monkeypatch.setattr(matching, "BLOCK", 40)
    monkeypatch.setattr(matching, "TEXT_BYTES", 300)
    assert sorted(map(tuple, matching.containing(docs, patterns).collect())) == want


def test_checks(spark):
    q = "变压器空载损耗限值 GB/T 6451-2023 24.0 kV"
    issue = lambda w: value(spark, checks.rewrite_issue(F.lit(q), F.col("w")), w=w)
    assert [issue(w) for w in ("变压器空载损耗 gb/t6451-2023 24", "变压器空载损耗 IEC 60076", "变压器空载损耗 25", "损耗", " ")] == [None, "standard", "number", "anchor", "omitted"]
    assert tuple(value(spark, checks.split_caption(F.lit("110"), F.lit("kV 套管"), F.lit(None).cast("int")))) == ("1", "10kV 套管")
    assert tuple(value(spark, checks.split_caption(F.lit("12"), F.lit("标题"), F.lit(11)))) == ("12", "标题")
    assert tuple(value(spark, checks.verdict_text(F.col("x")), x='{"verdict": "match"}')) == ("match", "strict")
    assert value(spark, checks.repaired(F.col("x")), x="ü ö ß".encode().decode("latin-1")) == "ü ö ß"


def test_cards(spark):
    cards = spark.createDataFrame([(1, 0, "k", "r", "limit 5", "5"), (1, 1, "k", "r", "limit 5", "5"), (1, 2, "k", "r", "limit 5", "6"), (1, 3, "z", "r", "x", ""), (1, 4, "k", "q", "limit", "")], "case_id long, position int, key string, role string, quote string, value string")
    sources = spark.createDataFrame([("k", "the limit 5 kV", ["r"])], "key string, source string, roles array<string>")
    got = {r.position: r.issue for r in review.checked_cards(cards, sources).collect()}
    assert got == {0: None, 1: "repeated", 2: "number", 3: "unknown_key", 4: "role"}


def spread(spark, df):
    """Rows of the fullest partition, with nothing merged or broadcast."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        return max(r["count"] for r in df().groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_cards_of_one_key_are_dealt_out(spark):
    cards = spark.range(2000).select(F.col("id").alias("case_id"), F.lit(0).alias("position"), F.when(F.col("id") % 10 < 8, "z").when(F.col("id") % 10 == 8, "k").alias("key"), F.lit("r").alias("role"), F.lit("limit 5").alias("quote"), F.lit("5").alias("value"))
    sources = spark.createDataFrame([("k", "the limit 5 kV", ["r"])], "key string, source string, roles array<string>")
    checked = lambda: review.checked_cards(cards, sources, part=100)
    assert {tuple(r) for r in checked().groupBy("key", "issue").count().collect()} == {("z", "unknown_key", 1600), (None, "unknown_key", 200), ("k", None, 200)}
    assert spread(spark, checked) < 1000


def test_claims_of_one_text_are_dealt_out(spark):
    ids = spark.range(600)
    asked = ids.select(F.col("id").alias("claim_id"), F.col("id").alias("table_id"), F.lit("t").alias("title"), F.when(F.col("id") < 500, "额定数量:≤25 kW").alias("text"), F.lit("/").alias("unit"), F.lit(None).cast("string").alias("project"))
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.lit(h).alias("header"), F.lit(v).alias("value")) for i, (h, v) in enumerate((("额定数量(kW)", "30"), ("电压(kV)", "2")))]))
    cells = ids.select(F.col("id").alias("table_id"), F.lit(1).cast("long").alias("row"), cell.alias("c")).select("table_id", "row", "c.*")
    profile = ids.select(F.col("id").alias("table_id"), F.lit(0).alias("place"), F.lit("voltage").alias("parameter"), F.lit(2.0).alias("target"))
    claims = lambda: tables.table_claims(asked, cells, profile, ["电压(kV)"])
    got = claims().groupBy("mode", "status", "reason").count().collect()
    assert {tuple(r) for r in got} == {("programmatic_table", "supported", "stricter", 500), ("fallback", None, "requirement_not_program_ready", 100)}
    assert spread(spark, claims) < 300
