"""Judgments, selections, profiles, gold sets and replays: literal cases."""

import json
import random

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import judgments
from tallyloom.operators import gold, review


def issues(spark, status, evidence=(), **comparison):
    df = spark.createDataFrame([(status, comparison or None, list(evidence))], f"status string, c struct<{judgments.COMPARISON.replace(' string', ':string')}>, evidence array<string>")
    return df.select(judgments.consistency_issues(F.col("status"), F.col("c"), F.col("evidence")).alias("i")).first().i


def test_consistency(spark):
    tolerance = dict(kind="tolerance", report_value="4.0", report_unit="%", standard_value="4.0", standard_unit="%", relation="equal", conclusion="supports")
    assert "relation_not_as_computed" in issues(spark, "supported", ["4.0 %"], **tolerance, report_tolerance="20%", standard_tolerance="10%")
    assert issues(spark, "mismatch", **{**tolerance, "report_value": "1.0", "standard_value": "0.5", "relation": "looser", "conclusion": "conflicts"}) == []
    chain = dict(kind="tolerance", report_value="60", report_unit="kV", standard_value="60", standard_unit="kV", report_tolerance="3%", standard_tolerance="3%", relation="equal", conclusion="supports")
    assert issues(spark, "supported", ["Um 12 kV | 60 kV", "±3%"], **chain) == []
    assert issues(spark, "supported", ["160 kV, 60.5 kV", "±3%"], **chain) == ["nominal_not_in_evidence"]
    assert issues(spark, "supported") == [] and issues(spark, "supported", kind="guess") == ["invalid_kind"]
    assert issues(spark, "supported", kind="text", report_value="≤5") == ["numbers_as_text"] and issues(spark, "supported", kind="text", report_value="Dyn11") == []
    bound = dict(kind="upper_bound", report_operator="le", standard_operator="le", report_value="1,8", standard_value="2.0", relation="stricter", conclusion="supports")
    assert issues(spark, "supported", **bound) == []
    assert issues(spark, "supported", **{**bound, "standard_operator": "ge"}) == ["relation_not_as_computed", "supports_what_is_off", "supported_but_off"]
    assert issues(spark, "mismatch", **{**bound, "conclusion": "conflicts"}) == ["conflicts_with_what_holds"]
    assert issues(spark, "supported", **{**bound, "report_unit": "kV", "standard_unit": "V", "relation": "equal"}) == []
    assert issues(spark, "supported", **{**bound, "kind": "scope_count", "report_value": "2", "relation": "equal"}) == ["relation_not_as_computed", "supports_what_is_off", "supported_but_off"]


def state(spark, raw, sources=(("c01", "candidate 1 exact rule text"), ("c02", "other"))):
    df = spark.createDataFrame([(raw if raw is None or isinstance(raw, str) else json.dumps(raw), list(sources))], "raw string, s array<struct<key:string,text:string>>")
    return df.select(judgments.selection_state(F.col("raw"), F.col("s")).alias("x")).first().x


def test_selections(spark):
    item = {"candidate_key": "c01", "quote": "candidate 1 exact rule text", "reason": "r"}
    base = {"retained": [item], "unresolved": [], "conflicts": [], "evidence_sufficient": True}
    got = state(spark, base)
    assert got.ok and got.sufficient and [tuple(r) for r in got.retained] == [("c01", item["quote"], "r")] and got.discarded == []
    bad = state(spark, {**base, "retained": [{**item, "quote": "fabricated rule text"}]})
    assert not bad.ok and bad.error == "selector retained no grounded evidence" and "not a source substring" in bad.discarded[0] and bad.retained is None
    assert "unavailable candidate_key" in state(spark, {**base, "retained": [{**item, "candidate_key": "c09"}]}).discarded[0]
    some = state(spark, {**base, "retained": [{**item, "quote": "made up"}, item, item, {**item, "quote": "x" * 1601}, "text", {**item, "candidate_key": "c02", "quote": "oth"}]})
    assert some.ok and [r.candidate_key for r in some.retained] == ["c01", "c02"]
    assert some.discarded == ["retained[0] quote is not a source substring", "retained[3] has invalid quote length", "retained[4] is not an object"]
    clash = state(spark, {**base, "conflicts": [{"candidate_keys": ["c01", "c02"]}, {"candidate_keys": ["c01"], "description": " d "}]})
    assert [tuple(c) for c in clash.conflicts] == [(["c01"], "d")] and clash.discarded == ["conflicts[0] dropped because its evidence was not retained"]
    errors = {"[1]": "selector output is not an object", "no json": "selector output is not an object", '{"retained": 5}': "selector output has no retained array"}
    assert {k: state(spark, k).error for k in errors} == errors and state(spark, None).error == "selector output is not an object"
    assert state(spark, {**base, "retained": [item] * 9}).error == "retained count exceeds 8"
    assert state(spark, {**base, "unresolved": [1]}).error == "unresolved must be a string array" and state(spark, {**base, "conflicts": "c"}).error == "conflicts must be an array"
    assert state(spark, {**base, "conflicts": [{"candidate_keys": ["c07"]}]}).error == "conflicts has invalid candidate_keys"
    empty = state(spark, {"retained": [], "unresolved": [" a ", " "], "conflicts": []})
    assert empty.ok and empty.unresolved == ["a"] and empty.sufficient is False


def test_profile(spark):
    rows = [({"model": "S20", "kva": " ", "_note": "x", "": "y"}, {"kva": " 200 ", "model": "other", "color": "red"}, ["kva", "phase"], ["model"]), (None, None, ["a"], [])]
    df = spark.createDataFrame(rows, "r map<string,string>, f map<string,string>, fields array<string>, v array<string>")
    a, b = [r.p for r in df.select(judgments.sample_profile(*[F.col(c) for c in ("r", "f", "fields", "v")]).alias("p")).collect()]
    assert a.effective == {"model": "S20", "kva": "200", "phase": ""} and a.reported == {"model": "S20", "kva": " ", "phase": ""}
    assert {k: (e.source, e.verification) for k, e in a.evidence.items()} == {"model": ("report_extraction", "quote_verified"), "kva": ("model_decode", "requires_review"), "phase": ("missing", "missing")}
    assert b.effective == {"a": ""} and b.evidence["a"].source == "missing"


def test_flattened_and_questions(spark):
    def flat(v):
        if v is None:
            return ""
        if isinstance(v, (str, int, float)):
            return str(v)
        return " ".join(flat(x) for x in (v if isinstance(v, list) else v.values()))

    values = [{"a": [1, {"b: c": 'q "x" é', "d": None}], "e": True}, [], "text", 2.5, None, {"k": {"k": [[["deep"]]]}}]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [("{bad",), (None,)], "j string")
    assert [r.f for r in df.select(judgments.flattened(F.col("j")).alias("f")).collect()] == [*map(flat, values), "", ""]
    text = "1. What  is it?\n2、What is it?\n\n 3) Why\tnot? \r\nWhy not?\n" + "z" * 300 + "\nfour\nfive"
    (r,) = spark.createDataFrame([(text,)], "t string").select(judgments.question_list(F.col("t")).alias("q")).collect()
    assert r.q == ["What is it?", "Why not?", "z" * 240, "four"]


@pytest.mark.parametrize("no,title,rank", [("GB/T 1", "", 3), ("q/gdw 1", "", 2), ("Q 12", "", 2), ("NB/T 3", "", 2), ("X", "采购规范 A", 1), ("GBZ", "", 3), ("DLX", "", 4), (None, None, 4)])
def test_priority(spark, no, title, rank):
    df = spark.createDataFrame([(no, title)], "n string, t string")
    assert df.select(judgments.standard_priority(F.col("n"), F.col("t")).alias("p")).first().p.rank == rank


def test_gates_and_mutations(spark):
    from hashlib import sha256

    sha = lambda t: sha256(t.encode()).hexdigest()
    corpus = spark.createDataFrame([(sha("a"), "a", "1"), (sha("b"), "b", "2"), ("wrong", "c", "3"), (sha("d"), "d", "4"), (sha("e"), "e", "4")], "sha string, text string, locator string")
    cases = spark.createDataFrame([(i, f"r{i}") for i in range(1, 8)], "case_id long, requirement string")
    notes = [(1, [[sha("a"), sha("b")], [sha("a")]]), (2, [[]]), (3, []), (3, []), (5, [[sha("zz")], ["wrong"]]), (6, [[sha("d")]]), (9, []), (7, None)]
    annotations = spark.createDataFrame([(i, "supported", "b", g) for i, g in notes], "case_id long, expected_status string, basis string, groups array<array<string>>")
    seen = Observation()
    got = {r.case_id: (r.violations, r.n_groups, r.n_evidence) for r in gold.gated(cases, annotations, corpus, seen).collect()}
    assert got == {1: ([], 2, 2), 2: ([], 1, 0), 3: (["annotation_repeated"], 0, 0), 4: (["annotation_missing"], 0, 0), 5: (["evidence_unknown", "evidence_corrupted"], 2, 2), 6: (["evidence_not_unique"], 1, 1), 7: ([], 0, 0), 9: (["case_missing"], 0, 0)}
    assert seen.get["rows"] == 8 and seen.get["gold"] == 3 and seen.get["evidence_corrupted"] == 1
    routed = gold.gated(cases, annotations, corpus)
    assert sorted(map(tuple, gold.violations(routed).collect())) == sorted((i, g) for i, (v, _, _) in got.items() for g in v)
    m = spark.createDataFrame([(101, 1, "after", "mismatch", "n"), (105, 5, "x", "y", "z")], "edit_id long, base_case_id long, after string, expected_status string, note string")
    made = sorted((r.case_id, r.parent_case_id, r.requirement, r.expected_status, r.n_groups) for r in gold.with_mutations(routed, m).collect())
    assert made == [(1, None, "r1", "supported", 2), (2, None, "r2", "supported", 1), (7, None, "r7", "supported", 0), (101, 1, "after", "mismatch", 2)]


def test_replay(spark):
    doc = lambda text, unit, value, sunit, op, tol, status: json.dumps({"requirement": {"text": text, "unit": unit}, "standard": {"value": value, "unit": sunit, "operator": op, "tolerance": tol}, "judgment": {"status": status}})
    rows = [doc("≤270.0", "W", 0.27, "kW", "le", None, "mismatch"), doc("≤2.2", "%", 2.0, "%", "le", None, "supported"), doc("≤1", "V", 2.0, "s", "le", None, "mismatch"), doc("≤1", "V", None, "V", "le", None, "supported"), doc("words", "V", 1.0, "V", "le", None, "x"), "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(gold.replayed(F.parse_json("j")).alias("r"))
    got = [tuple(r.r)[:3] for r in df.collect()]
    assert got == [("mismatch", "supported", "caliber"), ("supported", "mismatch", "caliber"), ("mismatch", "mismatch", "unit_conversion_unavailable"), ("supported", "supported", "no_candidates_recorded"), ("x", "x", "left_interval_unparseable"), (None, None, "no_candidates_recorded")]
    assert {(r.old, r.new, r.changed) for r in gold.ledger(df).collect()} >= {("mismatch", "supported", True), (None, None, False)}


def test_peers(spark):
    rng = random.Random(3)
    rules = [(("oil", "air"), ("tank", "load")), (("load",), ("loss", "oil")), (("none",), ("x",))]
    words = ["oil", "air", "tank", "load", "loss", "of", "the"]
    rows = [(i, i % 2, rng.choice(["1", "2", None]), rng.choice("ab"), rng.choice(words), rng.choice(words) + rng.choice([" ", "  "]) + rng.choice(words)) for i in range(200)]
    rows += [(1000 + i, 1, "1", "a", "load", "tank oil") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, report long, item string, phase string, project string, text string")
    asked = df.filter("id % 9 = 1").withColumnRenamed("id", "asked_id")
    want = []
    for i, report, item, phase, project, text in rows:
        if i % 9 == 1:
            terms = list(dict.fromkeys(t for tr, rel in rules if any(x in f"{project} {text}" for x in tr) for t in rel))
            near = []
            for j, r, it, ph, pr, tx in rows:
                if terms and r == report and ((it or ""), ph, tx.replace(" ", "")) != ((item or ""), phase, text.replace(" ", "")):
                    score = 3 * sum(t in f"{pr} {tx}" for t in terms) + 2 * ((it or "") == (item or "")) + (ph == phase)
                    if score:
                        near.append((-score, j))
            want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(near)[:12])]
    assert sorted(map(tuple, review.peers(df, asked, rules).collect())) == sorted(want)


def test_texts_of_a_gold_corpus_are_hashed_where_they_are_read(spark):
    cases = spark.createDataFrame([(1, "r"), (2, "r")], "case_id long, requirement string")
    annotations = spark.createDataFrame([(1, "s", "b", [["x", "x"], ["x", None]]), (2, "s", "b", [])], "case_id long, expected_status string, basis string, groups array<array<string>>")
    corpus = spark.createDataFrame([("x", "text", "l")], "sha string, text string, locator string")
    routed = gold.gated(cases, annotations, corpus)
    got = {r.case_id: (r.violations, r.n_groups, r.n_evidence) for r in routed.collect()}
    assert got == {1: (["evidence_unknown", "evidence_corrupted"], 2, 2), 2: ([], 0, 0)}
    plan = routed._jdf.queryExecution().optimizedPlan().toString().split("\n")
    line = lambda t: next(i for i, x in enumerate(plan) if t in x)
    assert line("sha2(") > line("Join Inner")


@pytest.mark.parametrize("name", ["gold_gates", "gold_cases"])
def test_gold_of_odd_tables_by_sql(spark, tmp_path, name):
    """Copies of a text, a doc_id of several texts, locators that meet, nulls, lines without an order and orders without lines."""
    rng = random.Random(5)
    texts = [None, "", *(f"text {i}" for i in range(40))]
    docs = [(None if i % 31 == 7 else 5 if i % 13 == 4 else i, rng.choice(texts), "en", rng.choice("ab"), i if i % 4 else None) for i in range(120)]
    orders = [(None if k == 500 else k, rng.choice("OFP"), rng.choice(["1-URGENT", "2-HIGH", None])) for k in range(-40, 620)]
    lines = [(None if i % 97 == 3 else rng.randrange(-110, 640), None if i % 41 == 2 else rng.choice([*range(8), rng.randrange(130)]), rng.choice(["A", "R", "N", None])) for i in range(1500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("documents", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr) and want


def test_hashes_stay_with_the_corpus(spark):
    """Lines are dealt with two numbers for a text: with its hash, each took some 80 bytes three times."""
    lines = spark.createDataFrame([(1, "g", 1), (1, "h", 2), (1, None, 2), (1, "g", 3), (2, "g", 4)], "case_id long, group string, key long")
    corpus = spark.createDataFrame([(1, "x", "t", "a"), (2, "x", "t", "b"), (2, "y", "u", "c"), (3, None, None, "d"), (4, None, "t", "e")], "key long, sha string, text string, locator string")
    df = gold.evidence(lines, corpus, "key")
    assert sorted(tuple(r) for r in df.select("case_id", "n_groups", "n_evidence", "_unknown", "_corrupt", "_many").collect()) == [(1, 2, 3, True, True, False), (2, 1, 1, True, None, None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    (window,) = [i for i, x in enumerate(plan) if "Window [" in x]
    assert "sha#" not in plan[window + 1] and not any("collect_" in x for x in plan)
