"""Segmentation by a dictionary against all paths, and search over letters of all kinds."""

import itertools
import math
import random
import tracemalloc

from pyspark.sql import functions as F

from tallyloom import queries
from tallyloom.functions import segment
from tallyloom.operators import fusion, lexical

from .conftest import SF

WORDS = [("变压器", 50), ("变压", 9), ("压器", 3), ("试验", 80), ("空载", 30), ("损耗", 40), ("空载损耗", 12), ("温升", 20), ("升", 6), ("器试", 1), ("变压器试验", 2)]


def best(run, words):
    """The words of the best path among all ways to cut a run, the longer first word of equals."""
    total = sum(words.values())
    weight = lambda w: math.log(words[w] / total) if w in words else math.log(1 / total) if len(w) == 1 else -math.inf
    ways = []
    for cuts in itertools.product((0, 1), repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        ways.append([run[a:b] for a, b in zip(at, at[1:])])
    scores = [sum(map(weight, w)) for w in ways]
    top = max(scores)
    return max((w for w, s in zip(ways, scores) if s > top - 1e-9), key=lambda w: [len(x) for x in w])


def tokens(run, words):
    out, loose = [], ""
    for w in [*best(run, words), None]:
        if w is not None and len(w) == 1 and w not in words:
            loose += w
            continue
        if loose:
            out += [loose[i : i + 2] for i in range(len(loose) - 1)] or [loose]
            loose = ""
        if w is not None:
            out += [w[j : j + m] for m in (2, 3) if len(w) > m for j in range(len(w) - m + 1) if w[j : j + m] in words] + [w]
    return out


def test_segments_are_the_best_of_all_paths():
    rng = random.Random(2)
    words = dict(WORDS)
    runs = ["".join(rng.choice("变压器试验空载损耗温升的") for _ in range(rng.randrange(1, 11))) for _ in range(300)]
    assert segment.segment(segment.Trie(WORDS), runs) == [tokens(r, words) for r in runs]


def test_a_long_run_and_an_empty_dictionary():
    trie = segment.Trie(WORDS)
    run = "变压器试验" * 4000 + "的"
    (got,) = segment.segment(trie, [run])
    assert got[-1] == "的" and got.count("变压器试验") + got.count("试验") >= 4000
    assert segment.segment(segment.Trie([]), ["变压器", "的", ""]) == [["变压", "压器"], ["的"], []]


def test_runs_go_by_blocks_of_bounded_memory(monkeypatch):
    rng = random.Random(7)
    words = [*WORDS, ("变" * 50, 1)]
    runs = ["".join(rng.choice("变压器试验空载损耗温升的") for _ in range(rng.randrange(9))) for _ in range(60_000)]
    trie = segment.Trie(words)
    tracemalloc.start()
    got = segment.segment(trie, runs)
    peak = tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert peak < 90e6  # the graph of all runs would be 96 MB, and its list as much again
    monkeypatch.setattr(segment, "CELLS", 1000)
    assert segment.segment(trie, runs[:3000]) == got[:3000]


def test_words(spark):
    text = "Été naïve 变压器 S20-M 的 空载损耗x"
    df = spark.createDataFrame([(text,), ("",), (None,)], "text string")
    assert df.select(lexical.words(F.coalesce("text", F.lit(""))).alias("w")).collect()[0].w == ["été", "naïve", "变压", "压器", "s20", "m", "的", "空载", "载损", "损耗", "x"]
    got = [r.w for r in df.select(segment.segmenter(WORDS)(F.col("text")).alias("w")).collect()]
    assert got == [["été", "naïve", "变压", "压器", "变压器", "s20", "m", "的", "空载", "损耗", "空载损耗", "x"], [], None]


def test_bigrams_of_odd_letters(spark):
    """Han beyond 16 bits, radicals that are no letters, kana beside Han, and one expression for all, not one a word."""
    text = "x变压Y试 ⺀々〇カ变\U00020000验,变\n电"
    column = segment.bigram_words(F.col("text"))
    (r,) = spark.createDataFrame([(text,)], "text string").select(column.alias("w")).collect()
    assert r.w == ["x", "变压", "y", "试", "々〇", "カ", "变\U00020000", "\U00020000验", "变", "电"]
    assert "lambda" not in str(column)


def test_search_tokens(spark):
    text = "<table><tr><td>S20-M.RL-200/10-NX2 200 kVA 空载损耗 标准 5 x</td></tr></table>"
    df = spark.createDataFrame([(text,)], "text string")
    (r,) = df.select(lexical.search_tokens(F.col("text"), segment.segmenter(WORDS)).alias("t")).collect()
    assert {"s20mrl20010nx2", "200kva", "空载损耗", "5"} <= set(r.t) and not {"table", "tr", "标准", "x"} & set(r.t)


def test_blocks_do_not_change_scores(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["la", "été", "变压器", "of", f"r{i % 9}"]) for _ in range(rng.randrange(20))) or None) for i in range(400)] + [(5, "été"), (5, "été of")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["été", "变压器 of", "la la r3", "", None, "missing"])], "query_id long, text string")
    some = [sorted(map(tuple, f.collect())) for f in (lexical.bm25(docs, asked, 7), lexical.tf_idf(docs, asked, 7))]
    monkeypatch.setattr(lexical, "DOCS", 10)
    monkeypatch.setattr(lexical, "QUERIES", 2)
    assert some == [sorted(map(tuple, f.collect())) for f in (lexical.bm25(docs, asked, 7), lexical.tf_idf(docs, asked, 7))]
    assert {r[0] for r in some[0]} == {0, 1, 2} and all(len([r for r in some[0] if r[0] == q]) == 7 for q in (0, 1, 2))


def test_bm25_cuts_each_text_once(spark):
    """What totals are made of is what postings shuffle; rows of one id, empty and null texts count as documents."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        calls.add(int(text not in ("a c", "nothing")))
        return text.split()

    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c c c c d"), (3, ""), (4, None), (5, "z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a c"), (2, "nothing")], "query_id long, text string")
    got = {r.id: r.score for r in lexical.bm25(docs, asked, 5, cut).collect()}
    idf, mean = math.log(1 + 5.5 / 1.5), 10 / 4  # 6 documents, of which 4 have 10 words
    assert got == {1: round(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / mean)), 6), 2: round(idf * 4 * 2.2 / (4 + 1.2 * (0.25 + 0.75 * 5 / mean)), 6)}
    assert calls.value == 6


def test_rows_of_one_id_are_told_apart_by_their_words(spark):
    """As in the SQL: a row of postings for each id and list of words, equal lists as one, and a score for each id."""
    docs = spark.createDataFrame([(7, "a b"), (7, "a c"), (7, "a b"), (8, "z")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    (got,) = lexical.bm25(docs, asked, 5).collect()
    idf, mean = lambda df: math.log(1 + (4 - df + 0.5) / (df + 0.5)), 7 / 4
    w = lambda tf: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 2 / mean))
    assert (got.id, got.score) == (7, round(idf(2) * (w(1) + w(2)) + idf(1) * w(2), 6))


def test_two_routes_share_words_and_make_no_row_for_one(spark, monkeypatch):
    """Texts are cut and counted once for both routes, in pieces of any size, whether or not the queries' tokens are sent."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        calls.add(int(text not in ("a c", "c")))
        return text.split()

    docs = spark.createDataFrame([(i, "a b c " * (i % 4) + "d") for i in range(40)] + [(40, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a c"), (2, "c")], "query_id long, text string")
    found = lexical.ranked(docs, asked, 3, ["bm25", "overlap"], {"text": 1}, cut)
    want = sorted(map(tuple, found.collect()))
    assert calls.value == 41 and len(want) == 12
    for what, least in (("TOKENS", 5), ("ASKED", 1)):
        monkeypatch.setattr(lexical, what, least)
        assert sorted(map(tuple, lexical.ranked(docs, asked, 3, ["bm25", "overlap"], {"text": 1}, cut).collect())) == want


def searches(df):
    """How many times documents are scored."""
    return df._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow")


def test_lists_of_one_search_are_merged_without_another(spark):
    assert searches(queries.queries()["merged_lists"](spark, SF)) == 1
    rows = [(1, 7, 0.25, ["b"]), (1, 8, 0.5, ["b"]), (1, 7, 0.125, ["a"]), (2, 7, 0.5, ["a"]), (2, 9, 0.25, ["a"])]
    lists = spark.createDataFrame(rows, "query_id long, id long, rrf double, sources array<string>")
    got = sorted(map(tuple, fusion.merged_rows(lists, ["query_id"]).collect()))
    assert got == [(1, 7, 0.375, ["a", "b"]), (1, 8, 0.5, ["b"]), (2, 7, 0.5, ["a"]), (2, 9, 0.25, ["a"])]
    assert got == sorted(map(tuple, fusion.merge_lists(lists.filter("sources[0] = 'b'"), lists.filter("sources[0] = 'a'"), ["query_id"]).collect()))


def test_reserves_of_one_search_are_held_without_another(spark):
    """The same rows as from a pool and a special route of their own, with ties and whether or not both count."""
    assert searches(queries.queries()["reserved_routes"](spark, SF)) == 1
    rng = random.Random(6)
    rows = [(q, r, i, n + 1, float(9 - n // 2)) for q in range(6) for r in ("bm25", "overlap") for n, i in enumerate(rng.sample(range(12), rng.randrange(9)))]
    routes = spark.createDataFrame(rows, "query_id long, route string, id long, rank long, score double")
    pool = fusion.reciprocal_ranks(routes, ["query_id"]).filter("rank <= 4")
    special = routes.filter("route = 'overlap'").withColumn("rrf", F.round(1.0 / (60 + F.col("rank")), 9)).withColumnRenamed("rank", "route_rank")
    for twice in (False, True):
        want = sorted(map(tuple, fusion.with_reserves(pool, special, ["query_id"], 3, twice).collect()))
        got = fusion.with_reserves_of(routes, ["query_id"], "overlap", 4, 3, double_count=twice)
        assert got.columns == ["query_id", "id", "rrf"] and sorted(map(tuple, got.collect())) == want and len(want) > 20
