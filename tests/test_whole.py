"""Queries over all rows of their tables, where the registered SQL reads fewer."""

import duckdb
import pytest

from tallyloom import queries
from tallyloom.operators import layout, similar

from .conftest import SF


def read(name):
    return f"'{SF}/{name}.parquet'"


def test_caption_join_of_all_users(spark):
    sql = f"""WITH b AS (SELECT event_id AS id, user_id, (event_id % 5) / 10.0 AS x0, (event_id % 5) / 10.0 + 0.4 AS x1,
        (event_id % 20) / 20.0 AS y0, (event_id % 20) / 20.0 + 0.03 AS y1 FROM {read("events")})
        SELECT id, caption_id FROM (SELECT b.id, c.id AS caption_id, row_number() OVER (PARTITION BY b.id ORDER BY b.y0 - c.y1, c.id) AS r
        FROM b JOIN b c ON b.user_id = c.user_id AND b.id <> c.id AND b.y0 - c.y1 BETWEEN 0 AND 0.045
        AND (least(b.x1, c.x1) - greatest(b.x0, c.x0)) / 0.4 >= 0.45) WHERE r = 1"""
    got = queries.queries()["caption_join"](spark, SF).select("id", "caption_id").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


@pytest.mark.parametrize("max_gap", [0, 3, 7])
def test_nearest_above_by_pairs(spark, max_gap):
    import random

    rng = random.Random(2)
    rows = [(rng.randrange(90) if i % 11 else None, rng.choice([1, 2, None]), x, y, x + rng.randrange(1, 9), y + rng.randrange(4)) for i, x, y in ((i, rng.randrange(20), rng.randrange(40)) for i in range(300))]
    want = {}
    for i, p, x0, y0, x1, _ in rows:
        for j, q, cx0, _, cx1, cy1 in rows:
            shared = (min(x1, cx1) - max(x0, cx0)) / min(x1 - x0, cx1 - cx0)
            if None not in (i, j, p) and p == q and i != j and 0 <= y0 - cy1 <= max_gap and shared >= 0.5:
                want[i] = min(want.get(i, (99, 0)), (y0 - cy1, j))
    b = spark.createDataFrame(rows, "id long, page long, x0 long, y0 long, x1 long, y1 long")
    got = layout.nearest_above(b, b, ["page"], max_gap, 0.5).collect()
    assert {r.id: r.caption_id for r in got} == {i: j for i, (_, j) in want.items()}


def test_event_messages_whole(spark, tmp_path):
    text = " \n\u3000" + "long turn " * 50 + "end\x1f\t"
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, "user", " \n"), (1, 3, "system", ""), (1, 4, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.queries()["event_messages"](spark, str(tmp_path)).select("conv_id", "turn", "kind", "content").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "human", text.strip()), (1, 1, "reply", text)]


def test_custom_order_of_all_orders(spark):
    sql = f"""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank
        FROM {read("orders")} ORDER BY rank, o_orderkey"""
    got = queries.queries()["custom_order"](spark, SF).select("o_orderkey", "rank").collect()
    assert list(map(tuple, got)) == duckdb.sql(sql).fetchall()


def test_similar_chunks_of_documents(spark, tmp_path):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(6)
    lines = ["".join(rng.choices("abcdefghij ", k=rng.randrange(5, 90))) for _ in range(60)]
    lines += ["<b>Fish &amp; Chips</b>", "fish chips", "FISH, chips!", "", "", "--"] + [x[: len(x) // 2] + "q" + x[len(x) // 2 :] for x in lines[-9:]]
    rows = [(1, "\n".join(lines)), (None, "same\nsame"), (None, "other\nwords"), (1, "\n".join(lines)), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.queries()["similar_chunks"](spark, str(tmp_path)).select("doc_id", "page", "id", "similar_to").collect()), key=repr)
    keys, start, want = [similar.dedupe_key(x) for x in lines], 0, []
    pages = []
    for i, line in enumerate(lines):
        pages.append(start // 3000)
        start += len(line) + 1
        like = (j for j in range(i) if pages[j] == pages[i] and keys[j] and keys[i] and SequenceMatcher(None, keys[i], keys[j], autojunk=False).ratio() >= 0.6)
        want.append((1, pages[i], i, next(like, None)))
    want += [(None, 0, 0, None), (None, 0, 1, 0), (None, 0, 0, None), (None, 0, 1, None)]
    assert got == sorted(want, key=repr)
    assert keys[60:66] == ["fishchips"] * 3 + [""] * 3 and pages[-1] > 0


def test_similar_chunks_of_pages_without_words(spark, tmp_path):
    """A page may hold no key at all: an empty text, rules, and what a last line break leaves on a page of its own."""
    number = "&#" + "0" * 5000 + "65;b&#" + "9" * 5000 + ";"
    rows = [(1, ""), (2, "---\n\n***"), (3, "a" * 2999 + "\n"), (4, f"{number}\nab"), (5, "&#0;&#00;&#12345678;&#x110000;&\nx\nX")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.queries()["similar_chunks"](spark, str(tmp_path)).select("doc_id", "page", "id", "similar_to").collect()))
    assert got == [(1, 0, 0, None), (2, 0, 0, None), (2, 0, 1, None), (2, 0, 2, None), (3, 0, 0, None), (3, 1, 1, None), (4, 0, 0, None), (4, 3, 1, None), (5, 0, 0, None), (5, 0, 1, None), (5, 0, 2, 1)]
    assert similar.dedupe_key(number) == "ab"


def against_sql(spark, tmp_path, name, table):
    got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).collect()]
    want = duckdb.sql(queries.oracle_sql()[name].replace(f"FROM {table}", f"FROM '{tmp_path}/{table}.parquet/*.parquet'")).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_grids_of_odd_entities(spark, tmp_path):
    html = "<ul><li>a &amp;lt; b</li><li>&ampx; &nbsp; &#38; &copy</li></ul><h1>X&&&amp &lt;b&gt; &quot;&#39;&amp;amp;</h1>"
    spark.createDataFrame([(1, "u", html), (2, "u", "<h1>no items &</h1>"), (3, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = against_sql(spark, tmp_path, "table_grids", "pages")
    assert (1, 0, 0, 0, "X&&&amp <b> \"'&amp;") in got


def test_questions_that_begin_with_numbers(spark, tmp_path):
    texts = ["28.68.191.238 Den\nA b\nA b\n  1) x\n", "B\r12. c\n3. 4. d\x0b e", "x\u2028y\u00a0 z\n\x1c\u3000", "", None, "\n\n", "é. 1\n" + "7. long " * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = against_sql(spark, tmp_path, "question_lists", "documents")
    assert (0, "28.68.191.238 Den|A b|1) x") in got
