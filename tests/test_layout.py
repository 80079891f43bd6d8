"""Match ratios, cursors and captions against brute force."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallyloom.operators import layout, similar


def texts(rng, n, sizes=(0, 1, 5, 30, 100, 250, 600)):
    out = []
    for _ in range(n):
        letters = rng.choice(["ab", "abcd", "abcdefghijklmnopqrstuvwxyz0123456789"])
        a = [rng.choice(letters) for _ in range(rng.choice(sizes))]
        b = a[rng.randrange(5) :] + [rng.choice(letters) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(20)):
            if b:
                b[rng.randrange(len(b))] = rng.choice(letters)
        out.append(("".join(a), "".join(b)))
    return out


def test_match_ratio(monkeypatch):
    pairs = texts(random.Random(1), 200)
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [similar.match_ratio(a, b) for a, b in pairs] == want
    monkeypatch.setattr(similar, "_CELLS", 100)  # row by row
    assert [similar.match_ratio(a, b) for a, b in pairs[:80]] == want[:80]


def test_first_similar():
    rng = random.Random(2)
    keys = [x for p in texts(rng, 30, (0, 5, 30, 60)) for x in p]
    keys += keys[:9]
    want = []
    for i, k in enumerate(keys):
        want.append(next((j for j in range(i) if k and keys[j] and (k == keys[j] or SequenceMatcher(None, k, keys[j]).ratio() >= 0.7)), None))
    assert similar.first_similar(keys, 0.7) == want


def test_a_ratio_that_cannot_reach_the_least():
    for a, b in texts(random.Random(5), 100):
        want = SequenceMatcher(None, a, b).ratio()
        for least in (0.2, 0.6, want):
            got = similar.match_ratio(a, b, least)
            assert got == want if want >= least else want <= got < least


def test_many_ratios_of_lines():
    """500 pairs of lines: well under a second of processor time, as places are compared as bits of one number."""
    rng = random.Random(8)
    lines = ["".join(rng.choices("etaoinshrdlu", k=190)) for _ in range(501)]
    began = time.process_time()
    for a, b in zip(lines, lines[1:]):
        similar.match_ratio(a, b)
    assert time.process_time() - began < 1


def brute_cursor(items, entries):
    cursor, out = 0, []
    entries = [(i, similar.dedupe_key(t)) for i, t in entries if similar.dedupe_key(t)]
    for i, text in items:
        key, best = similar.dedupe_key(text), None
        for place in range(max(0, cursor - 1), min(len(entries), cursor + 6)) if key else ():
            e = entries[place][1]
            short, long = sorted((key, e), key=len)
            score = max(len(short) / len(long) if short in long else 0.0, SequenceMatcher(None, key, e).ratio())
            if best is None or score > best[0]:
                best = score, place
        if best is None or best[0] < 0.3:
            out.append((i, None, best[0] if best else 0.0))
        else:
            out.append((i, entries[best[1]][0], best[0]))
            cursor = max(cursor, best[1] + 1)
    return out


def test_cursor_matches(spark):
    rng = random.Random(3)
    words = ["load", "loss", "<b>tap</b>", "&amp;", "noise", "rise", "oil", "é"]
    docs = {}
    for d in (1, 2, 3, 4):
        lines = [" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(6))) for _ in range(60)]
        items = [(i, lines[i][: rng.randrange(5, 40)]) for i in range(60) if rng.random() < 0.8 or d == 4]
        entries = [(i, x) for i, x in enumerate(lines) if rng.random() < 0.7] if d != 4 else []
        docs[d] = items, entries
    docs[5] = [(0, "zzz")] * 1 + [(1, None)], [(i, f"entry {i}") for i in range(30)]
    side = lambda k: spark.createDataFrame([(d, i, t) for d, x in docs.items() for i, t in x[k]], "doc long, id long, text string").repartition(3)
    got = sorted(map(tuple, similar.cursor_matches(side(0), side(1)).collect()))
    assert got == sorted((d, *r) for d, x in docs.items() for r in brute_cursor(*x))
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)


def test_entries_are_let_go():
    state = similar.Cursor()
    for i in range(5000):
        state.add(i, f"row{i}of{i * i}")
    for i in range(5000):
        assert state.match(f"row{i}of{i * i}")[0] == i
    assert len(state.entries) <= similar.BACK


def test_image_captions(spark):
    rng = random.Random(4)
    blocks = [(p, i, rng.randrange(4) / 10, rng.randrange(20) / 20, (4 + rng.randrange(6)) / 10, 0.0, rng.choice(["figure 1", "text", None])) for p in range(30) for i in range(12)]
    blocks = [(p, i, x0, y0, x1, y0 + 0.05, t) for p, i, x0, y0, x1, _, t in blocks]
    df = spark.createDataFrame(blocks, "page long, at long, x0 double, y0 double, x1 double, y1 double, text string")
    got = {(r.page, r.at): r.caption_at for r in layout.next_caption(df, df, 0.2, F.col("text").startswith("figure")).collect()}
    want = {}
    for p, i, x0, y0, x1, y1, _ in blocks:
        best = None
        for q, j, a0, b0, a1, _, t in blocks:
            gap = b0 - y1
            if q == p and i < j <= i + 4 and (t or "").startswith("figure") and -0.005 <= gap <= 0.2 and max(0, min(x1, a1) - max(x0, a0)) / min(x1 - x0, a1 - a0) >= 0.35:
                best = min(best or (gap, -j), (gap, -j))
        if best:
            want[p, i] = -best[1]
    assert got == want and len(want) > 20


def test_stacked_captions(spark):
    rng = random.Random(5)
    blocks = [(p, i, x0 / 10, y0 / 50, (x0 + rng.randrange(1, 8)) / 10, (y0 + rng.randrange(1, 4)) / 50, rng.choice([f"c{i}", f"d {i} ", " "])) for p in range(20) for i in range(25) for x0 in [rng.randrange(5)] for y0 in [rng.randrange(45)]]
    schema = "page long, at long, x0 double, y0 double, x1 double, y1 double, text string"
    df = spark.createDataFrame(blocks, schema)
    p = df.filter("at % 5 = 0").withColumn("item", F.col("at")).withColumn("top", F.col("y1") + 0.02)
    got = {(r.page, r["item"]): (r.text, r.x0, r.y0, r.x1, r.y1) for r in layout.stacked_captions(p, df).collect()}
    want = {}
    for page, at, x0, y0, x1, y1, text in blocks:
        if at % 5 == 0:
            parts = [(y0, 0, at, text.strip(), x0, x1, y1)]
            for q, j, a0, b0, a1, b1, t in blocks:
                if q == page and j != at and t.strip() and b1 <= y1 + 0.02 + 0.005 and max(0, min(x1, a1) - max(x0, a0)) / max(0.001, min(x1 - x0, a1 - a0)) >= 0.45 and max(0, max(y0, b0) - min(y1, b1)) <= 0.04:
                    parts.append((b0, 1, j, t.strip(), a0, a1, b1))
            parts.sort()
            want[page, at] = "\n".join(x[3] for x in parts), min(x[4] for x in parts), min(x[0] for x in parts), max(x[5] for x in parts), max(x[6] for x in parts)
    assert got == want and any("\n" in w[0] for w in want.values())


def test_a_page_of_many_blocks(spark):
    """100,000 blocks on one page and 20 captions to complete: seconds, as only bands meet."""
    i = F.col("id")
    blocks = spark.range(100_000).select(F.lit(1).alias("page"), i.alias("at"), ((i % 100) / 100).alias("x0"), (F.floor(i / 100) / 10).alias("y0"), ((i % 100) / 100 + 0.008).alias("x1"), (F.floor(i / 100) / 10 + 0.05).alias("y1"), F.concat(F.lit("t"), i.cast("string")).alias("text"))
    p = blocks.filter("at % 5000 = 0").withColumn("item", F.col("at")).withColumn("top", F.col("y1"))
    began = time.time()
    got = layout.stacked_captions(p, blocks).collect()
    assert len(got) == 20 and all(r.text == f"t{r['item']}" for r in got) and time.time() - began < 60


def test_grids(spark):
    html = '<p>x</p><table><tr><td rowspan="2">a</td><th colspan="2">b &amp; c</th></tr><tr><td>d</td><td rowspan=3>e<br>f</td></tr><tr><td colspan="0">g</td><td>h</td></tr></table><table></table><TABLE><TR><TD>z</TD></TR></TABLE>'
    got = sorted(map(tuple, layout.table_cells(spark.createDataFrame([(1, html), (2, None), (3, "no table")], "id long, html string")).collect()))
    grid = [["a", "b & c", "b & c"], ["a", "d", "e f"], ["g", "h", "e f"], [None, None, "e f"]]
    assert got == [(1, 0, r, c, v) for r, row in enumerate(grid) for c, v in enumerate(row) if v] + [(1, 2, 0, 0, "z")]
