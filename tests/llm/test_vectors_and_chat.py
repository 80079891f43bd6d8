import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyloom.llm import chat, topk


def brute(rows, k=5, every=50):
    good = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        good[i] = min(good.get(i, q), q)
    out = []
    for i, q in good.items():
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good.items() if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[50][1]) for i in range(8)] + [(500, None), (550, []), (600, [float("nan")] * 24), (650, [None] * 24), (None, [1.0] * 24), (700, [1.0, 2.0]), (701, [3.0, -1.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, rank int")
    for size in (64 << 20, 1 << 10):
        found = topk.searched(df, block_bytes=size).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == brute(rows)
        assert all(0 < r.n_exact <= len(rows) for r in found)
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def block(ids, v):
    return topk.Block(np.array(ids), v, [topk._segments(v.astype(float), level) for level in topk.levels(v.shape[1])])


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-200, 200, (20, 50)), rng.integers(-200, 200, (30, 50))
    exact = q @ c.T
    for level in topk.levels(50):
        bound = topk._segments(q.astype(float), level) @ topk._segments(c.astype(float), level).T
        assert (bound >= exact - 1e-6).all()


def test_bounds_rule_out():
    """Vectors whose segments differ in level: most pairs need no exact score."""
    rng = np.random.default_rng(2)
    level = np.repeat(rng.integers(-300, 300, (400, 16)), 4, axis=1)
    v = level + rng.integers(-5, 6, level.shape)
    best = topk.Best(8, 5)
    for a in range(0, 400, 50):
        topk.refine(best, block(range(8), v[:8]), block(range(a, a + 50), v[a : a + 50]))
    want = [sorted((-int(v[i] @ v[j]), j) for j in range(400) if j != i)[:5] for i in range(8)]
    assert [list(zip((-best.score[best.row == i]).tolist(), best.id[best.row == i].tolist())) for i in range(8)] == want
    assert best.exact.sum() < 8 * 400 / 4


def test_bounds_rule_out_half_of_the_given_vectors(spark):
    """Vectors without a dominant direction: segments of two components and thresholds shared by all blocks."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    n = df.count()
    for size, most in ((16 << 20, 0.5), (1 << 20, 0.65)):
        exact = {r.query_id: r.n_exact for r in topk.searched(df, block_bytes=size).collect()}
        share = sum(exact.values()) / n / len(exact)
        assert len(exact) == n / 50 and share < most


def test_preferences(spark):
    chosen = [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "good")]
    rejected = [("user", "q"), ("assistant", "a"), ("user", "q2"), ("assistant", "bad"), ("user", None)]
    rows = [(1, chosen, rejected), (2, chosen, chosen), (3, [], rejected), (4, None, None), (5, chosen[:2], chosen)]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {chat.TURN}, rejected {chat.TURN}")
    got = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    assert got[1].n_common == 3 and got[1].prompt == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nq2<|end|>\n"
    s = got[1].chosen_spans[0]
    assert got[1].chosen_text[s.start : s.start + s.length] == "good<|end|>"
    assert got[1].rejected_text == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n" and len(got[1].rejected_spans) == 1
    assert got[2].n_common == 4 and got[2].chosen_text == got[2].rejected_text == ""
    assert got[3].n_common == 0 and got[3].prompt == "" and got[4].n_common == 0
    assert got[5].n_common == 2 and got[5].chosen_text == ""


def brute_pairs(turns, group_rows):
    """conv_id to (other_id, chosen, rejected)."""
    convs = defaultdict(set)
    for c, turn, role, text in turns:
        if c is not None:
            convs[c].add((turn is not None, turn or 0, "user" if role is None else role, text or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(t)] for c, t in convs.items()}
    convs = {c: t for c, t in convs.items() if any(r == "assistant" for r, _ in t)}
    mixed = {c: hashlib.md5(str(c).encode()).hexdigest() for c in convs}
    order = sorted(convs, key=lambda c: (mixed[c], c))
    number = {c: int(mixed[c][:8], 16) for c in convs}
    n = Counter(t[0] for t in convs.values())
    cell = {c: (t[0], number[c] // 64 % -(-n[t[0]] // group_rows)) for c, t in convs.items()}
    bucket = {c: number[c] % -(-len(convs) // group_rows) for c in convs}
    out = {}
    for at, c in enumerate(order):
        t = convs[c]
        peer = next((x for x in order[at + 1 :] if cell[x] == cell[c]), None)
        if peer is not None:
            out[c] = peer, t, convs[peer]
            continue
        others = [x for x in order if x != c]
        near = [x for x in others if bucket[x] == bucket[c]]
        donor = next((x for x in order[at + 1 :] if x in near), near[0] if near else others[0] if others and order[0] != c else others[-1] if others else None)
        last = max(i for i, (r, _) in enumerate(t) if r == "assistant")
        reply = "" if donor is None else [x for r, x in convs[donor] if r == "assistant"][-1]
        out[c] = donor, t, [*t[:last], ("assistant", reply), *t[last + 1 :]]
    return out


def formatted(chosen, rejected):
    n = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))
    render = lambda turns: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in turns)

    def spans(turns):
        marks, at = [], 0
        for r, x in turns:
            if r == "assistant":
                marks.append((at + len(f"<|{r}|>\n"), len(f"{x}<|end|>")))
            at += len(render([(r, x)]))
        return marks

    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), spans(chosen[n:]), spans(rejected[n:])


def many_turns():
    turns = []
    for c in range(40):
        turns += [(c, 0, "user", "same" if c % 2 else f"own {c}"), (c, 1, "assistant", f"a{c}"), (c, 1, "assistant", f"a{c}"), (c, 2, None, None)]
    turns += [(99, 0, "user", "no reply"), (None, 0, "user", "x"), (98, None, "assistant", "only"), (97, 0, "user", "日本 é" * 9000), (97, 1, "assistant", "x"), (97, 2, "user", "thanks")]
    return turns + [(200 + c, i, r, x) for c in range(9) for i, r, x in ((0, "user", "one prompt"), (1, "assistant", "tie"))]


@pytest.mark.parametrize("group_rows", [512, 8, 2, 1])
def test_pairs(spark, group_rows):
    turns = many_turns()
    df = spark.createDataFrame([(*t, 1, "x", 2, 3) for t in turns], "conv_id long, turn long, role string, text string, n int, t string, last int, turns int").repartition(3)
    want = {c: (o, *formatted(a, b)) for c, (o, a, b) in brute_pairs(turns, group_rows).items()}
    rows = chat.format_preferences(chat.pair_up(chat.conversations(df), group_rows)).collect()
    got = {r.conv_id: (r.other_id, r.n_common, r.prompt, r.chosen_text, r.rejected_text, [tuple(s) for s in r.chosen_spans], [tuple(s) for s in r.rejected_spans]) for r in rows}
    assert len(rows) == len(got) and got == want
    assert all(v[0] is not None for v in got.values())


def test_pairs_of_few(spark):
    schema = "conv_id long, turn long, role string, text string"
    one = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "thanks")]
    (r,) = chat.preference_rows(spark.createDataFrame(one, schema)).collect()
    assert (r.other_id, r.rejected_text) == (None, "<|assistant|>\n<|end|>\n<|user|>\nthanks<|end|>\n") and r.chosen_text.endswith("thanks<|end|>\n")
    two = {r.conv_id: r.other_id for r in chat.preference_rows(spark.createDataFrame([*one, (2, 0, "assistant", "b")], schema)).collect()}
    assert two == {1: 2, 2: 1}
    assert chat.preference_rows(spark.createDataFrame([], schema)).count() == 0
