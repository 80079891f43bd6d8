"""Whitening, language-model scores and source divergence against brute force."""

import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import divergence, interpolation, whitening

from . import cases


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * np.linspace(0.1, 30, 12)).astype(np.float32).tolist()) for i in range(200)]
    rows += [rows[3], (None, rows[4][1]), (900, None), (901, []), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (904, [math.inf] * 12), (905, [3e38] * 12)]
    return rows + [(1000 + i, [float(i), 2.0, float(i * i % 7)]) for i in range(9)]


def brute_whitening(rows):
    by = defaultdict(list)
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) and abs(c) < 1e17 for c in v):
            by[len(v)].append((i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]))
    out = {}
    for d, own in by.items():
        n, s = len(own), [sum(x[j] for _, x in own) for j in range(d)]
        v = [[float(sum(Fraction(n * x[i] - s[i]) * (n * x[j] - s[j]) for _, x in own) / n**3) for j in range(d)] for i in range(d)]
        out[d] = n, own, s, np.array(v)
    return out


def test_whitening(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<float>, n int, component int, w double").repartition(3)
    got = defaultdict(lambda: defaultdict(list))
    for r in whitening.whiten(df).collect():
        got[r.n][r.vec_id is None, r.vec_id or 0].append(r)
    for d, (n, own, s, v) in brute_whitening(rows).items():
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:8], u[:, ::-1][:, :8]
        live = e > 1e-13 * e[0]
        assert len(got[n][False, 3]) == 8 * (2 if d == 12 else 0)  # a repeated row stays two
        items = []
        for _, x in sorted(got[n].items()):
            x.sort(key=lambda r: r.component)
            times = len(x) // min(d, 8)
            items += [x[t::times] for t in range(times)]
        assert len(items) == len(own) == n and all([r.component for r in x] == list(range(1, min(d, 8) + 1)) for x in items)
        want = sorted((i is None, i or 0, sum((n * x - t) ** 2 for x, t in zip(xs, s))) for i, xs in own)
        assert [(x[0].vec_id is None, x[0].vec_id or 0, x[0].deviation) for x in items] == want
        w = np.array([[r.whitened for r in x] for x in items])
        cov = (w - w.mean(0)).T @ (w - w.mean(0)) / n
        assert np.abs(cov - np.diag(live)).max() < 1e-9 and all(r.identity_error < 1e-9 for x in items for r in x)
        assert np.allclose([r.explained for r in items[0]], np.where(live, e / np.trace(v), 0), rtol=1e-9)
        x = np.array([xs for i, xs in sorted(own, key=lambda o: (o[0] is None, o[0] or 0))], float)
        z = (x - np.array(s) / n) @ (u / np.sqrt(np.where(live, e, 1))) * live
        assert np.allclose(np.abs(z), np.abs(w), atol=1e-6)
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.filter("vec_id = 7")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, 0.0, 0.0, 0.0)] * 8


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 20, 1 << 60, 1 << 90):
        y = np.array([[int(rng.integers(-(1 << 30), 1 << 30)) * (top >> 30) + int(rng.integers(-99, 99)) for _ in range(4)] for _ in range(50)], object)
        y = y if top > 1 << 62 else y.astype(np.int64)
        sums = {}
        whitening.add_products(sums, y)
        o = y.astype(object)
        assert (sum(s.astype(object) << (whitening.BITS * k) for k, s in sums.items()) == o.T @ o).all()


def brute_scores(data, order):
    """A dictionary version: n-grams as tuples, weights learned on the single tokens."""
    def tokens(text):
        return [*(text or "").encode().lower().split(), None]

    def kind(i):
        return 9 if i is None else zlib.crc32(str(i).encode()) % 10

    def count(rows):
        c = [Counter() for _ in range(order)]
        for t in rows:
            p = ["<"] * (order - 1) + t
            for i in range(len(t)):
                for k in range(order):
                    c[k][tuple(p[i + order - 1 - k : i + order])] += 1
        return c

    def rows(c, t):
        n, v, p = sum(c[0].values()), len(c[0]), ["<"] * (order - 1) + t
        for i in range(len(t)):
            f, b = [1 / (v + 1), c[0][(t[i],)] / max(n, 1)], 0
            for k in range(1, order):
                h = tuple(p[i + order - 1 - k : i + order - 1])
                seen = c[0][(None,)] if i == 0 else c[k - 1][h]
                f.append(c[k][(*h, t[i])] / seen if seen else 0.0)
                b = (k - 1) * interpolation.BUCKETS + 1 + int(math.log2(seen)) if seen else b
            yield b, f

    train = [tokens(r[1]) for r in data if kind(r[0])]
    held = [tokens(r[1]) for r in data if kind(r[0]) == 1]
    kept = count([tokens(r[1]) for r in data if kind(r[0]) > 1])
    c = count(train)
    cells = [x for t in held for x in rows(kept, t)]
    b, f = np.array([x[0] for x in cells], int), np.array([x[1] for x in cells]).reshape(-1, order + 1)
    weights = interpolation.learn(b, f, np.ones(len(b)), order)
    n, v = sum(c[0].values()), len(c[0])
    out = []
    for r in data:
        t = tokens(r[1])
        base = sum(math.log10((c[0][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = sum(math.log10(weights[b] @ np.array(f)) for b, f in rows(c, t))
        out.append((r[0], kind(r[0]) == 0, len(t), sum(c[0][(x,)] > 0 for x in t), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    data = [r for r in cases.rows() if len(r[1] or "") < 100_000] + [(None, "of a x.y1", *cases.rows()[0][2:])]
    df = spark.createDataFrame(data, cases.SCHEMA).repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = (sorted(map(tuple, x), key=key) for x in (interpolation.interpolated_scores(df, order, 4000).collect(), brute_scores(data, order)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # Weights are learned from cells of about equal estimates, so scores are close, not equal.
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=2e-3, atol=2e-3)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [b" ".join(b"w%d" % rng.integers(9) for _ in range(rng.integers(30))) for _ in range(40)]
    sizes, g = interpolation.grams(texts, 2)
    types, at = np.unique(g[0], return_inverse=True)
    c1 = np.bincount(at)
    pairs = dict(zip(*np.unique(g[1], return_counts=True)))
    weights = interpolation.learn(np.array([3, 3, 1]), np.array([[0.1, 0.2, 0.5], [0.1, 0.1, 0.0], [0.1, 0.5, 1.0]]), np.array([5, 2, 3]), 2)
    n, v = int(c1.sum()), len(types)
    for context, seen in zip(types, c1):
        bucket = 1 + int(math.log2(seen))
        with np.errstate(over="ignore"):
            nexts = interpolation._mix(np.array([context if context != interpolation._END else interpolation._START]) * np.uint64(0x9E3779B97F4A7C15) + types)
        f2 = np.array([pairs.get(x, 0) / seen for x in nexts])
        p = weights[bucket] @ np.stack([np.full(v, 1 / (v + 1)), c1 / n, f2])
        assert abs(p.sum() + weights[bucket][0] / (v + 1) - 1) < 1e-12


def test_scores_of_long_and_few(spark):
    data = [r for r in cases.rows() if len(r[1] or "") > 100_000]
    got = interpolation.interpolated_scores(spark.createDataFrame(data, cases.SCHEMA)).collect()
    assert [(r.doc_id, r.n_tokens) for r in got] == [(r[0], len(r[1].split()) + 1) for r in data]
    assert interpolation.interpolated_scores(cases.empty(spark)).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = interpolation.interpolated_scores(spark.createDataFrame([(only, "held out")], "doc_id long, text string")).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_scores_beat_the_base(spark):
    from ..conftest import SF

    got = interpolation.interpolated_scores(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) * 0.9


def brute_divergence(data, min_docs, most):
    import re

    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in data:
        text, lang, source = text or "", lang or "", source or ""
        t = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups.add((lang, source))
        counts[lang, source].update(t)
        docs[lang].update(set(t))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        both = {t: sum(counts[lang, s][t] for s in own) for t in kept}

        def p(c, lang=lang, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        shares, q = {s: p(counts[lang, s]) for s in own}, p(both)
        for s in own:
            pairs = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - shares[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and shares[s][t] > q[t])[:most]
            out += [(lang, s, part, o, -v, r + 1) for part, x in (("pair", pairs), ("term", terms)) for r, (v, _, o) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize("block,columns", [(128, 4096), (2, 3), (1, 1)])
def test_divergence(spark, block, columns, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", block)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    base = [r for r in cases.rows() if columns > 4 or len(r[1] or "") < 9000][:: 1 if columns > 4 else 2]
    data = [(r[0], r[1], ("en", "de", None)[i % 5 % 3], r[3], *r[4:]) for i, r in enumerate(base)]
    data += [(1, None, "xx", "s1", *data[0][4:]), (2, "rare", "xx", None, *data[0][4:]), (3, "Äb ab AB", "xx", "", *data[0][4:]), (4, "5 6", "en", "bare", *data[0][4:])]
    df = spark.createDataFrame(data, cases.SCHEMA).repartition(3)
    for most in (50, 2):
        assert sorted(map(tuple, divergence.divergence(df, 3, most).collect())) == brute_divergence(data, 3, most)
    assert divergence.divergence(cases.empty(spark)).count() == 0
