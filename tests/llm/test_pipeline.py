"""The corpus pipeline, each stage and the whole, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from tallyloom.llm import packing, quality

from . import cases
from .test_documents import BLANK, brute_components, brute_lines, collected, crc, encoded, word_sets

COLUMNS = list(corpus_pipeline.COLUMNS)


def documents():
    """Awkward texts, junk that the classifier is to reject, near copies, rows of null and repeated ids."""
    rng = random.Random(8)
    words = "the of and house water green stone river under light window paper garden summer".split()
    junk = ["".join(rng.choices("*#%&$", k=rng.randrange(3, 9))) for _ in range(40)]
    out = list(cases.rows())
    rest = out[0][2:]
    out += [(1000 + i, " ".join(rng.choices(words, k=rng.randrange(30, 90))) + ".\nSigned off here\nbody", *rest) for i in range(30)]
    out += [(1100 + i, " ".join(rng.choices(junk, k=60)), *rest) for i in range(30)]
    near = out[-50][1].split(" ")
    out += [(900, " ".join([*near[:9], "changed", *near[10:]]), *rest), (None, out[-50][1], *rest), (None, None, *rest), (None, None, *rest), (1003, "another text of this very id", *rest)]
    out += [out[3], out[3], out[70]]
    return [(*r[:3], [None, "b", "a", "c"][(r[0] or 0) % 4], *r[4:]) for r in out]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), cases.SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(1000 + i, 1, 0) for i in range(30)] + [(1100 + i, 0, 0) for i in range(30)] + [(None, 1, 0), (7, None, 0), (1000, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def brute_quality(spark, folder, data):
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    keep = quality.scores(quality.features([(r[1] or "").encode() for r in data]), model) >= quality.PASS
    return [r[:5] for r, k in zip(data, keep) if k]


def brute_line_stage(data):
    kept = ["\n".join(y) for _, y in brute_lines(data)]
    return [(r[0], t, r[2], r[3], len(t)) for r, t in zip(data, kept)]


def brute_near(data):
    """Rows of one id and text are one; of each component the row of the least id stays."""
    rows = sorted({(r[0], r[1]): r for r in data}.values(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = word_sets([(i, r[1]) for i, r in enumerate(rows)], 5)
    return [r for i, r in enumerate(rows) if brute_components(sets, 80)[i] == i]


def brute_mix(data):
    """How often each row is taken."""
    size = [len(re.findall(rf"[^{BLANK}]+", r[1] or "")) for r in data]
    h = [int(hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], 16) for r in data]
    total = defaultdict(int)
    for r, n in zip(data, size):
        total[r[3]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, open_, target = {s: 1 + i % 3 for i, s in enumerate(names)}, set(names), {}
    while True:
        left, w = sum(total.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / w > 3 * total[s]]
        target.update({s: 3 * total[s] if over else weight[s] * left / w for s in over or open_})
        open_ -= set(over)
        if not over or not open_:
            break
    times = {}
    for s in names:
        own = sorted((h[i], size[i]) for i, r in enumerate(data) if r[3] == s and size[i])
        whole = min(int(target[s] // total[s]), 3) if total[s] else 0
        rem, upto, below = (target[s] - whole * total[s] if whole < 3 else 0), -1, 0
        for x in sorted({a for a, _ in own}):
            n = sum(b for a, b in own if a == x)
            if rem <= 0 or below + n > rem and below + n - rem >= rem - below:
                break
            upto, below = x, below + n
            if below > rem:
                break
        times[s] = whole, upto
    return [times[r[3]][0] + (x <= times[r[3]][1]) for r, x in zip(data, h)]


def brute_pieces(data):
    ids = encoded("word_bpe_49k.json", 1)
    out = []
    for r in data:
        x = ids(r[1])
        out += [(r[0], k, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for k, s in enumerate(range(0, len(x), 4096))]
    return out


def test_run(spark, folder):
    read = lambda rows: spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ", ".join([*cases.SCHEMA.split(", ")[:5], "h long, family string, n int"]))
    stages = dict(corpus_pipeline.STAGES)
    data = documents()
    kept = brute_quality(spark, folder, data)
    assert {1100 + i for i in range(30)}.isdisjoint(r[0] for r in kept) and {1000 + i for i in range(30)} <= {r[0] for r in kept}
    got = stages["quality classifier"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert got.columns == COLUMNS and collected(got) == sorted(kept, key=repr)

    lines = brute_line_stage(kept)
    got = stages["line dedup"](spark, read(kept), folder)
    assert got.columns == COLUMNS and collected(got) == sorted(lines, key=repr)

    near = brute_near(lines)
    got = stages["n-gram Jaccard join"](spark, read(lines), folder)
    assert got.columns == COLUMNS and collected(got) == sorted(near, key=repr)
    assert 0 < len(near) < len(lines) and (None, "") in {r[:2] for r in near}
    assert (1003, "another text of this very id") in {r[:2] for r in near}

    times = brute_mix(near)
    mixed = [r for r, n in zip(near, times) for _ in range(n)]
    got = stages["mixing sources to target weights"](spark, read(near), folder)
    assert got.columns == COLUMNS and collected(got) == sorted(mixed, key=repr)

    want = sorted(brute_pieces(mixed), key=repr)
    for out in (stages["best-fit packing"](spark, read(mixed), folder).collect(), corpus_pipeline.run(spark, folder).collect()):
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == want
        used = Counter()
        for r in out:
            used[r.sequence_id] += r.length
        counts = np.bincount([w[3] for w in want], minlength=4097)
        assert max(used.values()) <= 4096 and len(used) == out[0].n_sequences
        assert packing.lower_bound(counts) == out[0].lower_bound <= len(used) <= out[0].lower_bound + 1
        assert all(r.part_bound <= r.part_sequences for r in out)


def test_stages_of_an_empty_table(spark, folder):
    docs = cases.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if set(COLUMNS) <= set(out.columns) else docs


def plain_features(text):
    """The features by their names, one at a time."""
    raw, words, lines = text, text.split(), text.split(b"\n")
    n = max(len(words), 1)
    kinds = [rb"[A-Z]", rb"[a-z]", rb"[0-9]", rb" ", rb"\n", rb"[\x80-\xff]", rb"\.", rb",", rb"!", rb"\?", rb"[*#%&$@^~]", rb"\|", rb"['\"]", rb"[()\[\]{}<>]", rb"[-_=+/\\:;]"]
    x = [len(re.findall(k, raw)) / max(len(raw), 1) for k in kinds]
    half = words[: max(1, len(words) // 2)]
    x += [len(set(words)) / n**0.8, len(set(half)) / len(half) if words else 0.0, sum(a == b for a, b in zip(words, words[1:])) / n, sum(w.isupper() for w in words) / n, sum(w.istitle() for w in words) / n]
    x += [min(len(raw) / n, 40) / 10, np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, np.log1p(len(words) / len(lines)) / 5, sum(y.endswith((b".", b"!", b"?")) for y in lines) / len(lines), len(set(lines)) / len(lines)]
    import xxhash

    buckets = Counter(xxhash.xxh3_64(w.lower().strip(b".,!?;:")).intdigest() % 64 for w in words)
    return np.array([*x, *(abs(v) ** 0.5 for v in x), *(v * v for v in x), *((buckets[b] / n) ** 0.5 for b in range(64))])


def test_quality_by_brute_force(spark, folder):
    """The whole query: features one by one, the loss's gradient at the weights, the quantile, the scores."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    data = documents()
    mean, scale, w, threshold = quality.train(docs, labels)
    z = lambda t: np.clip((plain_features((t or "").encode()) - mean) / scale, -8, 8)
    by_id = defaultdict(list)
    for r in data:
        by_id[r[0]].append(r[1])
    known = [(1, i) for i in range(1000, 1030)] + [(0, i) for i in range(1100, 1130)]
    train = [(y, z(t)) for y, i in known if zlib.crc32(str(i).encode()) % 4 != 2 for t in by_id[i]]
    good, poor = [x for y, x in train if y], [x for y, x in train if not y]
    assert np.allclose(mean, np.mean([plain_features((t or "").encode()) for y, i in known if zlib.crc32(str(i).encode()) % 4 != 2 for t in by_id[i]], axis=0))
    # Over all pairs, not those drawn: drawn pairs are many times these, so their mean is near.
    d = np.array([a - b for a in good for b in poor])
    loss = lambda v: np.mean(np.log1p(np.exp(-d @ v))) + 5e-4 * v @ v
    assert loss(w) < 1.1 * min(loss(w * c) for c in (0, 0.5, 0.8, 1.25, 2)) and all((a - b) @ w > 0 for a in good for b in poor)
    assert abs(threshold - np.quantile([x @ w for _, x in train], len(poor) / len(train))) < 1e-9
    got = defaultdict(set)
    for r in quality.quality_scores(docs, labels).collect():
        got[r.doc_id].add((r.held_out, round(r.score, 9), r.predicted))
    for i, texts in by_id.items():
        want = set()
        for t in texts:
            s = 1 / (1 + np.exp(-np.clip(z(t) @ w - threshold + np.log(7 / 3), -500, 500)))
            want.add((i is not None and zlib.crc32(str(i).encode()) % 4 == 2, round(float(s), 9), int(z(t) @ w >= threshold)))
        assert got[i] == want
