"""Hot groups spread over parts, and stay right."""

import numpy as np
import pyarrow as pa

from tallyloom.llm import components, jaccard, repeats, shared


def sizes_of(batches, width):
    n = {}
    for b in batches:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            n[part] = n.get(part, 0) + len(blob) // width
    return np.array(sorted(n.values()))


def test_a_passage_of_many_documents_spreads():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 400, np.uint8))
    texts = [bytes(rng.integers(97, 123, 300, np.uint8)) + passage for _ in range(4000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000)), "text_hash": pa.array(range(4000)), "text": pa.array([t.decode() for t in texts])})
    n = sizes_of(repeats._list(100, 200)(iter([batch])), repeats._AT.itemsize)
    assert len(n) == 200 and n[-1] <= 2 * np.median(n)


def shared_signature_batches():
    """Distinct sets of 40 words, of which 39 are the same, among others."""
    common = " ".join(f"c{i}" for i in range(39))
    texts = [f"{common} own{i}" if i % 3 else " ".join(f"x{i}y{j}" for j in range(40)) for i in range(9000)]
    return [pa.RecordBatch.from_pydict({"text": pa.array(texts[a : a + 3000])}) for a in range(0, 9000, 3000)]


def test_a_hot_signature_spreads_and_meets():
    plan = jaccard.allocate({b: 4000 for b in range(60)}, 80)
    found = list(jaccard._index(1, 80, plan, 64)(iter(shared_signature_batches())))
    n = sizes_of(found, 17)
    assert len(n) == 64 and n[-1] <= 2 * np.median(n)
    parts = {}
    for b in found:
        for part, blob in zip(b.column("part").to_pylist(), b.column("blob").to_pylist()):
            parts.setdefault(part, []).append(blob)
    by_sig, pairs = {}, set()
    for blobs in parts.values():
        t = jaccard._meet(pa.table({"blob": pa.array(blobs, pa.binary())})).to_pydict()
        for a, b, many in zip(t["a"], t["b"], t["many"]):
            by_sig.setdefault(a, set()).add(b) if many else pairs.add((a, b))
    want = {}
    with np.errstate(over="ignore"):
        sets = {jaccard.set_key(s): s for b in shared_signature_batches() for s in jaccard.shingle_sets([x.encode() for x in b.column("text").to_pylist()], 1)}
        sig, of = jaccard.signatures(list(sets.values()), plan, 80)
    names = list(sets)
    for s, i in zip(sig.view(np.int64).tolist(), of.tolist()):
        want.setdefault(s, set()).add(names[i])
    assert {s: c for s, c in want.items() if len(c) > jaccard.PAIR_SETS} == {s: c for s, c in by_sig.items() if len(c) > 1}
    assert pairs == {(a, b) for c in want.values() if len(c) <= jaccard.PAIR_SETS for a in c for b in c if a < b}


def test_components_of_a_star(spark):
    edges = [(i, 0) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5060)] + [(7000, 7000), (None, 8000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{i: 5000 for i in range(5000, 5061)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_discarded_tables_are_gone(spark):
    table = shared.written(spark.range(5), "five")
    assert table.count() == 5
    shared.discard(table)
    import os

    assert not os.path.exists(table._scratch.removeprefix("file://"))


def test_stretches():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, depth = int(rng.integers(1, 12)), int(rng.integers(1, 9))
        lo = rng.integers(0, 60, n)
        hi = lo + rng.integers(0, 5, n)
        cover = np.zeros(100, bool)
        for a, b in zip(lo, hi):
            cover[a : b + depth] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(int), [0]])))
        first, end = repeats._stretches(lo, hi, depth)
        assert first.tolist() == edges[::2].tolist() and end.tolist() == edges[1::2].tolist()
