"""Operators over documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import flac, jaccard, line_dedup, mixing, packing, quality, repeats, token_files

from . import cases

BLANK = " \t\n\x0b\x0c\r"


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def line_key(line):
    return line.strip(BLANK).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(data):
    """For each row: its lines and those that stay."""
    docs = Counter(k for _, k in {(r[0], line_key(x)) for r in data for x in (r[1] or "").split("\n")})
    return [(x := (r[1] or "").split("\n"), [y for y in x if not (line_key(y) and docs[line_key(y)] >= 10)]) for r in data]


def test_line_dedup(spark):
    data = cases.rows()
    data += [(500, "only here\nand here", *data[0][2:])] * 10  # ten rows of one document
    data += [(600 + i, None if i % 2 else f"nine\n{i}", *data[0][2:]) for i in range(18)] + [(None, "nine\nnull id", *data[0][2:])] * 3
    want = [(r[0], len(x), len(x) - len(y), hashlib.sha256("\n".join(y).encode()).hexdigest()) for r, (x, y) in zip(data, brute_lines(data))]
    got = line_dedup.line_digest(line_dedup.dedup_lines(spark.createDataFrame(data, cases.SCHEMA).repartition(3)))
    assert collected(got) == sorted(want, key=repr)
    dropped = Counter({w[0]: w[2] for w in want})
    assert dropped[500] == 0 and dropped[600] == dropped[None] == 1 and any(w[2] for w in want if w[0] is not None and w[0] < 500)
    assert line_dedup.line_digest(line_dedup.dedup_lines(cases.empty(spark))).count() == 0


def word_sets(data, width):
    out = {}
    for r in data:
        w = (r[1] or "").encode().lower().split()
        out[r[0]] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    return out


def brute_components(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard(spark, width, percent):
    data = cases.rows()
    sets = word_sets(data, width)
    roots = brute_components(sets, percent)
    want = sorted((r[0], len(sets[r[0]]), roots[r[0]]) for r in data)
    assert sorted(map(tuple, jaccard.jaccard_components(cases.frame(spark), width, percent).collect())) == want
    assert jaccard.jaccard_components(cases.empty(spark), width, percent).count() == 0


def test_jaccard_small_sets_of_every_kind(spark, monkeypatch):
    data = [(i, " ".join(f"w{(i * 7 + j * (1 + i % 3)) % 23}" for j in range(3 + i % 25))) for i in range(150)]
    data += [(200 + i, " ".join(w for j, w in enumerate(data[i][1].split()) if j != 2)) for i in range(40)]
    roots = brute_components(word_sets(data, 1), 80)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for kind in (jaccard.PLAIN, jaccard.SUBSETS, jaccard.DELETIONS):
        monkeypatch.setattr(jaccard, "choose_kind", lambda *_, kind=kind: kind)
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, 1, 80).collect()}
        assert got == roots


def test_jaccard_families_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_SHINGLES", 300)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(40):
        w = list(base)
        w[(i * 5) % 80] = f"x{i}"
        w[(i * 11 + 3) % 80] = f"y{i}"
        data.append((i, " ".join(w)))
    roots = brute_components(word_sets(data, 1), 90)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string"), 1, 90).collect()}
    assert got == roots


def brute_repeats(data, depth):
    order = {}
    for r in data:
        order.setdefault((r[0], r[1]), None)
    first, spans = {}, {}
    docs = sorted({(r[0], r[1] or "") for r in data})
    for key in docs:
        text = key[1].encode()
        for p in range(len(text) - depth + 1):
            first.setdefault(text[p : p + depth], (key[0], p))
    for key in docs:
        text, cover = key[1].encode(), bytearray(len(key[1].encode()))
        for p in range(len(text) - depth + 1):
            if first[text[p : p + depth]] != (key[0], p):
                cover[p : p + depth] = b"\1" * depth
        kept = bytes(c for c, x in zip(text, cover) if not x)
        spans[key] = (len(text), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return sorted((r[0], *spans[(r[0], r[1] or "")]) for r in data)


@pytest.mark.parametrize("depth", [100, 40])
def test_repeats(spark, depth):
    data = cases.rows()
    got = repeats.repeat_digest(repeats.remove_repeats(cases.frame(spark), depth))
    assert sorted(map(tuple, got.collect())) == brute_repeats(data, depth)
    assert repeats.remove_repeats(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [2, 12])
def test_repeats_of_grams_with_many_surroundings(spark, monkeypatch, hot):
    """Grams above the bound are refined to halves, and those above it again to strings."""
    import random

    rng = random.Random(9)
    passage = "".join(rng.choices("abcdefgh ", k=260))
    data = [(i, "".join(rng.choices("xyz ", k=150 + i)) + passage[i % 7 :] + "".join(rng.choices("uvw ", k=150))) for i in range(60)]
    data += [(None, passage + "tail of a null id" * 9), (3, data[3][1]), (100, passage[:130] + passage[:130])]
    monkeypatch.setattr(repeats, "HOT", hot)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = repeats.repeat_digest(repeats.remove_repeats(df)).collect()
    least = [(-1 if i is None else i, t) for i, t in data]
    want = [(None if r[0] == -1 else r[0], *r[1:]) for r in brute_repeats(least, 100)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_repeats_over_chunks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    part = "".join(rng.choice("abcd ") for _ in range(900))
    text = part + "".join(rng.choice("abcd ") for _ in range(500)) + part[100:700]
    found = []
    for size in (1 << 20, 150):
        monkeypatch.setattr(repeats, "_CHUNK", size)
        found.append(sorted(zip(*(x.tolist() for x in repeats.anchors([text.encode()], 100)))))
    covered = [{p for row in f for p in range(row[4], row[5] + 1)} for f in found]
    assert covered[0] == covered[1] == set(range(len(text) - 99))


def test_mix(spark):
    got = [r.asDict() for r in mixing.mix_sources(cases.frame(spark)).collect()]
    data = cases.rows()
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(rf"[^{BLANK}]+", r[1] or ""))
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {n: 1 + i % 3 for i, n in enumerate(names)}
    total, target, open_ = float(sum(sizes.values())), {}, set(names)
    while True:
        left = total - sum(target.values())
        w = sum(weight[n] for n in open_)
        over = [n for n in open_ if weight[n] * left / w > 3 * sizes[n]]
        if not over:
            target.update({n: weight[n] * left / w for n in open_})
            break
        target.update({n: 3.0 * sizes[n] for n in over})
        open_ -= set(over)
    by_id = {r[0]: r[3] for r in data}
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(data)
    for g in got:
        n = by_id[g["doc_id"]]
        assert abs(g["target"] - target[n]) < 1e-6 and g["source_size"] == sizes[n]
        assert 0 <= g["taken"] <= 3 * g["size"]
        taken[n] += g["taken"]
        largest[n] = max(largest[n], g["size"])
    for n in names:
        assert abs(taken[n] - target[n]) <= 3 * largest[n]
    again = sorted(map(tuple, mixing.mix_sources(cases.frame(spark).repartition(5)).collect()))
    assert again == sorted(tuple(g.values()) for g in got)
    assert mixing.mix_sources(cases.empty(spark)).count() == 0
    mixed = mixing.mixed_documents(cases.frame(spark))
    assert mixed.columns == cases.frame(spark).columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(g["doc_id"] for g in got for _ in range(g["repeats"]))


def encoded(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_token_files(spark, tmp_path):
    ids = encoded("byte_bpe_50k.json", 0)
    data = sorted(cases.rows(), key=lambda r: r[0])
    start, want = 0, []
    for r in data:
        x = ids(r[1])
        want.append((r[0], start, len(x), crc(x)))
        start += len(x)
    path = f"file://{tmp_path}/t"
    got = token_files.token_file_round_trip(cases.frame(spark), public_tokenizers.path("byte_bpe_50k.json"), path=path)
    assert sorted(map(tuple, got.collect())) == want
    (one,) = token_files.read_token_files(spark, path).filter("doc_id = 7").collect()
    assert one.ids == ids(next(r[1] for r in data if r[0] == 7))
    assert token_files.token_file_round_trip(cases.empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_token_files_of_repeated_and_null_ids(spark, tmp_path):
    data = [(None, "one two three"), (None, "x"), (4, "b b"), (4, "a much longer text than that"), (4, None), (4, "b b"), (1, ""), (9, "last")]
    path = f"file://{tmp_path}/t"
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(2)
    got = token_files.token_file_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), path=path).collect()
    start, want = 0, []
    for r in token_files.read_token_files(spark, path).orderBy("part", "place").collect():
        want.append((r.doc_id, start, len(r.ids), crc(r.ids)))
        start += len(r.ids)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(want) == len(data)
    assert [r[0] for r in want] == [None, None, 1, 4, 4, 4, 4, 9]


def rows_scanned(df):
    """Rows that the file scan handed on, before Spark's own filter."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value()


def test_token_files_are_skipped_by_id(spark, tmp_path):
    """Stripes and groups of rows by their ranges of ids, and by Bloom filter where an id is in no document."""
    docs = spark.createDataFrame([(2 * i, f"text {i}") for i in range(9000)], "doc_id long, text string").repartition(3)
    path = f"{tmp_path}/t"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), partitions=2, stripe_bytes=1 << 14)
    read = token_files.read_token_files(spark, path)
    assert rows_scanned(read.filter("doc_id = 5000")) <= 1000 < rows_scanned(read.filter("doc_id >= 0")) == 9000
    absent = [rows_scanned(read.filter(f"doc_id = {2 * i + 1}")) for i in range(100, 8900, 800)]
    assert max(absent) <= 1000 and sum(n == 0 for n in absent) >= len(absent) - 2


def test_packing(spark):
    ids = encoded("word_bpe_49k.json", 1)
    data = cases.rows()
    want = []
    for r in data:
        x = ids(r[1])
        want += [(r[0], k, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for k, s in enumerate(range(0, len(x), 4096))]
    got = packing.pack_documents(cases.frame(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 4096
    counts = [0] * 4097
    for w in want:
        counts[w[3]] += 1
    assert len(by) == packing.lower_bound(__import__("numpy").array(counts))
    assert packing.pack_documents(cases.empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_exchanges_between_partitions(spark):
    rows = [(i, 0, 0, 1 + (i * 37) % 1400, 0) for i in range(600)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    out, n, bound = packing.pack(pieces, rows_per_part=50)
    got = out.collect()
    assert len(got) == 600 and len({r.sequence_id for r in got}) == n
    assert bound <= n <= bound + 1
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_flac(spark):
    data = [*cases.rows(), (None, "null id", *cases.rows()[0][2:]), (None, None, *cases.rows()[0][2:]), (7, "another text of id 7", *cases.rows()[0][2:])]
    rows = flac.media_round_trip(spark.createDataFrame(data, cases.SCHEMA).repartition(3)).collect()
    spaced = lambda t: (raw := (t or "").encode()) + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
    assert Counter((r.doc_id, r.payload_sha256) for r in rows) == Counter((r[0], hashlib.sha256(spaced(r[1])).hexdigest()) for r in data)
    same = {}
    assert all(same.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature) for r in rows)
    got, data = {}, cases.rows()
    for r in flac.media_round_trip(cases.frame(spark)).collect():
        got.setdefault(r.doc_id, r)
    for r in data:
        raw = (r[1] or "").encode()
        p = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        g = got[r[0]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    blocks = flac.pcm_blocks(flac.encode_media(cases.frame(spark).filter("doc_id < 9"))).collect()
    for i in range(9):
        own = sorted((b.sample_offset, b.pcm) for b in blocks if b.doc_id == i)
        raw = (data[i][1] or "").encode()
        if i != 5:
            assert b"".join(x for _, x in own).rstrip(b" ") == raw.rstrip(b" ")
    assert flac.media_round_trip(cases.empty(spark)).count() == 0


def test_flac_frame_numbers():
    """Numbers from 128, 2,048 and 65,536 on have two, three and four bytes, as UTF-8 has them."""
    x = [0] * 192
    _, lengths = flac._encode_frames(np.array(x * 8, np.int32), np.full(8, 192), np.array([0, 127, 128, 2047, 2048, 65535, 65536, 2097151]))
    raw, _ = flac._encode_frames(np.array(x * 8, np.int32), np.full(8, 192), np.array([0, 127, 128, 2047, 2048, 65535, 65536, 2097151]))
    at = np.cumsum(lengths) - lengths
    got = [bytes(raw[a + 4 : a + 4 + n]) for a, n in zip(at, (1, 1, 2, 2, 3, 3, 4, 4))]
    assert got == [b"\x00", b"\x7f", b"\xc2\x80", b"\xdf\xbf", b"\xe0\xa0\x80", b"\xef\xbf\xbf", b"\xf0\x90\x80\x80", b"\xf7\xbf\xbf\xbf"]


@pytest.mark.parametrize("size", [192, 147_456, 147_648, 3_000_000 // 192 * 192])
def test_flac_of_long_texts(size):
    import random

    p = " ".join(random.Random(size).choices(["tion", "word", "A", "12"], k=size // 3)).encode()[:size]
    (x,), (frames,) = flac.decode_streams(flac.encode_streams([p]))
    assert (x + 128).astype(np.uint8).tobytes() == p and frames[2].tolist() == list(range(0, size, 1152))


def test_flac_pcm_files(spark, tmp_path):
    media = flac.encode_media(cases.frame(spark))
    got = flac.write_pcm_blocks(media, f"{tmp_path}/pcm").filter("doc_id = 10 AND sample_offset >= 1152").orderBy("sample_offset").collect()
    raw = cases.rows()[10][1].encode()
    raw += b" " * (-len(raw) % 192)
    assert b"".join(r.pcm for r in got) == raw[1152:]


def test_flac_checksums():
    stream = flac.encode_streams([bytes(range(192)) * 9])[0]
    bad = bytearray(stream)
    bad[-40] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(bad)])


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in test) / len(test) > 0.97
    odd = quality.quality_scores(cases.frame(spark), labels.limit(0)).collect()
    assert Counter(r.doc_id for r in odd) == Counter(r[0] for r in cases.rows()) and all((r.score, r.predicted) == (quality.PASS, 1) for r in odd)
    assert quality.quality_scores(cases.empty(spark), labels).count() == 0


def test_repeats_at_a_cut_of_a_long_text(spark):
    import random

    rng, cut = random.Random(4), repeats._CHUNK
    text = "".join(rng.choices("abcdefgh", k=cut + 2000))
    data = [(0, text)] + [(k, text[p : p + 100]) for k, p in enumerate(range(cut - 90, cut + 90, 3), 1)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(df).select("doc_id", "n_removed").collect()}
    assert got == {k: 100 if k else 0 for k, _ in data}
