"""The chunk pipeline against a walk over blocks."""

import random
import re

from pyspark.sql import functions as F

from tallyloom.plans import chunking
from tallyloom.sources.archives import BLOCK


def brute(pages, level, most, gap, require):
    out = []
    for file in {p[0] for p in pages}:
        own = sorted((p for p in pages if p[0] == file), key=lambda p: p[1])
        units, flat = [["", []]], 0
        for _, page, blocks in own:
            for at, (kind, content, box) in enumerate(blocks or []):
                content = (content or "").strip()
                if kind in ("title", "text") and content:
                    flat += 1
                    number = re.match(r"\s*(\d+(?:\.\d+)*)", content)
                    if kind == "title" and (len(number[1].split(".")) if number else 1) <= level:
                        units.append([content, []])
                    units[-1][1].append((flat, page, content))
                if kind == "image":
                    best = None
                    for j in range(at + 1, min(at + 5, len(blocks))):
                        k, c, b = blocks[j]
                        g = b[1] - box[3]
                        if k in ("image_caption", "text") and re.match(r"图 ?\d", (c or "").strip()) and -0.005 <= g <= gap and max(0, min(box[2], b[2]) - max(box[0], b[0])) / min(box[2] - box[0], b[2] - b[0]) >= 0.35:
                            best = min(best or (g, -j), (g, -j))
                    title = blocks[-best[1]][1].strip() if best else ""
                    if title or not require:
                        out.append((file, "image", page, at, 0, title, "\n".join(x for x in (title, content) if x)))
                if kind == "table":
                    near = None
                    for j, (k, c, b) in enumerate(blocks):
                        g = box[1] - b[3]
                        if k == "table_caption" and re.match(r"表 ?\d", (c or "").strip()) and 0 <= g <= gap and (min(box[2], b[2]) - max(box[0], b[0])) / min(box[2] - box[0], b[2] - b[0]) >= 0.45:
                            near = min(near or (g, f"{file}/{page}/{j}", j), (g, f"{file}/{page}/{j}", j))
                    title = None
                    if near:
                        p = blocks[near[2]]
                        parts = [(p[2][1], 0, near[2], p[1].strip())]
                        for j, (k, c, b) in enumerate(blocks):
                            if j != near[2] and k == "table_caption" and (c or "").strip() and b[3] <= box[1] + 0.005 and max(0, min(p[2][2], b[2]) - max(p[2][0], b[0])) / max(0.001, min(p[2][2] - p[2][0], b[2] - b[0])) >= 0.45 and max(0, max(p[2][1], b[1]) - min(p[2][3], b[3])) <= gap:
                                parts.append((b[1], 1, j, c.strip()))
                        title = "\n".join(x[3] for x in sorted(parts))
                    out.append((file, "table", page, at, 0, title or "", "\n".join(x for x in (title, content) if x is not None)))
        for title, lines in units:
            part, held, parts = 0, 0, {}
            for seq, page, content in lines:
                if parts.get(part) and held + len(content) + 1 > most:
                    part, held = part + 1, 0
                held += len(content) + 1
                parts.setdefault(part, []).append((seq, page, content))
            out += [(file, "section", min(x[1] for x in p), p[0][0], n, title, "\n".join(x[2] for x in p)) for n, p in parts.items()]
    return sorted(out)


def pages_of(rng):
    pages = []
    for file in range(12):
        for page in range(rng.randrange(1, 4)):
            blocks, y = [], 0.0
            for i in range(rng.randrange(12)):
                kind = rng.choice(["title", "text", "text", "table", "table_caption", "table_caption", "image", "image_caption"])
                content = {"title": f"{rng.choice(['1', '1.2', '1.2.3', 'A'])} head", "table_caption": rng.choice(["表1 a", "（续）", "表 2", ""]), "image_caption": rng.choice(["图1 f", "note"])}.get(kind, rng.choice([f"body {i} " * 3, " ", None]))
                x, w, h = rng.randrange(3) / 10, rng.randrange(3, 7) / 10, rng.randrange(1, 5) / 100
                blocks.append((kind, content, [x, round(y, 3), x + w, round(y + h, 3)]))
                y += h + rng.randrange(-1, 5) / 100
            pages.append((file, page, blocks))
    return pages + [(50, 0, None), (51, 0, [])]


def test_chunks(spark):
    pages = pages_of(random.Random(8))
    df = spark.createDataFrame(pages, f"file long, page int, blocks array<{BLOCK}>").repartition(3)
    config = {"sections": {"target_level": 2, "max_chars": 60}, "images": {"require_caption": False}, "tables": {"max_caption_gap": None}}
    got = chunking.chunks(df, config)
    assert sorted(tuple(r)[:7] for r in got.collect()) == brute(pages, 2, 60, 0.04, False)
    only = chunking.chunks(df, {"sections": {"enabled": False}, "tables": {"enabled": False}})
    assert sorted(tuple(r)[:7] for r in only.collect()) == [r for r in brute(pages, 2, 60, 0.04, True) if r[1] == "image"]
    some = got.filter("kind = 'table'").select("file", "sha")
    assert chunking.chunks(df, config, some).filter("kind = 'table'").count() == 0
    assert chunking.chunks(df, {k: {"enabled": False} for k in chunking.DEFAULTS}).count() == 0


def test_merged():
    assert chunking.merged(chunking.DEFAULTS, None, {"tables": {"max_caption_gap": 0.1, "enabled": None}})["tables"] == {"enabled": True, "include_caption": True, "max_caption_gap": 0.1}


def test_query(spark):
    from tallyloom import queries

    from .conftest import SF

    got = queries.queries()["chunk_pipeline"](spark, SF).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("title") != "").alias("titled")).collect()
    assert {r.kind for r in got} == {"section", "table", "image"} and all(r.titled > 0 for r in got)
