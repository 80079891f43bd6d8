"""Blocks on pages, table rows and fuzzy matches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_above(blocks: DataFrame, captions: DataFrame, page: list[str], max_gap: float, min_overlap: float) -> DataFrame:
    """id, caption_id of the caption nearest above each block of its page: a vertical gap of at most
    ``max_gap`` and a share of at least ``min_overlap`` of the narrower width in common; of equal gaps the
    least id. A page may hold many blocks: equal boxes are compared once, and only with boxes whose lower edge
    is within a band or two of ``max_gap`` above. Of a box's captions the two least ids do, as a block is not
    its own caption."""
    box, least = ["x0", "y0", "x1", "y1"], Window.partitionBy(*page, "x0", "y0", "x1", "y1").orderBy("id")
    band = lambda y: F.floor(F.col(y).cast("double") / (max_gap or 1.0))
    c = captions.filter("id IS NOT NULL").select(*page, *box, "id").withColumn("_n", F.dense_rank().over(least)).filter("_n <= 2")
    c = c.select(*[F.col(k).alias(f"_{k}") for k in page], F.col("id").alias("caption_id"), *[F.col(k).alias(f"c{k}") for k in box], band("y1").alias("cband")).distinct()
    b = blocks.select(*page, *box).distinct().withColumn("band", F.explode(F.sequence(band("y0") - 2, band("y0") + 1)))
    gap = F.col("y0") - F.col("cy1")
    shared = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    overlap = shared / F.least(F.col("x1") - F.col("x0"), F.col("cx1") - F.col("cx0"))
    same = [F.col(k) == F.col(f"_{k}") for k in page] + [F.col("band") == F.col("cband")]
    met = b.join(c, same).filter((gap >= 0) & (gap <= max_gap) & (overlap >= min_overlap)).groupBy(*page, *box, "caption_id").agg(F.min(gap).alias("gap"))
    near = Window.partitionBy(*page, *box).orderBy("gap", "caption_id")
    near = met.withColumn("_n", F.row_number().over(near)).filter("_n <= 2").select(*[F.col(k).alias(f"_{k}") for k in (*page, *box)], "gap", "caption_id")
    all_ = blocks.filter("id IS NOT NULL").join(near, [F.col(k) == F.col(f"_{k}") for k in (*page, *box)]).filter("id <> caption_id")
    return all_.groupBy("id").agg(F.min_by("caption_id", F.struct("gap", "caption_id")).alias("caption_id"))


def bound_rows(rows: DataFrame, key: str, row: str, satisfied: Column) -> DataFrame:
    """key, row, matched: the row that satisfies all selectors, where exactly one does."""
    return rows.filter(satisfied).groupBy(key).agg(F.min(row).alias("r"), F.count(F.lit(1)).alias("n")).select(key, F.when(F.col("n") == 1, F.col("r")).alias(row), (F.col("n") == 1).alias("matched"))


def next_caption(images: DataFrame, blocks: DataFrame, max_gap: float, is_caption: Column, window: int = 4, slack: float = 0.005, min_overlap: float = 0.35) -> DataFrame:
    """page, at, caption_at: of the ``window`` blocks after an image in the order of its page, the caption nearest
    below it; of equal gaps the later. A caption begins at most ``slack`` above the image's lower edge and at most
    ``max_gap`` below it, and shares ``min_overlap`` of the narrower width. Both sides have page, at and a box."""
    box = ("x0", "y0", "x1", "y1")
    near = images.select("page", "at", *box, F.explode(F.sequence(F.col("at") + 1, F.col("at") + window)).alias("caption_at"))
    c = blocks.filter(is_caption).select("page", F.col("at").alias("caption_at"), *[F.col(k).alias(f"c{k}") for k in box])
    gap = F.col("cy0") - F.col("y1")
    shared = F.greatest(F.lit(0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) / F.greatest(F.lit(0.001), F.least(F.col("x1") - F.col("x0"), F.col("cx1") - F.col("cx0")))
    met = near.join(c, ["page", "caption_at"]).filter((gap >= -slack) & (gap <= max_gap) & (shared >= min_overlap))
    return met.groupBy("page", "at").agg(F.min_by("caption_at", F.struct(gap.alias("gap"), (-F.col("caption_at")).alias("later"))).alias("caption_at"))


def stacked_captions(primaries: DataFrame, captions: DataFrame, max_gap: float = 0.04, min_overlap: float = 0.45, slack: float = 0.005) -> DataFrame:
    """page, item, text and box (x0, y0, x1, y1) of each item's caption with those that are stacked with it.

    ``primaries``: page, item, top (of the item that the caption is of), at, text and a box; ``captions``: page, at,
    text and a box. A caption is stacked with a primary one if it ends above the item, shares ``min_overlap`` of the
    narrower width and is at most ``max_gap`` above or below it. Texts are joined in the order of their upper
    edges, of equals the primary first and then by place; boxes are united. A page's blocks meet only within bands of
    ``max_gap`` by y, and a pair in one of them."""
    box = ("x0", "y0", "x1", "y1")
    band = lambda y: F.floor(y / max_gap).cast("long")
    p = primaries.withColumn("low", band(F.col("y0") - max_gap)).withColumn("band", F.explode(F.sequence("low", band(F.col("y1") + max_gap))))
    c = captions.filter("trim(text) <> ''").select("page", F.col("at").alias("cat"), F.col("text").alias("ctext"), *[F.col(k).alias(f"c{k}") for k in box], band(F.col("y0")).alias("clow"))
    c = c.withColumn("band", F.explode(F.sequence("clow", F.greatest("clow", band(F.col("cy1"))))))
    shared = F.greatest(F.lit(0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) / F.greatest(F.lit(0.001), F.least(F.col("x1") - F.col("x0"), F.col("cx1") - F.col("cx0")))
    gap = F.greatest(F.lit(0), F.greatest("y0", "cy0") - F.least("y1", "cy1"))
    met = p.join(c, ["page", "band"]).filter((F.col("band") == F.greatest("low", "clow")) & (F.col("cat") != F.col("at")) & (F.col("cy1") <= F.col("top") + slack) & (shared >= min_overlap) & (gap <= max_gap))
    part = lambda first, at, text, *b: F.struct(b[1].alias("y0"), F.lit(first).alias("first"), at.alias("at"), F.trim(text).alias("text"), b[0].alias("x0"), b[2].alias("x1"), b[3].alias("y1"))
    col = lambda *names: [F.col(n) for n in names]
    own = primaries.select("page", "item", part(0, *col("at", "text", *box)).alias("part"))
    other = met.select("page", "item", part(1, *col("cat", "ctext", *[f"c{k}" for k in box])).alias("part"))
    parts = F.sort_array(F.collect_list("part"))
    ends = [F.min("part.x0").alias("x0"), F.min("part.y0").alias("y0"), F.max("part.x1").alias("x1"), F.max("part.y1").alias("y1")]
    united = own.unionAll(other).groupBy("page", "item").agg(parts.alias("parts"), *ends)
    return united.select("page", "item", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"), *box)


_TABLE, _ROW = re.compile(r"(?is)<table\b[^>]*>(.*?)</table>"), re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr>")
_CELL, _SPAN = re.compile(r"(?is)<t[dh]\b([^>]*)>(.*?)</t[dh]>"), re.compile(r"""(?i)\b(row|col)span\s*=\s*["']?(\d+)""")
_TAG = re.compile(r"<[^>]+>")


def table_grid(html: str) -> list[tuple[int, int, str]]:
    """(row, column, value) of a table's cells; one that spans rows or columns has its value in each place."""
    out, taken = [], set()
    for r, row in enumerate(_ROW.findall(html)):
        c = 0
        for attributes, body in _CELL.findall(row):
            while (r, c) in taken:
                c += 1
            span = {name.lower(): max(int(n), 1) for name, n in _SPAN.findall(attributes)}
            value = " ".join(unescape(_TAG.sub(" ", body)).split())
            places = [(r + down, c + right) for down in range(span.get("row", 1)) for right in range(span.get("col", 1))]
            taken.update(places)
            out += [(*p, value) for p in places]
    return sorted(out)


def table_cells(pages: DataFrame) -> DataFrame:
    """id, tab, row, col, value for each cell of each table of ``pages`` (id, html), spans filled. A table's rows are
    read in order, as a span decides where later cells lie."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t, *cell) for i, html in zip(batch.column("id").to_pylist(), batch.column("html").to_pylist()) for t, table in enumerate(_TABLE.findall(html or "")) for cell in table_grid(table)]
            cols = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["id", "tab", "row", "col", "value"])

    return pages.select(F.col("id").cast("long").alias("id"), "html").mapInArrow(cells, "id long, tab long, row long, col long, value string")
