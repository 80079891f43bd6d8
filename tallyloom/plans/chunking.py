"""Chunks of parsed files: sections, tables and images, three plans over one table of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import layout, sequences

#: What a file's configuration says unless it or its collection says otherwise (fixed values).
DEFAULTS = {"sections": {"enabled": True, "target_level": 2, "max_chars": 8192}, "tables": {"enabled": True, "include_caption": True, "max_caption_gap": 0.04}, "images": {"enabled": True, "include_caption": True, "require_caption": True, "max_caption_gap": 0.04}}
#: The number that a heading begins with, whose parts are its level, and the beginnings of captions (fixed patterns).
NUMBERED, TABLE_CAPTION, FIGURE_CAPTION = r"^\s*(\d+(?:\.\d+)*)", r"^\s*(?:表|(?i:table))\s*\d", r"^\s*(?:图|(?i:fig(?:ure)?\.?))\s*\d"
_BOX = ("x0", "y0", "x1", "y1")


def merged(*layers: dict | None) -> dict:
    """Nested configurations, later over earlier; a null layer or value says nothing."""
    out: dict = {}
    for layer in layers:
        for k, v in (layer or {}).items():
            if isinstance(v, dict):
                out[k] = merged(out.get(k) if isinstance(out.get(k), dict) else None, v)
            elif v is not None:
                out[k] = v
    return out


def blocks(pages: DataFrame) -> DataFrame:
    """file, page, at, type, content and a box of each block of ``pages`` (file, page, blocks), in the order of the
    page; a block without a box of four numbers has a null one."""
    each = pages.filter("blocks IS NOT NULL").select("file", "page", F.posexplode("blocks").alias("at", "b"))
    return each.select("file", "page", "at", F.col("b.type").alias("type"), F.trim(F.coalesce("b.content", F.lit(""))).alias("content"), *[F.get("b.bbox", F.lit(i)).alias(c) for i, c in enumerate(_BOX)])


def heading_level(content: Column) -> Column:
    """The parts of a heading's number; 1 without a number."""
    number = F.regexp_extract(content, NUMBERED, 1)
    return F.when(number == "", 1).otherwise(F.size(F.split(number, r"\.")))


def section_chunks(b: DataFrame, target_level: int = 2, max_chars: int = 8192) -> DataFrame:
    """file, kind, page, place, part, title, text: a section of the target level or above with all that is below it,
    in parts of whole blocks where it has more than ``max_chars``; what comes before the first is a section without a
    title. Tables and images are no part of it."""
    texts = b.filter("type IN ('title', 'text') AND content <> ''")
    order = Window.partitionBy("file").orderBy("page", "at")
    opens = (F.col("type") == "title") & (heading_level(F.col("content")) <= target_level)
    seq = texts.withColumn("seq", F.row_number().over(order)).withColumn("unit", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sized = seq.withColumn("key", F.concat_ws("/", F.col("file").cast("string"), F.col("unit").cast("string"))).withColumn("chars", F.length("content").cast("long") + 1)
    parts = sequences.packed(sized.select("key", "file", "unit", "seq", "page", "type", "content", "chars"), "key", "seq", "chars", max_chars)
    head = F.min_by(F.when((F.col("type") == "title") & (F.col("unit") > 0), F.col("content")), "seq")
    titles = seq.groupBy("file", "unit").agg(head.alias("title")).withColumnsRenamed({"file": "f", "unit": "u"})
    lines = F.sort_array(F.collect_list(F.struct("seq", "content")))
    units = parts.groupBy("file", "unit", "part").agg(F.min("page").alias("page"), F.min("seq").alias("place"), F.array_join(F.transform(lines, lambda x: x["content"]), "\n").alias("text"))
    met = units.join(titles, F.col("file").eqNullSafe(F.col("f")) & (F.col("unit") == F.col("u")))
    return met.select("file", F.lit("section").alias("kind"), "page", F.col("place").cast("long").alias("place"), F.col("part").cast("long").alias("part"), F.coalesce("title", F.lit("")).alias("title"), "text")


def _paged(b: DataFrame) -> DataFrame:
    """A page of a file as one key, for operators on pages; blocks without a box lie nowhere."""
    return b.filter(F.col("x0").isNotNull() & F.col("y1").isNotNull()).withColumn("id", F.col("page").cast("long") * 1_000_000 + F.col("at")).withColumn("sheet", F.concat_ws("/", F.col("file").cast("string"), F.col("page").cast("string")))


def table_chunks(b: DataFrame, include_caption: bool = True, max_caption_gap: float = 0.04) -> DataFrame:
    """file, kind, page, place, part, title, text: a table with the caption nearest above it and those stacked with
    that; a table without one has no title."""
    paged = _paged(b)
    t, c = paged.filter("type = 'table'"), paged.filter("type = 'table_caption'").filter(F.col("content").rlike(TABLE_CAPTION) | (F.col("content") != ""))
    first = c.filter(F.col("content").rlike(TABLE_CAPTION))
    key = lambda df: df.withColumn("id", F.concat_ws("/", "sheet", F.col("at").cast("string")))
    near = layout.nearest_above(key(t), key(first), ["sheet"], max_caption_gap, 0.45) if include_caption else key(t).select("id", F.lit("").alias("caption_id")).limit(0)
    primary = key(t).select("id", F.col("sheet").alias("page"), F.col("y0").alias("top")).join(near, "id").join(key(first).select(F.col("id").alias("caption_id"), "at", F.col("content").alias("text"), *_BOX), "caption_id").withColumnRenamed("id", "item")
    stacked = layout.stacked_captions(primary, c.select(F.col("sheet").alias("page"), "at", F.col("content").alias("text"), *_BOX), max_caption_gap)
    met = key(t).join(stacked.select(F.col("item").alias("id"), F.col("text").alias("title")), "id", "left")
    text = F.concat_ws("\n", "title", "content")
    return met.select("file", F.lit("table").alias("kind"), "page", F.col("at").cast("long").alias("place"), F.lit(0).cast("long").alias("part"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))


def image_chunks(b: DataFrame, include_caption: bool = True, require_caption: bool = True, max_caption_gap: float = 0.04) -> DataFrame:
    """file, kind, page, place, part, title, text: an image with the caption below it among the four blocks that follow;
    where one is required, images without are left out."""
    paged = _paged(b).select("file", F.col("page").alias("number"), "type", "content", F.col("sheet").alias("page"), F.col("at").cast("long").alias("at"), *_BOX)
    i = paged.filter("type = 'image'")
    caption = F.col("type").isin("image_caption", "text") & F.col("content").rlike(FIGURE_CAPTION)
    near = layout.next_caption(i, paged, max_caption_gap, caption if include_caption else F.lit(False)).withColumnsRenamed({"page": "p", "at": "a"})
    met = i.join(near, (F.col("page") == F.col("p")) & (F.col("at") == F.col("a")), "left")
    texts = paged.select(F.col("page").alias("cp"), F.col("at").alias("ca"), F.col("content").alias("title"))
    met = met.join(texts, (F.col("page") == F.col("cp")) & (F.col("caption_at") == F.col("ca")), "left")
    out = met.select("file", F.lit("image").alias("kind"), F.col("number").alias("page"), F.col("at").alias("place"), F.lit(0).cast("long").alias("part"), F.coalesce("title", F.lit("")).alias("title"), F.concat_ws("\n", "title", F.when(F.col("content") != "", F.col("content"))).alias("text"))
    return out.filter("title <> ''") if require_caption else out


def chunks(pages: DataFrame, config: dict | None = None, existing: DataFrame | None = None) -> DataFrame:
    """file, kind, page, place, part, title, text and sha of all chunks of ``pages`` (file, page, blocks), by the
    merged configuration: kinds that are not enabled are left out, and so are chunks whose file and text ``existing``
    (file, sha) has."""
    c, b = merged(DEFAULTS, config), blocks(pages)
    take = {"sections": section_chunks, "tables": table_chunks, "images": image_chunks}
    out = None
    for name, plan in take.items():
        if c[name]["enabled"]:
            own = plan(b, **{k: v for k, v in c[name].items() if k != "enabled"})
            out = own if out is None else out.unionByName(own)
    if out is None:
        out = section_chunks(b.limit(0))
    out = out.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    if existing is not None:
        e = existing.select(F.col("file").alias("_f"), F.col("sha").alias("_s"))
        out = out.join(e, F.col("file").eqNullSafe(F.col("_f")) & (F.col("sha") == F.col("_s")), "left_anti")
    return out
