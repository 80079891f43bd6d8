"""Layout archives: zip files with a JSON member of pages of blocks, as a Spark data source."""

from __future__ import annotations

import codecs
import json
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: What a layout member's name ends with (a fixed value).
MEMBER = "_model.json"
BLOCK = "struct<type:string,content:string,bbox:array<double>>"
SCHEMA = f"archive string, member string, page int, blocks array<{BLOCK}>, error string"
_ARROW = {"archive": pa.string(), "member": pa.string(), "page": pa.int32(), "blocks": pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("bbox", pa.list_(pa.float64()))])), "error": pa.string()}
#: Bytes of archives that a partition takes together, of a member read at once, and pages of a batch.
_TOGETHER, _CHUNK, _PAGES = 64 << 20, 1 << 16, 256


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def elements(stream, chunk: int = _CHUNK) -> Iterator[Any]:
    """The elements of a JSON list, read as they come: what is held is one element and what was read beyond it."""
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    held, ended, want, began = "", False, chunk, False
    while True:
        held = held.lstrip(" \t\r\n," if began else " \t\r\n﻿")
        if not began and held:
            if held[0] != "[":
                raise ValueError("not a list of pages")
            held, began = held[1:], True
            continue
        if began and held.startswith("]"):
            return
        if held:
            try:
                value, end = decoder.raw_decode(held)
            except json.JSONDecodeError:
                if ended:
                    raise
            else:
                if end < len(held) or ended:  # a number may go on
                    yield value
                    held, want = held[end:], chunk
                    continue
        elif ended:
            raise ValueError("the list does not end")
        raw = stream.read(want)
        held, ended, want = held + decode.decode(raw, not raw), not raw, 2 * want


def _numbers(value: Any) -> list[float] | None:
    return [float(x) for x in value] if isinstance(value, list) and all(isinstance(x, (int, float)) for x in value) else None


def _text(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def page_blocks(page: Any) -> list[dict]:
    """A page's blocks; what is no page has none, and what is no block is none."""
    return [{"type": _text(b.get("type")), "content": _text(b.get("content")), "bbox": _numbers(b.get("bbox"))} for b in page if isinstance(b, dict)] if isinstance(page, list) else []


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.suffix = options.get("member", MEMBER)

    def partitions(self) -> list[Files]:
        """Archives by size: large ones alone, small ones together."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File and i.path.endswith(".zip")]
        out, held, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            held.append(i.path)
            size += i.size
            if size >= _TOGETHER:
                out.append(Files(held))
                held, size = [], 0
        return [*out, *([Files(held)] if held else [])] or [Files([])]

    def _rows(self, fs, path: str) -> Iterator[dict]:
        """A row a page; for an archive or member that can't be read a row with the error, after the pages before."""
        member, page = None, 0
        try:
            with fs.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                member = next((n for n in archive.namelist() if n.endswith(self.suffix)), None)
                if member is None:
                    yield {"archive": path, "error": f"no *{self.suffix}"}
                    return
                with archive.open(member) as stream:
                    for page, content in enumerate(elements(stream)):
                        yield {"archive": path, "member": member, "page": page, "blocks": page_blocks(content) if "blocks" in self.columns else None}
        except (OSError, ValueError, EOFError, zlib.error, zipfile.BadZipFile, NotImplementedError) as wrong:
            yield {"archive": path, "member": member, "error": f"{type(wrong).__name__}: {wrong}"}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([(c, _ARROW[c]) for c in self.columns])
        held: list[dict] = []
        for path in partition.paths:
            for row in self._rows(fs, path):
                held.append({c: row.get(c) for c in self.columns})
                if len(held) == _PAGES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)


class LayoutArchives(DataSource):
    """format("layout_archive"): ``path`` is an archive or a folder of them, on any file system that Arrow knows by its
    URI; ``member`` the end of the member's name. Columns that a given schema leaves out are not built."""

    @classmethod
    def name(cls) -> str:
        return "layout_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)


def layout_pages(spark: SparkSession, path: str, columns: tuple[str, ...] = ("archive", "member", "page", "blocks", "error")) -> DataFrame:
    """archive, member, page, blocks and error, or those of them asked for: a row for each page of each archive, with
    its blocks nested, and one with the error for each archive that has no layout or whose layout can't be read to
    its end. An archive is never held whole: its directory and one page at a time are."""
    spark.dataSource.register(LayoutArchives)
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    return spark.read.format("layout_archive").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)


def write_layouts(pages: DataFrame, path: str) -> DataFrame:
    """Writes an archive for each ``archive`` of ``pages`` (archive, page, blocks; null blocks: a page that is damaged
    on purpose, where the member ends) to the folder and gives their names. A task streams an archive's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        name, done = None, []
        file = archive = member = None

        def close(broken: bool) -> None:
            if not broken:
                member.write(b"]")
            member.close()
            archive.close()
            file.close()

        broken, first = False, True
        for batch in batches:
            for new, blocks in zip(batch.column("archive").to_pylist(), batch.column("blocks").to_pylist()):
                if new != name:
                    if name is not None:
                        close(broken)
                    name, broken, first = new, False, True
                    file = fs.open_output_stream(f"{root}/{name}.zip")
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open(f"{name}{MEMBER}", "w", force_zip64=True)
                    member.write(b"[")
                    done.append(name)
                broken |= blocks is None
                if not broken:
                    member.write((b"" if first else b",") + json.dumps(blocks, ensure_ascii=False).encode())
                    first = False
        if name is not None:
            close(broken)
        yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})

    return pages.repartition("archive").sortWithinPartitions("archive", "page").mapInArrow(run, "archive string")
