"""Sources and sinks: round trips, damage as values, bytes of each encoding."""

import io
import json
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import decoding, text
from tallyloom.sources import archives, reports

RAW = ["", "ascii", "é€\U0001f600", "日本語\nx"]


def test_utf8_by_batch():
    rng = random.Random(1)
    raw = [bytes(rng.choice((0x41, 0x7F, 0x80, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xA0, 0x9F, 0xED, 0xEF, 0xF0, 0x90, 0x8F, 0xF4, 0xF5, 0xFF)) for _ in range(rng.randrange(7))) for _ in range(20_000)]
    raw += [x.encode() for x in RAW] + ["é".encode()[:1]]

    def valid(b):
        try:
            b.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True

    want = [valid(b) for b in raw]
    assert decoding.valid_utf8(raw).tolist() == want and 100 < sum(want) < len(want)


def test_long_texts_are_decoded_in_bounded_memory(monkeypatch):
    rng = random.Random(5)
    raw = [bytes(rng.choices(range(256), k=rng.randrange(4))) + "é€𝄞a".encode()[: rng.randrange(11)] for _ in range(3000)]
    want = decoding.valid_utf8(raw).tolist()
    monkeypatch.setattr(decoding, "SIDE", 5)
    assert decoding.valid_utf8(raw).tolist() == want
    monkeypatch.undo()
    long = ("é€ " * 1_500_000).encode()
    tracemalloc.start()
    assert decoding.valid_utf8([long, long[:-2]]).tolist() == [True, False]
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()



def test_decode_chain(spark):
    rows = [(x.encode(), x) for x in RAW] + [("﻿bom".encode(), "﻿bom"), ("变压器é".encode("gb18030"), "变压器é"), ("�变é".encode("gb18030"), "�变é"), (b"a\xff\xffb", "a��b"), (None, None)]
    rows += [("voilà déjà né".encode().decode("latin1").encode(), "voilà déjà né")]
    df = spark.createDataFrame(rows, "raw binary, want string")
    assert [r.t for r in df.select(decoding.decoded(F.col("raw")).alias("t")).collect()] == [w for _, w in rows]


def test_latex_at_any_depth(spark):
    deep = r"\text{" * 9 + "x" + "}" * 9 + r" \frac{\sqrt{\text{\mathrm{a}}}}{b}"
    (r,) = spark.createDataFrame([(deep,)], "t string").select(text.latex(F.col("t")).alias("t")).collect()
    assert r.t == "x (sqrt(a))/(b)"


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_archives(spark, tmp_path):
    pages = [[{"type": "text", "content": f"é {i}", "bbox": [0, 1, 2.5, i]}, "no block", {"type": 3, "content": None, "bbox": "x"}] for i in range(700)]
    zipped(tmp_path / "good.zip", {"x/a_model.json": json.dumps([*pages, {"not": "a page"}], ensure_ascii=False), "full.md": "text"})
    zipped(tmp_path / "none.zip", {"full.md": "text"})
    zipped(tmp_path / "object.zip", {"a_model.json": '{"a": 1}'})
    zipped(tmp_path / "empty.zip", {"a_model.json": " [ ] "})
    zipped(tmp_path / "cut.zip", {"a_model.json": json.dumps(pages[:5])[:-40]})
    (tmp_path / "bad.zip").write_bytes(b"PK no archive")
    (tmp_path / "note.txt").write_text("other")
    whole = (tmp_path / "good.zip").read_bytes()
    (tmp_path / "half.zip").write_bytes(whole[: len(whole) // 2])
    df = archives.layout_pages(spark, f"file://{tmp_path}").withColumn("archive", F.regexp_extract("archive", "([a-z]+).zip", 1))
    got = {}
    for r in df.collect():
        got.setdefault(r.archive, []).append(r)
    assert sorted(got) == ["bad", "cut", "good", "half", "none", "object"]  # an empty layout has no page
    good = sorted(got["good"], key=lambda r: r.page)
    assert [r.page for r in good] == list(range(701)) and good[700].blocks == [] and all(r.error is None for r in good)
    assert [tuple(b) for b in good[9].blocks] == [("text", "é 9", [0.0, 1.0, 2.5, 9.0]), ("3", None, None)]
    assert [r.page for r in got["cut"]] == [0, 1, 2, 3, None] and "JSONDecodeError" in got["cut"][-1].error
    assert [(r.page, bool(r.error)) for x in ("bad", "half", "none", "object") for r in got[x]] == [(None, True)] * 4
    narrow = archives.layout_pages(spark, f"file://{tmp_path}/good.zip", ("page",))
    assert narrow.columns == ["page"] and narrow.count() == 701


class Slow(io.RawIOBase):
    """Gives few bytes at once, and remembers how many were asked for."""

    def __init__(self, data):
        self.data, self.at, self.most = data, 0, 0

    def read(self, n=-1):
        self.most = max(self.most, n)
        out = self.data[self.at : self.at + min(n, 7)]
        self.at += len(out)
        return out


@pytest.mark.parametrize("value", [[], [1, 23, 456.5, -7], ["a]", '"', "é" * 40], [[{"a": [1, "]"]}], [], {}], [None, True]])
def test_elements_of_a_list(value):
    for data in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=2), "﻿" + json.dumps(value)):
        assert list(archives.elements(Slow(data.encode()), 5)) == value


def test_elements_hold_one_at_a_time():
    class Counted(io.BytesIO):
        most = 0

        def read(self, n):
            self.most = max(self.most, n)
            return super().read(n)

    stream = Counted(json.dumps([["x" * 50]] * 3000).encode())
    assert sum(1 for _ in archives.elements(stream, 64)) == 3000 and stream.most <= 256


def test_layouts_round_trip(spark, tmp_path):
    rows = [(f"n{a}", p, [("text", f"{a} {p} é", [0.0, 1.0, 2.0, 3.0])] * (p % 3)) for a in range(5) for p in range(40)]
    df = spark.createDataFrame(rows, f"archive string, page int, blocks array<{archives.BLOCK}>")
    assert sorted(r.archive for r in archives.write_layouts(df, f"file://{tmp_path}/z").collect()) == [f"n{a}" for a in range(5)]
    back = archives.layout_pages(spark, f"file://{tmp_path}/z").collect()
    assert sorted((r.member.removesuffix("_model.json"), r.page, [tuple(b) for b in r.blocks]) for r in back) == rows


def test_a_thousand_reports(spark, tmp_path):
    header = spark.range(1000).select(F.col("id").cast("string").alias("run_id"), F.lit(1).alias("version"), F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("scope"), F.concat(F.lit("/a/b"), "id", F.lit(".tar.md")).alias("report"), F.lit(None).cast("string").alias("started_at"))
    cases = spark.range(5000).select((F.col("id") % 700).cast("string").alias("run_id"), F.concat(F.lit("c"), "id").alias("case_id"), F.when(F.col("id") % 3 == 0, "supported").otherwise("mismatch").alias("status"))
    runs = reports.final_reports(cases, header)
    path = f"file://{tmp_path}/r"
    reports.write_reports(runs.filter("run_id % 10 <> 3"), path)
    whole = F.to_json(F.struct(*runs.columns))
    runs.filter("run_id % 10 = 3").select(F.substring(whole, F.lit(1), F.length(whole) - 9).alias("value")).write.text(f"{path}/by_scope=cut")
    got = reports.report_headers(spark, path).collect()
    good = {int(r.run_id): r for r in got if r.parse_error is None}
    assert len(got) == 1000 and sorted(good) == [i for i in range(1000) if i % 10 != 3]
    assert all(r.run_id is None and r.case_count is None and "not a JSON document" in r.parse_error for r in got if r.parse_error)
    n = {i: [j for j in range(5000) if j % 700 == i] for i in range(1000)}
    assert all(r.case_count == len(n[i]) and (r.judgments or {}).get("supported", 0) == sum(j % 3 == 0 for j in n[i]) for i, r in good.items())
    assert all(r.scope == f"s{i % 4}" and r.report_file_name == f"b{i}.tar" and r.started_at and r.kind == "report" for i, r in good.items())
