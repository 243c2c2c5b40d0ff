"""Sources and sinks over small files."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import files


def test_csv_glossary(spark, tmp_path):
    (tmp_path / "g.csv").write_text("source,target,tgt_lng\na,b,de_AT\nc,d,\ne,f,fr\n,g,de\n")
    got = files.csv_glossary(spark, str(tmp_path / "g.csv"), "DE-at")
    assert {r.source for r in got.collect()} == {"a", "c"}
    files.write_csv_glossary(got, str(tmp_path / "out"))
    assert files.csv_glossary(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        files.csv_glossary(spark, str(tmp_path / "bad.csv"))


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"provider": "v", "model_id": "m", "tiers": [{"max_input_tokens": 5, "input_cost_per_1k": 0.1, "output_cost_per_1k": 0.2}]}]))
    assert files.pricing_catalog(spark, str(tmp_path / "p.json")).first().tiers[0].max_input_tokens == 5
    (tmp_path / "r.json").write_text(json.dumps([{"source_language": "en", "target_language": "de", "domain": "legal", "model_chain": [{"model_id": "a", "priority": 1}, {"model_id": "b"}]}]))
    assert [r.model_id for r in files.model_routing(spark, str(tmp_path / "r.json")).collect()] == ["a", "b"]
    (tmp_path / "g.json").write_text(json.dumps({"glossary": {"en": {"terms": [{"source_term": "x", "translations": {"de": "y"}}]}}}))
    assert tuple(files.glossary_json(spark, str(tmp_path / "g.json")).first()) == ("en", 0, "x", "de", "y")


def test_tracking_pairs(spark):
    text = json.dumps({"page": [{"paragraph": [{"input": "a", "output": "b"}, {"input": " ", "pdf_unicode": "c"}, {"output": "lost"}]}], "cross_page": [{"paragraph": [{"input": "d", "output": None}]}]})
    got = spark.createDataFrame([(text,), ('{"page": []}',)], "t string").select(files.tracking_pairs(F.col("t")).alias("p")).collect()
    assert [tuple(x) for x in got[0].p] == [("page", "a", "b"), ("page", "c", ""), ("cross_page", "d", "")]
    assert got[1].p == []


def test_log_lines(spark, tmp_path):
    (tmp_path / "l.log").write_text('{"time": "2024-01-01T00:00:00Z", "message": "m"}\nplain\n{"message": "no time"}\n{broken\n')
    assert [r.message for r in files.json_log(spark, str(tmp_path / "l.log")).collect()] == ["m"]


def test_blobs_and_integrity(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("x\r\ny\n".encode())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('one')}{para(' ')}<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{para('head')}</w:hdr>")
    (tmp_path / "d.bin").write_bytes(b"\xff\xfe\x00")
    blobs = files.blobs(spark, str(tmp_path))
    kinds = {r.path.split("/")[-1]: r.k for r in blobs.select("path", files.container(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.txt": "txt", "b.pdf": "pdf", "c.docx": "docx", "d.bin": None}
    units = files.docx_units(files.blobs(spark, str(tmp_path), "*.docx")).orderBy("unit_id").collect()
    assert [(u.label, u.text) for u in units] == [("header", "head"), ("body", "one"), ("body", "two"), ("body", "link")]
    want = spark.createDataFrame([("a.txt", hashlib.sha3_256(b"x\r\ny\n").hexdigest()), ("b.pdf", "0"), ("z", "0")], "name string, sha3 string")
    assert dict(map(tuple, files.integrity(blobs, want).collect())) == {"a.txt": "ok", "b.pdf": "changed", "z": "missing"}
    assert [r.text for r in files.text_lines(spark, str(tmp_path / "a.txt")).collect()] == ["x", "y"]


def test_page_source_and_append(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\ftwo")
    spark.dataSource.register(files.PageTextSource)
    pages = spark.read.format("page_text").option("paths", str(tmp_path / "d.txt")).load()
    assert [r.text for r in pages.orderBy("page").collect()] == ["one", "two"]
    files.append(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log"))
    files.append(spark.createDataFrame([], "a int"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_blobs_of_a_job(spark, tmp_path):
    path = files.job_path(str(tmp_path), "job1", "output", "a.txt", attempt=2)
    assert path == f"{tmp_path}/output/job1/attempt-2/a.txt" and not files.blob_exists(spark, path)
    files.write_blob(spark, path, b"one")
    files.write_blob(spark, path, b"\x00\xfftwo")
    assert files.blob_exists(spark, path) and files.read_blob(spark, path) == b"\x00\xfftwo"
    assert [r.length for r in files.job_blobs(spark, str(tmp_path), "job1", "output").collect()] == [5]
    assert files.delete_blobs(spark, path) and files.read_blob(spark, path) is None
    for bad in (("..", "input", ""), ("", "input", ""), ("a", "other", ""), ("a", "input", "b/c")):
        with pytest.raises(ValueError):
            files.job_path("root", *bad)


def test_append_with_defaults(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, cost double")
    files.append(rows, path, "at", {"cost": 0.0, "unit": "x"}, ("k", "cost"))
    got = sorted((r.k, r.cost, r.unit, r["at"] is not None) for r in spark.read.parquet(path).collect())
    assert got == [("a", 0.0, "x", True), ("b", 2.0, "x", True)]
    with pytest.raises(ValueError, match="cost"):
        files.append(rows, path, required=("cost",))
    files.append(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 2


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "iso-8859-1"])
def test_glossary_encodings(spark, tmp_path, encoding):
    (tmp_path / "g.csv").write_bytes("source,target,tgt_lng\nschön,beau,fr\n".encode(encoding))
    assert [tuple(r) for r in files.csv_glossary(spark, str(tmp_path / "g.csv")).collect()] == [("schön", "beau", "fr")]


def test_page_texts_and_faults(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"bad")

    def pages(content):
        if content == b"bad":
            raise ValueError("no document")
        return content.decode().split("\f")

    got = sorted((r.path[-5:], r.page, r.text) for r in files.page_texts(spark, str(tmp_path), pages).collect())
    assert got == [("a.txt", 0, "one"), ("a.txt", 1, "two"), ("b.txt", -1, "ValueError: no document")]
    broken = spark.createDataFrame([("x.docx", bytearray(b"PK no archive"))], "path string, content binary")
    assert [(r.label, r.unit_id) for r in files.docx_units(broken).collect()] == [("error", 0)]


def test_text_layers(spark):
    rows = [(b"some text",), (b"  \n ",), (b"%PDF-1.4 stream BT /F1 12 Tf (Hello) Tj ET",), (b"%PDF-1.4 stream q 10 0 0 10 0 0 cm /Im1 Do Q",), (b"\xff\x00",)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c,) in enumerate(rows)], "i int, c binary")
    assert [r.t for r in df.select("i", files.has_text_layer(F.col("c")).alias("t")).orderBy("i").collect()] == [True, False, True, False, None]
