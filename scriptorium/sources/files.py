"""Sources and sinks: texts, CSV and JSON glossaries, catalogs, JSON lines, blobs, containers, documents.

All readers go through Spark's data sources, so any path that these open will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CATALOG_SCHEMA = "provider string, model_id string, region string, context_window_tokens long, tiers array<struct<max_input_tokens:bigint,input_cost_per_1k:double,output_cost_per_1k:double,cache_hit_cost_per_1k:double>>"
ROUTING_SCHEMA = "source_language string, target_language string, domain string, model_chain array<struct<model_id:string,priority:int,region:string>>"
LOG_SCHEMA = "time string, logger string, message string"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of text files: invalid UTF-8 replaced, any line end; an empty file has one empty line."""
    files = blobs(spark, path)
    text = F.decode("content", "UTF-8")
    return files.select("path", F.posexplode(F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")).alias("line", "text"))


def blobs(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of files, those of a name pattern only if given."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def blob_stat(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and content hashes; contents aren't kept."""
    return blobs(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def sha3(content: Column) -> Column:
    """SHA3-256 in hex; Spark has no such function, so Arrow batches go to Python."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        import hashlib

        return values.map(lambda v: None if v is None else hashlib.sha3_256(v).hexdigest())

    return digest(content)


def integrity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, state) of expected files (name, sha3): ok, missing or changed."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), sha3(F.col("content")).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha3"), "ok").otherwise("changed")
    return expected.join(have, "name", "left").select("name", state.alias("state"))


def container(content: Column) -> Column:
    """pdf, docx, zip or txt by the first bytes; text only if it is valid UTF-8; else null."""
    head = F.hex(F.substring(content, 1, 5))
    entry = F.decode(content, "ISO-8859-1").contains("word/document.xml")
    return F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304") & entry, "docx").when(head.startswith("504B0304"), "zip").when(F.is_valid_utf8(content), "txt")


def csv_glossary(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """(source, target, tgt_lng) of a glossary with a header; of a language only rows for it or for any.

    Case and ``-`` or ``_`` don't tell languages apart; rows without source or target go.
    """
    encoding = blobs(spark, path).select(encoding_of(F.col("content")).alias("e")).agg(F.max("e")).first()[0] or "UTF-8"  # one for all files of a glossary
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("encoding", encoding).csv(path)
    rows = rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])
    if not {"source", "target"} <= set(rows.columns):
        raise ValueError("a glossary needs the columns source and target")
    rows = rows.withColumn("tgt_lng", rows["tgt_lng"] if "tgt_lng" in rows.columns else F.lit(None).cast("string"))
    rows = rows.filter((F.trim("source") != "") & (F.trim("target") != ""))
    if language is not None:
        own = F.lower(F.regexp_replace("tgt_lng", "_", "-"))
        rows = rows.filter(F.col("tgt_lng").isNull() | (F.trim("tgt_lng") == "") | (own == language.lower().replace("_", "-")))
    return rows.select("source", "target", "tgt_lng")


def write_csv_glossary(rows: DataFrame, path: str) -> None:
    rows.select("source", "target", "tgt_lng").write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def pricing_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries in file order; a malformed file fails."""
    rows = spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.withColumn("pos", F.monotonically_increasing_id())


def model_routing(spark: SparkSession, path: str) -> DataFrame:
    """(pos, source_language, target_language, domain, model_id, priority, region) in file order."""
    rows = spark.read.schema(ROUTING_SCHEMA).option("multiLine", "true").json(path).withColumn("pos", F.monotonically_increasing_id())
    return rows.select("pos", "source_language", "target_language", "domain", F.explode("model_chain").alias("m")).select("pos", "source_language", "target_language", "domain", "m.*")


def glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, pos, source_term, lang, term) of nested glossary JSON."""
    schema = "glossary map<string,struct<terms:array<struct<source_term:string,translations:map<string,string>>>>>"
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = rows.select(F.explode("glossary").alias("bucket", "g")).select("bucket", F.posexplode("g.terms").alias("pos", "t"))
    return each.select("bucket", "pos", "t.source_term", F.explode("t.translations").alias("lang", "term"))


def tracking_pairs(json_text: Column) -> Column:
    """array<struct<bucket, source, target>> of tracking JSON: input, else the raw text; blank sources go, missing targets are empty."""
    para = "array<struct<paragraph:array<struct<input:string,pdf_unicode:string,output:string>>>>"
    parsed = F.from_json(json_text, f"page {para}, cross_page {para}, cross_column {para}")
    out = []
    for bucket in ("page", "cross_page", "cross_column"):
        flat = F.flatten(F.transform(F.coalesce(parsed[bucket], F.array().cast(para)), lambda p: F.coalesce(p["paragraph"], F.array().cast("array<struct<input:string,pdf_unicode:string,output:string>>"))))
        source = lambda x: F.coalesce(F.nullif(F.trim(x["input"]), F.lit("")), F.nullif(F.trim(x["pdf_unicode"]), F.lit("")))
        named = F.lit(bucket).alias("bucket")
        out.append(F.transform(F.filter(flat, lambda x: source(x).isNotNull()), lambda x: F.struct(named, source(x).alias("source"), F.coalesce(x["output"], F.lit("")).alias("target"))))  # noqa: B023
    return F.concat(*out)


def json_log(spark: SparkSession, path: str) -> DataFrame:
    """(time, logger, message) of JSON lines; anything else, and rows without a time, go."""
    lines = spark.read.text(path).filter(F.ltrim("value").startswith("{"))
    rows = lines.select(F.from_json("value", LOG_SCHEMA).alias("r")).select("r.*")
    return rows.withColumn("time", F.try_to_timestamp("time")).filter("time is not null")


def docx_units(files: DataFrame) -> DataFrame:
    """(path, unit_id, label, text) of DOCX files in reading order: headers, body, footers, footnotes, endnotes; blank paragraphs go.

    A file that is no such archive gives one row, with the label ``error`` and the fault as text.
    """
    parts = (("header", r"word/header\d*\.xml"), ("body", r"word/document\.xml"), ("footer", r"word/footer\d*\.xml"), ("footnote", r"word/footnotes\.xml"), ("endnote", r"word/endnotes\.xml"))

    def units(content: bytes) -> Iterator[tuple[str, str]]:
        import xml.etree.ElementTree as ET

        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for label, pattern in parts:
                for name in sorted(n for n in z.namelist() if re.fullmatch(pattern, n)):
                    for p in ET.fromstring(z.read(name)).iter(f"{w}p"):
                        links = list(p.iter(f"{w}hyperlink"))
                        linked = {t for link in links for t in link.iter(f"{w}t")}
                        own = "".join(t.text or "" for t in p.iter(f"{w}t") if t not in linked)
                        for text in (own, *("".join(t.text or "" for t in link.iter(f"{w}t")) for link in links)):
                            if text.strip():
                                yield label, text

    def run(batches):
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    out += [(path, i, label, text) for i, (label, text) in enumerate(list(units(content)))]
                except (zipfile.BadZipFile, SyntaxError, KeyError) as fault:
                    out.append((path, 0, "error", f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(out, columns=["path", "unit_id", "label", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, unit_id int, label string, text string")


def page_texts(spark: SparkSession, path: str, pages: Callable[[bytes], Iterable[str]] | None = None) -> DataFrame:
    """(path, page, text) of documents in any store that Spark opens; ``pages`` parses one document's bytes, by default form-fed text.

    A document that can't be parsed gives one row, with page -1 and the fault as text.
    """
    parse = pages or (lambda content: content.decode("utf-8", "replace").split("\f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for name, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    out += [(name, i, text) for i, text in enumerate(parse(content))]
                except Exception as fault:  # any parser's fault is the document's, not the job's
                    out.append((name, -1, f"{type(fault).__name__}: {fault}"))
            yield pd.DataFrame(out, columns=["path", "page", "text"])

    return blobs(spark, path).select("path", "content").mapInPandas(run, "path string, page int, text string")


class PageTextSource(DataSource):
    """``spark.read.format("page_text")``: pages of form-fed text files, one partition a file.

    The option ``paths`` lists files, comma-joined, on a disk that all workers
    share; for other stores, and other parsers, there is ``page_texts``.
    """

    @classmethod
    def name(cls) -> str:
        return "page_text"

    def schema(self) -> str:
        return "path string, page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PageTextReader(self.options)


class _PageTextReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            for page, text in enumerate(f.read().split("\f")):
                yield partition.value, page, text


def append(rows: DataFrame, path: str, stamp: str | None = None, defaults: dict[str, object] | None = None, required: tuple[str, ...] = ()) -> None:
    """Rows appended to a parquet log; nothing is written for none. Readers take the latest of each key.

    Nulls take the column's default, and the present time in ``stamp``. Rows
    that then lack a required value fail the call, with how many there are, and
    nothing is written.
    """
    for column, value in (defaults or {}).items():
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in rows.columns else F.lit(value))
    if stamp:
        rows = rows.withColumn(stamp, F.coalesce(F.col(stamp), F.current_timestamp()) if stamp in rows.columns else F.current_timestamp())
    lacking = {c: n for c, n in zip(required, rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)) for c in required]).first(), strict=True) if n} if required else {}
    if lacking:
        raise ValueError(f"rows without a value: {lacking}")
    if rows.limit(1).count():
        rows.write.mode("append").parquet(path)


def _file(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark itself opens it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def blob_exists(spark: SparkSession, path: str) -> bool:
    system, at = _file(spark, path)
    return system.exists(at)


def write_blob(spark: SparkSession, path: str, content: bytes) -> None:
    """One small object; an earlier one of that name is replaced."""
    system, at = _file(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def read_blob(spark: SparkSession, path: str) -> bytes | None:
    """One object's content, None if there's none."""
    if not blob_exists(spark, path):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def delete_blobs(spark: SparkSession, path: str) -> bool:
    """An object, or all below a folder; whether there was one."""
    system, at = _file(spark, path)
    return system.delete(at, True)


def job_path(root: str, job_id: str, kind: str, name: str = "", attempt: int | None = None) -> str:
    """Where a job's objects lie: root/kind/job[/attempt-n][/name], kind one of input, output, glossary and artifacts."""
    if kind not in ("input", "output", "glossary", "artifacts"):
        raise ValueError(f"no such kind of object: {kind}")
    for part in (job_id, name):
        if part in (".", "..") or re.search(r"[/\\\x00-\x1f]", part):
            raise ValueError(f"not a plain name: {part!r}")
    if not job_id:
        raise ValueError("a job has an id")
    return "/".join([root.rstrip("/"), kind, job_id, *([f"attempt-{attempt}"] if attempt is not None else []), *([name] if name else [])])


def job_blobs(spark: SparkSession, root: str, job_id: str, kind: str) -> DataFrame:
    """Names, sizes and content hashes of a job's objects of a kind."""
    return blob_stat(spark, job_path(root, job_id, kind))


def encoding_of(content: Column) -> Column:
    """The encoding of a text file by its first bytes, else UTF-8 if it is valid, else ISO-8859-1."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head.startswith("EFBBBF"), "UTF-8").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(F.is_valid_utf8(content), "UTF-8").otherwise("ISO-8859-1")


def has_text_layer(content: Column) -> Column:
    """A document has text of its own: a text file with a letter or digit, or a PDF with an operator that shows text in an uncompressed stream; null for others."""
    plain = F.decode(content, "ISO-8859-1")
    kind = container(content)
    return F.when(kind == "txt", F.decode(content, "UTF-8").rlike(r"[\p{L}\p{N}]")).when(kind == "pdf", plain.rlike(r"(?s)\bBT\b.*?\((?:[^)\\]|\\.)+\)\s*T[jJ]|\bBT\b.*?\[.*?\]\s*TJ"))
