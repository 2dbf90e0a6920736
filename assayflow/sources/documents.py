"""Nested documents: BioSample and run XML, assembly JSON, spreadsheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANTIBIOGRAM = "accession string, submission_date string, last_update string, table_index int, row_index int, header array<string>, cells array<string>, record_sha256 string"


def antibiogram_rows(df: DataFrame, xml: str) -> DataFrame:
    """Rows of the antibiogram tables of BioSample XML texts (one element or a set of them), with a stable row id.

    Columns: those of ANTIBIOGRAM, row_id (accession and 20 hex digits of the hash of its place and cells), fields (header to
    cell). Texts that are no XML give no rows (see unreadable()), samples without a table none either; a ragged row is padded with nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        names = [c.split()[0] for c in ANTIBIOGRAM.split(", ")]
        for b in batches:
            out = []
            for text in b["x"]:
                try:
                    root = ElementTree.fromstring(text)
                except (ElementTree.ParseError, TypeError):
                    continue
                for sample in [root] if root.tag == "BioSample" else root.iter("BioSample"):
                    sha = hashlib.sha256(ElementTree.tostring(sample)).hexdigest()
                    for t, table in enumerate(sample.iter("Table"), 1):
                        head = ["".join(c.itertext()).strip() for c in table.iterfind("./Header/Cell")]
                        for r, row in enumerate(table.iterfind("./Body/Row"), 1):
                            cells = ["".join(c.itertext()).strip() or None for c in row.iterfind("./Cell")]
                            out.append((sample.get("accession"), sample.get("submission_date"), sample.get("last_update"), t, r, head, (cells + [None] * len(head))[: max(len(head), len(cells))], sha))
            yield pd.DataFrame(out, columns=names)

    rows = df.select(F.col(xml).alias("x")).where("x is not null").mapInPandas(run, ANTIBIOGRAM)
    digest = F.sha2(F.to_json(F.struct("table_index", "row_index", "cells")), 256)
    fields = F.map_from_arrays(F.transform("header", lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", "_"))), F.slice("cells", 1, F.size("header")))
    return rows.withColumn("row_id", F.concat_ws("-", "accession", F.substring(digest, 1, 20))).withColumn("fields", F.when(F.size(F.array_distinct("header")) == F.size("header"), fields))


def unreadable(df: DataFrame, xml: str) -> DataFrame:
    """(record_sha256, reason) of the texts that antibiogram_rows and run_rows can't read, null ones too; refuse them with contracts.refuse
    where a source must be whole. Every text is either read or listed here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["x"]:
                try:
                    ElementTree.fromstring(text)
                except TypeError:
                    out.append("no text")
                except ElementTree.ParseError as e:
                    out.append(f"no XML: {e}")
                else:
                    out.append(None)
            yield pd.DataFrame({"record_sha256": b["h"], "reason": out})

    texts = df.select(F.col(xml).alias("x"), F.sha2(F.col(xml), 256).alias("h"))
    return texts.mapInPandas(run, "record_sha256 string, reason string").where("reason is not null")


def run_rows(df: DataFrame, xml: str) -> DataFrame:
    """(run, experiment, sample, attributes) of SRA experiment package XML texts."""
    schema = "run string, experiment string, sample string, attributes map<string,string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["x"]:
                try:
                    root = ElementTree.fromstring(text)
                except (ElementTree.ParseError, TypeError):
                    continue
                for pack in [root] if root.tag == "EXPERIMENT_PACKAGE" else root.iter("EXPERIMENT_PACKAGE"):
                    sample = pack.find("SAMPLE")
                    tags = {} if sample is None else {a.findtext("TAG"): a.findtext("VALUE") for a in sample.iter("SAMPLE_ATTRIBUTE") if a.findtext("TAG")}
                    exp = pack.find("EXPERIMENT")
                    for r in pack.iter("RUN"):
                        out.append((r.get("accession"), None if exp is None else exp.get("accession"), None if sample is None else sample.get("accession"), tags))
            yield pd.DataFrame(out, columns=["run", "experiment", "sample", "attributes"])

    return df.select(F.col(xml).alias("x")).where("x is not null").mapInPandas(run, schema)


def exactly_one(values: Column) -> Column:
    """The only different non-blank text of an array, else null."""
    v = F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(v) == 1, F.get(v, F.lit(0)))


def one_of_list(text: Column) -> Column:
    """The only different entry of a text of entries joined by semicolons or commas, else null."""
    return exactly_one(F.split(text, "[;,]"))


def accessions(text: Column) -> Column:
    """All assembly accessions in a text, JSON lines for instance, sorted and different."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(GC[AF]_\d{9}\.\d+)"), 1)))


def assembly_reports(spark: SparkSession, path: str) -> DataFrame:
    """(accession, organism, biosample) of JSON reports, either one object with a list of reports or a report in each line."""
    text = spark.read.text(path, wholetext=True)
    report = "accession string, organism struct<organism_name:string>, assembly_info struct<biosample:struct<accession:string>>"
    whole = F.from_json("value", f"reports array<struct<{_fields(report)}>>")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.from_json(x, report)), lambda r: r.accession.isNotNull())
    r = F.explode(F.coalesce(whole.reports, lines))
    return text.select(r.alias("r")).where("r.accession is not null").select("r.accession", F.col("r.organism.organism_name").alias("organism"), F.col("r.assembly_info.biosample.accession").alias("biosample"))


def _fields(ddl: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column) of a reference such as B7, from 1."""
    letters, digits = re.match(r"([A-Z]+)(\d+)$", ref).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def workbook_cells(content: bytes) -> list[tuple[str, int, int, str, bool]]:
    """(sheet, row, column, text, merged) of the filled cells of a workbook: shared, inline and rich strings, numbers, booleans."""
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{NS}si")]
    rel = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{NS}sheet"):
        target = rel[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        merged = [tuple(cell_place(x) for x in m.get("ref").split(":")) for m in root.iter(f"{NS}mergeCell")]
        for c in root.iter(f"{NS}c"):
            v = c.find(f"{NS}v")
            kind = c.get("t")
            text = "".join(t.text or "" for t in c.iter(f"{NS}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text) if kind == "b" else v.text
            if text not in (None, ""):
                r, k = cell_place(c.get("r"))
                out.append((sheet.get("name"), r, k, text, any(a[0] <= r <= b[0] and a[1] <= k <= b[1] for a, b in merged)))
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, text, merged) of all workbooks that a path matches."""
    schema = "file string, sheet string, row int, column int, text string, merged boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *c) for f, x in zip(b["path"], b["content"], strict=True) for c in workbook_cells(x)], columns=["file", "sheet", "row", "column", "text", "merged"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def sheet_rows(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """(file, sheet, row, fields): rows as maps from the header's texts; cells beyond the header are left out, missing ones absent."""
    keys = ["file", "sheet"]
    head = cells.where(F.col("row") == header_row).select(*keys, "column", F.col("text").alias("name"))
    body = cells.where(F.col("row") > header_row).join(head, [*keys, "column"])
    return body.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("fields"))


def unexpected_cells(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected cells (sheet, row, column, text) that a workbook lacks or fills otherwise."""
    c = cells.select("sheet", "row", "column", F.col("text").alias("found"))
    return expected.join(c, ["sheet", "row", "column"], "left").where("found is null or found <> text")
