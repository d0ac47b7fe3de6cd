"""Files around the tables: downloads, archives, spreadsheets, documents, reports."""

from __future__ import annotations

import html
import io
import re
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a download that are held at once.
CHUNK = 8 << 20


def download(url: str, to: str) -> int:
    """Fetches a file in chunks to a path; its bytes. A step before the engine: it runs where it is called."""
    with urllib.request.urlopen(url) as source, open(to, "wb") as sink:
        shutil.copyfileobj(source, sink, CHUNK)
        return sink.tell()


def read_zip(spark: SparkSession, pattern: str, member: str) -> DataFrame:
    """Members of zip archives whose names match a pattern: ``archive, member, content``. An archive is one task's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        if re.fullmatch(member, name):
                            yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "archive string, member string, content binary")


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(reference: str) -> int:
    at = 0
    for c in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Name and cells, as strings, of each sheet of an XLSX file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        files = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = files[sheet.get(_LINK)].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                cells: dict[int, str | None] = {}
                for k, cell in enumerate(row.iter(f"{_MAIN}c")):
                    value = cell.find(f"{_MAIN}v")
                    text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if cell.get("t") == "inlineStr" else None if value is None else value.text
                    cells[_column(cell.get("r")) if cell.get("r") else k] = shared[int(text)] if cell.get("t") == "s" and text else text
                rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
            yield sheet.get("name"), rows


def read_xlsx(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows below each sheet's first: ``path, source, row, cells``, a map from the first row's names to strings. A file is one task's work."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                for name, rows in sheets(raw):
                    head = rows[0] if rows else []
                    out = [(path, name, k, {h: v for h, v in zip(head, r, strict=False) if h is not None}) for k, r in enumerate(rows[1:], 1)]
                    yield pd.DataFrame(out, columns=["path", "source", "row", "cells"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, source string, row int, cells map<string, string>")


def write_xlsx(path: str, tables: dict[str, DataFrame], most: int = 1_048_575) -> None:
    """One sheet for each table, with its columns' names first. A sheet has no room for more than ``most`` rows; larger tables are refused.

    A report's sink: rows reach the driver, so tables are those of a cohort.
    """
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(tables) + 1)) + "</Types>")
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(name[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, name in enumerate(tables, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(tables) + 1)) + "</Relationships>")
        for k, df in enumerate(tables.values(), 1):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"a sheet holds {most} rows at most")
            cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def read_documents(spark: SparkSession, pattern: str, extract: Callable[[bytes], str | None]) -> DataFrame:
    """``path, text`` of binary documents, such as PDF files, by the text extractor given; files that it fails on have no text."""

    def read(raw: bytes) -> str | None:
        try:
            return extract(raw)
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "text": [read(raw) for raw in frame["content"]]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, text string")


def recent_repositories(repositories: DataFrame, k: int = 10, readme: int = 1500) -> DataFrame:
    """``user, repos``: each user's ``k`` repositories updated last, without the forks among them.

    ``repositories(user, name, description, languages, stars, forks, fork, updated, readme)``, as fetched; the newest come first, ties by name.
    """
    item = F.struct(F.col("updated").alias("at"), "name", "description", "languages", "stars", "forks", F.coalesce("fork", F.lit(False)).alias("fork"), F.substring("readme", 1, readme).alias("readme"))
    newest = F.slice(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["at"] > b["at"], -1).when(a["at"] < b["at"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)), 1, k)
    own = F.filter("repos", lambda r: ~r["fork"])
    return repositories.groupBy("user").agg(newest.alias("repos")).select("user", F.transform(own, lambda r: r.dropFields("fork", "at")).alias("repos"))


def write_reports(df: DataFrame, path: str, name: Column, title: Column, fields: list[str]) -> None:
    """One HTML page a row, each in a folder named by ``name``: its fields in a table. Pages are made where their rows are."""

    def page(t: str, values: list) -> str:
        rows = "".join(f"<tr><th>{html.escape(f)}</th><td>{html.escape('' if v is None else str(v))}</td></tr>" for f, v in zip(fields, values, strict=True))
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(t)}</title></head><body><h1>{html.escape(t)}</h1><table>{rows}</table></body></html>'

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"name": frame.iloc[:, 0], "value": [page(t, v) for _, t, *v in frame.values.tolist()]})

    rows = df.select(name.cast("string").alias("_name"), F.coalesce(title.cast("string"), F.lit("")).alias("_title"), *[F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields)])
    rows.mapInPandas(run, "name string, value string").write.mode("overwrite").partitionBy("name").text(path)
