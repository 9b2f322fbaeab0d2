"""Files to fragments: batches of pages with the file's own references, after a check of size and hash."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.readers import container_problem, html_blocks

#: Pages of a batch, and pages and bytes of a file at most.
BATCH, PAGES, BYTES = 20, 2_000, 50 << 20
#: Bytes of files whose batches are given out together.
TOGETHER = 1 << 20
BLANK = " \t\r\n\x0b\x0c"
#: What a batch holds; `problem` says why a file has none.
BLOCK = "struct<ref:string,page_no:int,label:string,level:int,text:string>"
FRAGMENT = f"batch_no int, page_from int, page_to int, blocks array<{BLOCK}>, problem string"

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"

Block = tuple[str, int | None, str]


def text_pages(content: bytes) -> Iterator[list[Block]]:
    """Pages of a plain text, between form feeds; its blocks lie between empty lines."""
    for page in content.decode("utf-8").split("\x0c"):
        yield [("text", None, b) for part in re.split(r"\n[ \t]*\n", page) if (b := part.strip(BLANK))]


def html_pages(content: bytes) -> Iterator[list[Block]]:
    yield html_blocks(content.decode("utf-8", "replace"))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return max(n, 1) - 1


def _cell(c: ET.Element, shared: list[str]) -> str:
    if c.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
    value = c.findtext(f"{_SHEET}v") or ""
    if c.get("t") == "s":
        return shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
    return {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.get("t") == "b" else value


def sheet_pages(content: bytes) -> Iterator[list[Block]]:
    """Sheets of a spreadsheet as pages: the name as a heading, the cells as one table of tabs and lines."""
    if problem := container_problem(content):
        raise ValueError(problem)
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in names:
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
    for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        part = posixpath.normpath(posixpath.join("xl", targets.get(sheet.get(_RELATION)) or "")).lstrip("/")
        rows = []
        for row in ET.fromstring(z.read(part)).iter(f"{_SHEET}row") if part in names else ():
            cells: list[str] = []
            for i, c in enumerate(row.iter(f"{_SHEET}c")):
                at = _column(c.get("r") or "") if c.get("r") else i
                cells += [""] * (at - len(cells)) + [_cell(c, shared)]
            rows.append("\t".join(x.replace("\t", " ").replace("\n", " ") for x in cells))
        table = "\n".join(rows).strip("\n")
        yield [("section_header", 1, sheet.get("name") or ""), *([("table", None, table)] if table.strip(BLANK) else [])]


def reader_of(content: bytes) -> Callable[[bytes], Iterator[list[Block]]]:
    """By what the content begins with; anything else must be UTF-8."""
    if content[:4] == b"PK\x03\x04":
        return sheet_pages
    if content[:5] == b"%PDF-" or content[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("no parser for this type")
    return html_pages if re.match(rb"\s*<(!doctype\s+html|html)\b", content[:200], re.I) else text_pages


def fragments(content: bytes, batch: int = BATCH) -> Iterator[tuple[int, int, int, list[tuple]]]:
    """(batch number, first and last page, blocks) of a file, a batch at a time. References count over the whole file by
    collection, so batches together hold what one batch of all pages would."""
    count = {"texts": 0, "tables": 0}
    held: list[tuple] = []
    first = page = 0
    for page, blocks in enumerate(reader_of(content)(content), 1):
        if page > PAGES:
            raise ValueError("too many pages")
        first = first or page
        for label, level, text in blocks:
            where = "tables" if label == "table" else "texts"
            held.append((f"#/{where}/{count[where]}", page, label, level, text))
            count[where] += 1
        if page - first + 1 == batch:
            yield (page - 1) // batch + 1, first, page, held
            held, first = [], 0
    if first:
        yield (page - 1) // batch + 1, first, page, held


def _whole(content: bytes | None, size: int, digest: str, batch: int) -> list[tuple]:
    """The batches of one file, or its problem."""
    if content is None or len(content) != size or hashlib.sha256(content).hexdigest() != digest:
        return [(None, None, None, None, "failed the integrity check")]
    if len(content) > BYTES:
        return [(None, None, None, None, "too large")]
    try:
        return [(*x, None) for x in fragments(bytes(content), batch)]  # a failure behind the first batch takes all back
    except UnicodeDecodeError:
        return [(None, None, None, None, "not UTF-8")]
    except (ValueError, KeyError, ET.ParseError, zipfile.BadZipFile) as e:
        return [(None, None, None, None, str(e))]


def frames(files: Iterator[pd.DataFrame], keys: list[str], batch: int) -> Iterator[pd.DataFrame]:
    """Frames of files(keys, content, size, sha256) to frames of their batches: one for a large file, or for small ones of
    TOGETHER bytes, as a frame of its own for each would cost more than they."""
    names = [*keys, "batch_no", "page_from", "page_to", "blocks", "problem"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("batch_no", "page_from", "page_to")})

    for b in files:
        held, size = [], 0
        for row in b.itertuples(index=False):
            held += [(*row[: len(keys)], *x) for x in _whole(*row[len(keys) :], batch)]
            size += len(row[len(keys)] or b"")
            if size >= TOGETHER:
                yield frame(held)
                held, size = [], 0
        if held:
            yield frame(held)


def parsed(files: DataFrame, keys: list[str], batch: int = BATCH) -> DataFrame:
    """files(keys, content, size, sha256) to (keys, batch_no, page_from, page_to, blocks, problem), a row a batch.

    A file whose content isn't of the size and hash given, is too large, has too many pages, or can't be parsed is one row
    with its problem and no blocks; a null content is such a file. A task holds one file and its batches, or small files
    of TOGETHER bytes."""
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), FRAGMENT])
    return files.select(*keys, "content", "size", "sha256").mapInPandas(lambda b: frames(b, keys, batch), schema)


def parsed_folder(spark: SparkSession, path: str, manifest: DataFrame, batch: int = BATCH) -> DataFrame:
    """Batches of the files below a path that a manifest (name, size, sha256) lists by base name; files that aren't there
    are problems too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    files = manifest.join(found, "name", "left")
    # Spark's reader leaves empty files out
    return parsed(files.withColumn("content", F.when((F.col("size") == 0) & F.col("content").isNull(), F.lit(b"")).otherwise(F.col("content"))), ["name"], batch)
