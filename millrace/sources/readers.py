"""Readers: files by type, HTML pages to blocks, strict JSON lines, and safety checks of containers."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labels of HTML elements that make blocks; fixed values.
LABELS = {"h1": "title", "h2": "section_header", "h3": "section_header", "h4": "section_header", "h5": "section_header", "h6": "section_header", "p": "text", "li": "list_item", "table": "table", "pre": "code", "footer": "page_footer", "header": "page_header", "nav": "page_header"}
#: Characters of pages whose blocks are given out together.
TOGETHER = 1 << 20
_PART = re.compile(r"<!--.*?-->|<(script|style|head)\b.*?</\1\s*>|<(/?)([a-zA-Z][\w-]*)[^>]*>", re.S | re.I)
BLOCK = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("block_index", "integer"), ("label", "string"), ("level", "integer"), ("text", "string"))]})


def html_blocks(source: str) -> list[tuple[str, int | None, str]]:
    """(label, heading level, text) of a page's blocks, in order."""
    out, label, level, buffer, at = [], "text", None, [], 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            out.append((label, level, text))
        buffer.clear()

    for m in _PART.finditer(source):
        buffer.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in LABELS:
            flush()
            label, level = ("text", None) if m[2] else (LABELS[name], int(name[1]) if name[0] == "h" and name[1:].isdigit() else None)
        elif name in ("div", "article", "section", "ul", "ol", "tr", "body"):
            flush()
    buffer.append(re.sub(r"<[^>]*$", "", source[at:]))
    flush()
    return out


def block_frames(pages: Iterator[pd.DataFrame], key: str, column: str) -> Iterator[pd.DataFrame]:
    """The blocks of pages, given out whenever pages of TOGETHER characters are read, however many a frame has."""
    for b in pages:
        rows, size = [], 0
        for n, (k, s) in enumerate(zip(b[key], b[column], strict=True), 1):
            rows += [(k, i, *x) for i, x in enumerate(html_blocks(s or ""))]
            size += len(s or "")
            if size >= TOGETHER or n == len(b):
                yield pd.DataFrame(rows, columns=[key, "block_index", "label", "level", "text"]).astype({"level": "Int32"})
                rows, size = [], 0


def parsed_pages(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, block_index, label, level, text) of all pages."""
    return pages.select(key, column).mapInPandas(lambda b: block_frames(b, key, column), f"{key} {dict(pages.dtypes)[key]}, block_index int, label string, level int, text string")


def text_blocks(text: Column) -> Column:
    """Blocks of a plain text: runs between empty lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda x: x != "")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, hash) of all files below a path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "content", F.sha2("content", 256).alias("hash"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows of a JSON-lines data set by a fixed schema; a malformed line or a repeated key is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("allowNonNumericNumbers", "false").json(path)
    from pyspark.sql import Window as W

    n = F.count(F.lit(1)).over(W.partitionBy(key))
    return df.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.lit(f"{key} is repeated"))))


#: Limits of an office container: entries, bytes of a part and of all, ratio of sizes; required parts.
ENTRIES, BYTES, RATIO, NEEDED = 4096, 100 << 20, 1000, ("[Content_Types].xml", "xl/workbook.xml")
#: Kinds of parts that a container may have, and what images begin with; fixed values.
MARKUP = (".xml", ".rels", ".vml", ".svg")
IMAGES = {
    ".png": (b"\x89PNG\r\n\x1a\n",), ".jpg": (b"\xff\xd8\xff",), ".jpeg": (b"\xff\xd8\xff",), ".gif": (b"GIF87a", b"GIF89a"), ".bmp": (b"BM",),
    ".tif": (b"II*\x00", b"MM\x00*"), ".tiff": (b"II*\x00", b"MM\x00*"), ".emf": (b"\x01\x00\x00\x00",), ".wmf": (b"\xd7\xcd\xc6\x9a", b"\x01\x00\t\x00", b"\x02\x00\t\x00"),
}
#: What archives begin with, which an image may not hold anywhere; fixed values.
ARCHIVES = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b"Rar!\x1a\x07", b"7z\xbc\xaf\x27\x1c", b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"MSCF", b"!<arch>\n", b"\x28\xb5\x2f\xfd", b"\x04\x22\x4d\x18", b"ustar")
_ARCHIVE = re.compile(b"|".join(map(re.escape, ARCHIVES)))


class _Declared(Exception):
    pass


def _part_problem(name: str, content: bytes) -> str | None:
    """Why one part isn't safe: markup must be well-formed and declare nothing, an image must be one and hold no archive."""
    if name.lower().endswith(MARKUP):
        parser = expat.ParserCreate()

        def declared(*_) -> None:
            raise _Declared

        parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = declared
        try:
            parser.Parse(content, True)
        except _Declared:
            return "declares entities"
        except expat.ExpatError:
            return "broken markup"
        return None
    signs = IMAGES.get(posixpath.splitext(name.lower())[1])
    if signs is None:
        return "another kind of part"
    if _ARCHIVE.search(content):
        return "nested container"
    return None if content.startswith(signs) else "not the image it says"


def container_problem(content: bytes) -> str | None:
    """Why a spreadsheet container isn't safe to open, or None. Parts are read only once the sizes that the directory
    states are within bounds."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        infos = z.infolist()
    except (zipfile.BadZipFile, ValueError, OSError):
        return "not a container"
    names = [i.filename for i in infos]
    if len(infos) > ENTRIES:
        return "too many entries"
    parts = [n.rstrip("/").split("/") for n in names]
    if len(set(map(str.lower, names))) != len(names) or any("\\" in n for n in names) or any(x in ("", ".", "..") or ":" in x for p in parts for x in p):
        return "unsafe names"
    if any(n not in names for n in NEEDED):
        return "a part is missing"
    if any(i.flag_bits & 1 for i in infos):
        return "encrypted"
    whole = sum(i.file_size for i in infos)
    if whole > BYTES or whole > RATIO * sum(max(1, i.compress_size) for i in infos) or any(i.file_size > BYTES for i in infos):
        return "too large"
    try:
        return next((p for i in infos if not i.is_dir() and (p := _part_problem(i.filename, z.read(i)))), None)
    except (zipfile.BadZipFile, EOFError, NotImplementedError, OSError, RuntimeError, ValueError):
        return "not a container"


@F.pandas_udf(T.StringType())
def container_check(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else container_problem(bytes(x)))


def schema_diff(wanted: T.StructType, found: T.StructType) -> dict[str, list[str]]:
    """Fields that are missing, unexpected, or of another type."""
    a, b = {f.name: f.dataType for f in wanted}, {f.name: f.dataType for f in found}
    return {"missing": sorted(a.keys() - b.keys()), "unexpected": sorted(b.keys() - a.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}
