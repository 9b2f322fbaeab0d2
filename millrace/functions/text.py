"""Text functions as column expressions, and the few that need Python."""

from __future__ import annotations

import ast
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pattern of a number literal, the phrases that instruct a reader of retrieved text, and
# the grammar of company and population mentions with the names that are none.
NUMBER = r"(?<![0-9A-Za-z_.])-?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?![0-9A-Za-z_])"
INSTRUCTIONS = (
    r"\bignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|messages?)\b",
    r"\b(?:reveal|print|show|repeat)\s+(?:the\s+)?system\s+prompt\b",
    r"\b(?:system\s+prompt|developer\s+message)\b",
    r"\b(?:call|invoke|use)\s+(?:the\s+)?(?:tool|function)\b",
    r"\byou\s+are\s+(?:chatgpt|an?\s+assistant)\b",
)
COMPANY = r"(?:(?<=^)|(?<=[，。；、\s与和]))(?:查询|比较|请问|关于)?(?P<company>[\u4e00-\u9fffA-Za-z0-9]{2,20}?公司)"
NO_COMPANY = ("我们公司", "我的公司", "本公司", "其他公司", "哪个公司")
OPEN_COMPANY = r"[两多各几]家公司$"
POPULATION = r"普通员工|管理人员|外包人员"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_ascii(text: Column) -> Column:
    """Lower-cased, white space collapsed: the hash form of ASCII text."""
    return F.lower(collapsed(text))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, case folded: the hash form of any text."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def anchor_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def numbers(text: Column) -> Column:
    """Literal numbers of a text as decimals, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("decimal(38,10)")))


# A citation tag, and the number that leads a list item or a heading.
CITATION, MARKER = r"\[cite:[^\]]+\]", r"(?m)^([ \t]*(?:#{1,6}[ \t]+)?)\d+[.)][ \t]+"


def unsupported_numbers(answer: Column, sources: Column, calculated: Column, expressions: Column | None = None) -> Column:
    """Numbers of the answer that neither a source nor a calculation's expression states, nor a calculated
    value gives when rounded, half up, to as many places as the literal has once trailing zeros go. Citations
    and the numbers of list items and headings are no claims."""
    clean = F.regexp_replace(F.regexp_replace(answer, CITATION, ""), MARKER, "$1")
    new = F.array_except(numbers(clean), numbers(sources if expressions is None else F.concat_ws(" ; ", sources, expressions)))

    def places(x: Column) -> Column:
        return F.length(F.regexp_extract(F.regexp_replace(x.cast("string"), r"0+$", ""), r"\.(\d*)$", 1))

    def near(x: Column, c: Column) -> Column:
        p = places(x)
        by = F.pow(F.lit(10.0), p)
        return F.abs(F.round(c.cast("double") * by) / by - x.cast("double")) < 1e-12

    return F.filter(new, lambda x: ~F.exists(calculated, lambda c: near(x, c)))


def placed(pieces: Column) -> Column:
    """Pieces that make up a text, one after another, as structs of start, end (from 0) and quote; blank ones go."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,quote:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = s["at"] + F.length(x)
        new = F.struct(s["at"].alias("start"), end.alias("end"), x.alias("quote"))
        return F.struct(end.alias("at"), F.when(x.rlike(r"(?U)\S"), F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, zero, step, lambda s: s["out"])


def sentences(text: Column) -> Column:
    """Segments (start, end, quote) that end in a full stop of CJK text, ! or ?, or a line, with what ends them."""
    return placed(F.regexp_extract_all(text, F.lit("[^。！？\\n]+[。！？\\n]*|[。！？\\n]+"), F.lit(0)))


# Fixed value: where clauses end. A comma between digits ends none.
CLAUSE_END = r"[，；;：:。！？!?\n]|(?<!\d),|,(?!\d)"


def clauses(text: Column) -> Column:
    """Clauses (start, end, quote) of a text, each with the sign that ends it."""
    return placed(F.split(F.regexp_replace(text, f"({CLAUSE_END})", "$1\x1f"), "\x1f"))


def unique_place(text: Column, part: Column) -> Column:
    """Where the part is (from 0) if it is there exactly once, else null."""
    at = F.position(part, text)
    again = F.position(part, text, at + 1)
    return F.when((at > 0) & (again == 0), at - 1)


def centered_crop(text: Column, at: Column, size: Column, room: int = 1200) -> Column:
    """A window of at most `room` characters around a match at `at` (from 1); cut ends show an ellipsis
    that counts."""
    n = F.length(text)
    start = F.greatest(F.lit(1), F.least(at - room // 2 + F.floor((size + 1) / 2).cast("int"), n - room + 1))
    left, right = start > 1, start + room - 1 < n
    lead, trail = F.when(left, 1).otherwise(0), F.when(right, 1).otherwise(0)
    cut = F.concat(F.when(left, "…").otherwise(""), F.substring(text, start + lead, F.lit(room) - lead - trail), F.when(right, "…").otherwise(""))
    return F.when(n <= room, text).otherwise(cut)


def title(question: Column, most: int = 30) -> Column:
    q = collapsed(question)
    return F.when(F.length(q) > most, F.concat(F.left(q, F.lit(most)), F.lit("…"))).otherwise(q)


def backoff(attempt: Column, base: float, cap: float, saturation: int = 10) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(saturation))), F.lit(cap))


def instruction_flags(text: Column) -> Column:
    """Reasons to set a text aside: nothing to retrieve, invisible characters, instructing phrases."""
    hidden, instructs = text.rlike(r"\p{Cf}"), text.rlike("(?iU)" + "|".join(INSTRUCTIONS))
    empty = F.length(F.regexp_replace(text, r"(?U)\s", "")) == 0
    return F.array_compact(F.array(F.when(empty, "no_retrievable_text"), F.when(hidden, "invisible_unicode"), F.when(instructs, "instruction_like_content")))


def heading_bound(headings: Column, count: int = 16, chars: int = 128) -> Column:
    """The first headings while their characters, added up, stay within the bound."""
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("open"))

    def step(acc: Column, h: Column) -> Column:
        n = acc["n"] + F.length(h)
        fits = acc["open"] & (n <= chars)
        return F.struct(F.when(fits, n).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["out"], F.array(h))).otherwise(acc["out"]).alias("out"), fits.alias("open"))

    return F.aggregate(F.slice(headings, 1, count), zero, step, lambda acc: acc["out"])


def is_log(text: Column) -> Column:
    return text.rlike(r"^(?:TRACE|DEBUG|INFO|WARN|ERROR)\s")


def sniffed_type(content: Column) -> Column:
    """The type of a file by its first bytes, or by being clean UTF-8 text."""
    head = F.hex(F.substring(content, 1, 8))
    # bytes that aren't UTF-8 decode to the replacement sign, or to null
    text = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else content.cast("string")
    clean = text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("D0CF11E0A1B11AE1"), "application/x-ole-storage")
        .when(head.startswith("504B0304"), "application/zip")
        .when(F.coalesce(clean, F.lit(False)), "text/plain")
        .otherwise("application/octet-stream")
    )


def coordinates(text: Column) -> Column:
    """ "lon,lat" as a struct of decimals if both are plain decimals of at most 12 places in range, else null."""
    lon, lat = (F.regexp_extract(text, r"^\s*(-?\d{1,3}(?:\.\d{1,12})?)\s*,\s*(-?\d{1,3}(?:\.\d{1,12})?)\s*$", i) for i in (1, 2))
    x, y = (F.nullif(v, F.lit("")).cast("decimal(15,12)") for v in (lon, lat))
    return F.when(x.between(-180, 180) & y.between(-90, 90), F.struct(x.alias("lon"), y.alias("lat")))


# ---------------------------------------------------------------- in Python: no SQL form

# Chinese digits, units and steps.
_DIGITS = dict(zip("零一二三四五六七八九", range(10), strict=True)) | {"〇": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}
_BIG = {"万": 10**4, "亿": 10**8}
_NUMERAL = {*_DIGITS, *_UNITS, *_BIG}


def chinese_number(text: str) -> float | None:
    """The value of a Chinese numeral with 十百千万亿, 点 and 负; digits alone are read as written. None if it
    is none."""
    if text[:1] == "负":
        value = chinese_number(text[1:])
        return None if value is None else -value
    whole, point, part = text.partition("点")
    if not set(whole) - set(_BIG) or set(whole) - _NUMERAL or (point and not part) or set(part) - set(_DIGITS):
        return None
    if not set(whole) - set(_DIGITS):
        value = int("".join(str(_DIGITS[c]) for c in whole))
    else:
        total = section = digit = 0
        for i, c in enumerate(whole):
            if c in _DIGITS:
                digit = _DIGITS[c]
            elif c in _UNITS:
                section, digit = section + (digit or 1) * _UNITS[c], 0
            else:
                here = section + digit if i else 1
                total = (total + here) * _BIG[c] if c == "亿" else total + here * _BIG[c]
                section = digit = 0
        value = total + section + digit
    return float(f"{value}.{''.join(str(_DIGITS[c]) for c in part)}") if part else float(value)


@F.pandas_udf(T.DoubleType())
def chinese_numeral(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else chinese_number(x)).astype("float64")


_OPS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.FloorDiv: lambda a, b: a // b, ast.Mod: lambda a, b: a % b}
# Fixed value: the bound of a calculation's numbers.
LIMIT = 1e12


def calculate(expression: str, limit: float = LIMIT) -> float | None:
    """The value of an arithmetic expression: + - * / // % ** and signs over finite numbers within a limit; exponents
    up to 100, or 40 if the base is over 1; None for anything else."""

    def value(node) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            out = node.value
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            out = value(node.operand) * (1 if isinstance(node.op, ast.UAdd) else -1)
        elif isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            out = _OPS[type(node.op)](value(node.left), value(node.right))
        elif isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow):
            a, b = value(node.left), value(node.right)
            if abs(b) > 100 or (b > 40 and abs(a) > 1):
                raise ValueError("power out of range")
            out = a**b
        else:
            raise ValueError("not arithmetic")
        if isinstance(out, complex) or not math.isfinite(out) or abs(out) > limit:
            raise ValueError("out of range")
        return out

    if len(expression) > 1000:
        return None
    try:
        return float(value(ast.parse(expression.strip(), mode="eval").body))
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


def calculator(expression: Column | str, limit: float = LIMIT) -> Column:
    @F.pandas_udf(T.DoubleType())
    def values(expression: pd.Series) -> pd.Series:
        return expression.map(lambda x: None if x is None else calculate(x, limit)).astype("float64")

    return values(expression)


# Number literals of an answer, Chinese numerals, and the words for "per hundred" and "per thousand".
_LITERAL, _CHINESE, _PER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), re.compile("[负零〇一二两三四五六七八九十百千万亿]+(?:点[零〇一二三四五六七八九]+)?"), ("百分之", "千分之")


def stated_numbers(text: str) -> list[float]:
    """All numbers that a text states, first those in digits, then Chinese numerals, without their units: percentages as
    they are written, thousands' commas aside."""
    for word in _PER:
        text = text.replace(word, "")
    found = [float(x) for x in _LITERAL.findall(text.replace(",", ""))]
    numerals = [chinese_number(x) for x in _CHINESE.findall(text)]
    return found + [x for x in numerals if x is not None]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def numbers_stated(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else stated_numbers(x))


def mentions(text: str) -> list[tuple[str, str, int, int, str]]:
    """(field, value, start, end, status) of the companies and populations that a question names."""
    out = []
    for m in re.finditer(COMPANY, text):
        name = m["company"]
        if name not in NO_COMPANY:
            out.append(("company", name, *m.span("company"), "unresolved" if re.search(OPEN_COMPANY, name) else "resolved"))
    return out + [("population", m[0], *m.span(), "resolved") for m in re.finditer(POPULATION, text)]


_MENTION = T.ArrayType(T.StructType().add("field", T.StringType()).add("value", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("status", T.StringType()))


@F.pandas_udf(_MENTION)
def mentioned(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else [dict(zip(("field", "value", "start", "end", "status"), m, strict=True)) for m in mentions(x)])


def file_name(name: str) -> str | None:
    """A name in composed form if it is one safe part of a path, else None."""
    name = unicodedata.normalize("NFC", name).strip()
    unsafe = name in ("", ".", "..") or set(name) & set("/\\\0") or any(unicodedata.category(c) == "Cc" for c in name)
    return None if unsafe else name


@F.pandas_udf(T.StringType())
def safe_file_name(name: pd.Series) -> pd.Series:
    return name.map(lambda x: None if x is None else file_name(x))


def envelope(source: Column, evidence_id: Column, content: Column, headings: Column) -> Column:
    """A fragment as data, in JSON without spaces: no heading path if it is empty."""
    base = [F.lit("untrusted_data").alias("trust"), source.alias("source"), evidence_id.alias("evidence_id"), content.alias("content")]
    return F.when(F.size(headings) > 0, F.to_json(F.struct(*base, headings.alias("heading_path")))).otherwise(F.to_json(F.struct(*base)))
