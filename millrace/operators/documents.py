"""From blocks to parents and children: relational passes, and ordered folds per document."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import normalized

#: Sizes in tokens: a child's limit, a parent's aim (low, high) and its hard limit.
CHILD, LOW, HIGH, HARD = 384, 1200, 1800, 2400
#: Kinds by the label of the parser, fixed values.
KINDS = {"title": "heading", "section_header": "heading", "text": "paragraph", "paragraph": "paragraph", "list_item": "list", "table": "table", "code": "code", "formula": "formula", "picture": "picture", "page_header": "furniture", "page_footer": "furniture"}
#: Kinds that stand alone in a parent.
ALONE = ("table", "code", "log")


def in_reading_order(blocks: DataFrame, doc: str, page: str, reading: str, source: str) -> DataFrame:
    """blocks with block_index from 0: by page, then reading order (or source order), then source order."""
    order = W.partitionBy(doc).orderBy(page, F.coalesce(reading, source), source)
    return blocks.withColumn("block_index", F.row_number().over(order) - 1)


def kind_of(label: Column) -> Column:
    pairs = [x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit("paragraph"))


#: Kinds that may go on over a page's end; fixed values.
GO_ON = ("paragraph", "list_item", "table")


def joined_across_pages(blocks: DataFrame, doc: str, order: str, page: str, kind: str, text: str, opens: str, goes_on: str, table: str | None = None, role: str | None = None) -> DataFrame:
    """Blocks that go on over a page's end as one (order and kind of the first, page_from, page_to, text, parts): the
    block before is of the same kind, one of GO_ON, on the same page or the one before, and either says that it goes on
    while this one says that it opens so, or both are of one table (`table`: its id, null for none).

    Headers and footers (`role` isn't null) come between nothing and stay as they are. Tables' rows are put together by a
    line end; words by a space, if an ASCII letter or digit would meet another, and by nothing otherwise."""
    w = W.partitionBy(doc, "_role").orderBy(order)
    before = lambda c: F.lag(c).over(w)
    rows = blocks.withColumn("_role", F.lit(False) if role is None else F.col(role).isNotNull())
    near = (before(kind) == F.col(kind)) & F.col(kind).isin(*GO_ON) & F.col(page).between(before(page), before(page) + 1)
    follows = before(goes_on) & F.col(opens)
    if table is not None:
        follows = F.coalesce(follows, F.lit(False)) | ((F.col(kind) == "table") & (before(table) == F.col(table)))
    rows = rows.withColumn("_new", F.when(F.coalesce(near & follows & ~F.col("_role"), F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"])
    out = rows.groupBy(doc, "_role", "_run").agg(F.min(order).alias(order), F.min_by(kind, order).alias(kind), F.min(page).alias("page_from"), F.max(page).alias("page_to"), parts.alias("_parts"))

    def put(a, b):
        words = F.right(a, F.lit(1)).rlike("[0-9A-Za-z]") & F.left(b, F.lit(1)).rlike("[0-9A-Za-z]")
        return F.concat(a, F.when(F.col(kind) == "table", "\n").when(words, " ").otherwise(""), b)

    whole = F.aggregate(F.slice("_parts", 2, F.greatest(F.size("_parts"), F.lit(1))), F.element_at("_parts", 1), put)
    return out.select(doc, order, kind, "page_from", "page_to", whole.alias(text), F.size("_parts").cast("long").alias("parts"))


def without_furniture(blocks: DataFrame, doc: str, page: str, text: str, role: str) -> DataFrame:
    """blocks without headers and footers (`role` isn't null) whose text, normalized (NFKC, white space collapsed, case
    folded), stands in that role on two or more pages of the document."""
    key = F.when(F.col(role).isNotNull(), F.md5(normalized(text)))
    rows = blocks.withColumn("_k", key)
    often = rows.where("_k is not null").groupBy(doc, role, "_k").agg(F.count_distinct(page).alias("n")).where("n >= 2").select(doc, role, "_k")
    return rows.join(often, [doc, role, "_k"], "left_anti").drop("_k").select(*blocks.columns)


def resolved(spans: DataFrame, blocks: DataFrame, doc: str, parent: str) -> DataFrame:
    """(doc, parent, text, problem): the text that a parent's spans give back from the blocks of its document.

    spans(doc, parent, n, block, block_id, start, end, row_from, row_to, header_rows, separator): the span's block by
    place and id; characters start to end, or, where rows are given and the table's header isn't in them, rows row_from to
    row_to behind the header's. blocks(doc, block, id, text). A block that isn't there or isn't that one, or a range
    beyond it, is a problem, and its parent has no text."""
    at = spans.join(blocks.select(doc, "block", F.col("id").alias("_id"), F.col("text").alias("_text")), [doc, "block"], "left")
    lines = F.split("_text", "\n")
    by_row = F.col("row_from").isNotNull() & F.col("row_to").isNotNull() & (F.coalesce("header_rows", F.lit(1)) > 0)
    problem = (
        F.when(F.col("_id").isNull(), "no such block").when(F.col("_id") != F.col("block_id"), "another block").when(F.col("end") > F.length("_text"), "beyond the block")
        .when(by_row & (F.col("row_to") > F.size(lines)), "beyond the rows")
    )
    rows = F.concat(F.slice(lines, 1, F.coalesce("header_rows", F.lit(0))), F.slice(lines, F.col("row_from") + 1, F.greatest(F.col("row_to") - F.col("row_from"), F.lit(0))))
    piece = F.when(by_row, F.array_join(rows, "\n")).otherwise(F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")))
    at = at.withColumn("_problem", problem).withColumn("_piece", F.concat(F.coalesce("separator", F.lit("")), F.when(F.col("_problem").isNull(), piece).otherwise("")))
    parts = F.array_sort(F.collect_list(F.struct("n", "_piece")))
    out = at.groupBy(doc, parent).agg(F.array_join(F.transform(parts, lambda x: x["_piece"]), "").alias("text"), F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("n"))).alias("problem"))
    return out.withColumn("text", F.when(F.col("problem").isNull(), F.col("text")))


def near_edge(top: Column, bottom: Column, height: Column, share: float = 0.15) -> Column:
    return (top <= height * share) | (bottom >= height * (1 - share))


def overlap(a: Column, b: Column) -> Column:
    """Area shared by two boxes (arrays of left, top, right, bottom, corners in any order) over the area of both."""

    def side(x: Column, i: int) -> tuple[Column, Column]:
        return F.least(x[i], x[i + 2]), F.greatest(x[i], x[i + 2])

    shared, sizes = [], []
    for i in (0, 1):
        (p, q), (r, s) = side(a, i), side(b, i)
        shared.append(F.greatest(F.least(q, s) - F.greatest(p, r), F.lit(0.0)))
        sizes.append((q - p, s - r))
    both = shared[0] * shared[1]
    union = sizes[0][0] * sizes[1][0] + sizes[0][1] * sizes[1][1] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def without_overlaid(blocks: DataFrame, doc: str, page: str, order: str, text: str, box: str, least: float = 0.8) -> DataFrame:
    """Blocks less those that repeat a kept block's text (normalized) on the same page at the same place; blocks without
    a box stay. Kept order matters (A may hide B while B would have hidden C), so it is a fold over the boxes of a page
    and text; orders are unique in a page."""
    rows = blocks.withColumn("_k", F.md5(normalized(text)))
    kind = dict(blocks.dtypes)
    boxed = rows.where(F.size(box) == 4).groupBy(doc, page, "_k").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(box).cast("array<double>").alias("b")))).alias("_all"))
    boxed = boxed.where(F.size("_all") > 1)  # a text that is there once hides nothing
    none = F.struct(F.array().cast("array<array<double>>").alias("kept"), F.array().cast(f"array<{kind[order]}>").alias("hidden"))

    def step(s: Column, x: Column) -> Column:
        hides = F.exists(s["kept"], lambda k: overlap(k, x["b"]) >= least)
        return F.struct(F.when(hides, s["kept"]).otherwise(F.concat(s["kept"], F.array(x["b"]))).alias("kept"), F.when(hides, F.concat(s["hidden"], F.array(x["o"]))).otherwise(s["hidden"]).alias("hidden"))

    hidden = boxed.select(doc, page, F.explode(F.aggregate("_all", none, step)["hidden"]).alias(order))
    return blocks.join(hidden, [doc, page, order], "left_anti").select(*blocks.columns)


def repaired_levels(levels: Sequence[int | None]) -> list[int]:
    """Heading levels that start at 1 and never rise by more than one; a missing one is one deeper."""
    out: list[int] = []
    for x in levels:
        last = out[-1] if out else 0
        out.append(min(x if x is not None and x > 0 else last + 1, last + 1))
    return out


def heading_paths(kinds: Sequence[str], levels: Sequence[int | None], texts: Sequence[str]) -> list[list[str]]:
    """The headings above each block."""
    fixed = iter(repaired_levels([lv for k, lv in zip(kinds, levels, strict=True) if k == "heading"]))
    stack: list[str] = []
    out = []
    for k, t in zip(kinds, texts, strict=True):
        if k == "heading":
            stack = [*stack[: next(fixed) - 1], t]
        out.append(list(stack))
    return out


def tokens(text: str) -> int:
    return len(text.split())


def rows_split(text: str, most: int, header: bool) -> list[str]:
    """A table, log or listing cut between rows; a table's header row comes again in each part. One row
    may be over the limit alone."""
    lines = text.splitlines()
    head = lines[:1] if header and len(lines) > 1 else []
    size, part, out = sum(map(tokens, head)), [], []
    for line in lines[len(head) :]:
        if part and size + tokens(line) > most:
            out.append("\n".join(head + part))
            size, part = sum(map(tokens, head)), []
        part.append(line)
        size += tokens(line)
    return [*out, "\n".join(head + part)] if part or not out else out


def parents_of(kinds: Sequence[str], texts: Sequence[str]) -> list[list[int]]:
    """Blocks grouped to parents: a heading starts one; tables, code and logs stand alone; others join
    while they fit HIGH, or up to HARD if what is there is short."""
    out: list[list[int]] = []
    part: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal part, size
        if part:
            out.append(part)
        part, size = [], 0

    for i, (k, t) in enumerate(zip(kinds, texts, strict=True)):
        n = tokens(t)
        if k in ALONE:
            flush()
            out.append([i])
            continue
        if k == "heading" and any(kinds[j] != "heading" for j in part):
            flush()
        if part and size + n > HIGH:
            if size < LOW and size + n <= HARD:
                part.append(i)
                flush()
                continue
            flush()
        part.append(i)
        size += n
    flush()
    return out


def children_of(text: str, heading: str = "", most: int = CHILD) -> list[tuple[int, int]]:
    """Ranges of a parent's text that hold at most `most` tokens with the heading, cut after words."""
    room = max(1, most - tokens(heading))
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    return [(spans[i][0], spans[min(i + room, len(spans)) - 1][1]) for i in range(0, len(spans), room)]


_PARENT = "parent_no int, child_no int, kind string, heading_path array<string>, start int, end int, content string, contextualized string"


def chunked(blocks: DataFrame, doc: str) -> DataFrame:
    """blocks(doc, block_index, kind, level, text) to children with their parent's number and place. The
    fold needs a document's blocks in order: a row holds one document, a batch some of them."""
    row = F.array_sort(F.collect_list(F.struct("block_index", "kind", F.col("level").cast("int").alias("level"), "text")))
    each = lambda c: F.transform("_blocks", lambda x: x[c]).alias(c)
    whole = blocks.groupBy(doc).agg(row.alias("_blocks")).select(doc, *(each(c) for c in ("kind", "level", "text")))
    names = [doc, *(c.split()[0] for c in _PARENT.split(", "))]

    def of(key, kinds: list, levels: list, texts: list) -> list[tuple]:
        paths = heading_paths(kinds, [None if x is None or x != x else int(x) for x in levels], texts)
        out, no = [], 0
        for group in parents_of(kinds, texts):
            kind = kinds[group[0]]
            parts = rows_split(texts[group[0]], HARD, kind == "table") if kind in ALONE else ["\n".join(texts[i] for i in group)]
            for content in parts:
                path = paths[group[-1]]
                head = " > ".join(path)
                for n, (a, b) in enumerate(children_of(content, head)):
                    piece = content[a:b]
                    out.append((key, no, n, kind, path, a, b, piece, f"{head}\n{piece}" if head else piece))
                no += 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                some = b.iloc[i : i + 64]
                yield pd.DataFrame([r for x in zip(some[doc], *(some[c].map(list) for c in ("kind", "level", "text")), strict=True) for r in of(*x)], columns=names)

    return whole.mapInPandas(run, f"{doc} {dict(blocks.dtypes)[doc]}, {_PARENT}")


def table_cells(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, column, cell) of tables with pipes or tabs; rules between rows are skipped."""
    rows = df.select(key, F.posexplode(F.split(text, "\n")).alias("row", "_line")).where(F.length(F.trim("_line")) > 0)
    rows = rows.where(~F.col("_line").rlike(r"^[\s|:-]+$"))
    cells = F.when(F.col("_line").contains("|"), F.split(F.regexp_replace(F.trim("_line"), r"^\||\|$", ""), r"\|")).otherwise(F.split("_line", "\t"))
    return rows.select(key, "row", F.posexplode(cells).alias("column", "_c")).select(key, "row", "column", F.trim("_c").alias("cell"))


def clipped(start: Column, end: Column, low: Column, high: Column) -> Column:
    """The part of a range that lies in another, null if none does."""
    a, b = F.greatest(start, low), F.least(end, high)
    return F.when(a < b, F.struct(a.alias("start"), b.alias("end")))
