"""The outline of documents: heading levels, paths and sections by one fold over a document's headings, references
between blocks, and bounded walks along them. All of it in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that make a reference to a heading that follows; fixed values.
REFERENCE_WORDS = ("参见", "按照", "按", "依据", "见", "see")
#: Steps of a walk along references and blocks of it, at most.
HOPS, BLOCKS = 2, 16


def outlined(blocks: DataFrame, doc: str, order: str, level: str, text: str, repair: bool = True, paths: bool = True) -> DataFrame:
    """(doc, order, level, path, end) of the headings, the blocks of a document whose text and level tell one (level is
    null elsewhere; a heading without a level has 0). Levels start at 1 and rise by one at most, a missing one is one
    deeper; `path` holds the headings above and itself; `end` is the next heading of the same level or above, null at
    the document's end. Without repair, levels stay as they are; without paths, there are none and no text is gathered.

    A document's headings, in order, go through a stack: what a heading closes is done. The fold holds the headings
    of one document, without its text."""
    kind = dict(blocks.dtypes)
    named = {"text": "string", "path": "array<string>"} if paths else {}
    entry = "struct<" + ",".join(f"{k}:{t}" for k, t in {"order": kind[order], "level": "int", "end": kind[order], **named}.items()) + ">"
    head = F.struct(F.col(order).alias("order"), F.col(level).cast("int").alias("level"), *([F.col(text).alias("text")] if paths else []))
    heads = blocks.where(F.col(level).isNotNull()).groupBy(doc).agg(F.sort_array(F.collect_list(head)).alias("heads"))
    empty = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast(f"array<{entry}>").alias("done"), F.lit(0).alias("last"))

    def step(s: Column, h: Column) -> Column:
        asked = F.when(h["level"] > 0, h["level"]).otherwise(s["last"] + 1)
        now = F.least(asked, s["last"] + 1) if repair else h["level"]
        still = F.filter(s["stack"], lambda e: e["level"] < now)
        closed = F.transform(F.filter(s["stack"], lambda e: e["level"] >= now), lambda e: F.struct(e["order"].alias("order"), e["level"].alias("level"), h["order"].alias("end"), *(e[k].alias(k) for k in named)))
        above = [h["text"].alias("text"), F.concat(F.transform(still, lambda e: e["text"]), F.array(h["text"])).alias("path")] if paths else []
        new = F.struct(h["order"].alias("order"), now.cast("int").alias("level"), F.lit(None).cast(kind[order]).alias("end"), *above)
        return F.struct(F.concat(still, F.array(new)).alias("stack"), F.concat(s["done"], closed).alias("done"), now.cast("int").alias("last"))

    all_ = F.aggregate("heads", empty, step, lambda s: F.concat(s["done"], s["stack"]))
    out = heads.select(doc, F.explode(all_).alias("e"))
    return out.select(doc, F.col("e.order").alias(order), F.col("e.level").alias("level"), *([F.col("e.path").alias("path")] if paths else []), F.col("e.end").alias("end"))


def references(blocks: DataFrame, doc: str, order: str, text: str, heading: Column, words: Sequence[str] = REFERENCE_WORDS) -> DataFrame:
    """(doc, src, dst): blocks whose text names, after one of the words, a heading of their document that is there
    once. What follows a word is cut to the lengths that the document's headings have and met with them by equality."""
    heads = blocks.where(heading & (F.length(text) > 0)).groupBy(doc, F.col(text).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("dst")).where("n = 1").drop("n")
    lengths = heads.groupBy(doc).agg(F.collect_set(F.length("title")).alias("lengths"))
    after = F.regexp_extract_all("_text", F.lit("(?s)(?:" + "|".join(words) + ") *(?=(.*))"), F.lit(1))
    rows = blocks.where(F.col(text).rlike("|".join(words))).select(doc, F.col(order).alias("src"), F.col(text).alias("_text")).join(lengths, doc)
    tails = rows.select(doc, "src", "lengths", F.explode(after).alias("tail")).select(doc, "src", "tail", F.explode("lengths").alias("_n"))
    named = tails.where(F.length("tail") >= F.col("_n")).select(doc, "src", F.left("tail", F.col("_n")).alias("title"))
    return named.join(heads, [doc, "title"]).select(doc, "src", "dst").distinct()


def walked(edges: DataFrame, roots: DataFrame, doc: str, root: str, hops: int = HOPS, most: int = BLOCKS) -> DataFrame:
    """(doc, root, node, hop): what each root reaches along edges(doc, src, dst) in `hops` steps, nearer nodes first,
    then by order, `most` of a root at most, the root itself first. Nodes beyond `most` aren't walked from.

    Of a node's edges to others the first `most` are enough: those whose ends a root has seen are no more than it has
    seen, and the others fill up the rest. Only what roots reach is walked, each step over it once."""
    near, first = W.partitionBy(doc, root).orderBy("hop", "node"), W.partitionBy(doc, "src").orderBy("dst")
    ends = edges.where(~F.col("dst").eqNullSafe(F.col("src"))).select(doc, "src", "dst", F.dense_rank().over(first).alias("_n")).where(F.col("_n") <= most)
    ends = ends.select(doc, F.col("src").alias("_from"), F.struct(F.col("dst").alias("node")).alias("_to"))
    start = roots.select(doc, root).distinct()
    out = start.select(doc, root, F.col(root).alias("node"), F.lit(0).alias("hop"))
    seen = None
    for hop in range(1, hops + 1):
        here, there = F.struct("node", "hop"), F.struct(F.col("_to.node").alias("node"), F.lit(hop).alias("hop"))
        if seen is None:
            rows = start.join(ends.withColumnRenamed("_from", root), [doc, root]).select(doc, root, there.alias("_e")).select(doc, root, "_e.*")
        else:
            rows = seen.withColumn("_from", F.when(F.col("hop") == hop - 1, F.col("node"))).join(ends, [doc, "_from"], "left")
            both = F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))
            rows = rows.select(doc, root, F.explode(both).alias("_e")).select(doc, root, "_e.*").where(~F.col("node").eqNullSafe(F.col(root))).repartition(doc, root)
        rows = rows.groupBy(doc, root, "node").agg(F.min("hop").alias("hop"))
        seen = rows.withColumn("_n", F.row_number().over(near)).where(F.col("_n") < most).drop("_n")
    return out if seen is None else out.unionByName(seen)


def section_edges(refs: DataFrame, outline: DataFrame, blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, src, dst): references to headings as edges to all blocks of their sections."""
    ends = outline.select(doc, F.col(order).alias("dst"), F.col("end").alias("_end"))
    inside = blocks.select(doc, F.col(order).alias("_at"))
    rows = refs.join(ends, [doc, "dst"]).join(inside, doc).where((F.col("_at") >= F.col("dst")) & (F.col("_end").isNull() | (F.col("_at") < F.col("_end"))))
    return rows.select(doc, "src", F.col("_at").alias("dst")).distinct()
