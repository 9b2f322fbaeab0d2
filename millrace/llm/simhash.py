"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints at most 3 bits apart agree in one of 4 blocks of 16 bits (of 6 blocks of 10 or 11, in three
of them), so each distinct fingerprint goes into 4 tries (20), each led by other blocks. Below equal
leading blocks the trie is joined with itself, level by level: pairs of nodes are split together, the bits
at which their edges differ are added up, and a pair is left as soon as they exceed the error budget. A pair
of subtrees with as many bits left as budget is linked as a whole; pairs of a few leaves are compared.
Links found in a task are reduced to a forest at once, so large groups of near copies leave a row per
member, not a row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.graph import components
from millrace.llm.shared import small_batches, spare, steps, table, text_bytes, written

BITS, MOST = 64, 3
SHINGLE, SEED = 3, 42
#: Widths of blocks, and how many of them lead a trie: any two fingerprints MOST bits apart agree in so many.
COARSE, FINE = ((16,) * 4, 1), ((11, 11, 11, 11, 10, 10), 3)
#: Distinct fingerprints from which FINE is used: more tries, but nodes with so few rows as to stay small.
MANY = 1 << 24
#: Fingerprints below one node of a trie, about; and those of a block above which it is cut into parts,
#: every two of which meet in a task of their own.
NODE, PART = 512, 1024
#: Pairs of leaves below two nodes that are compared at once instead of walking further.
LEAF = 8


def _digests(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of words of a lower-cased text."""
    w = text.split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=False)], np.uint64)


def fingerprints_of(digests: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint per run of digests: a bit is 1 if set in over half of them; no digests, zero."""
    out, ends = np.zeros(len(counts), np.uint64), np.cumsum(counts)
    for a, b in steps(np.concatenate([[0], ends]), 1 << 16):
        if not (n := counts[a:b]).any():
            continue
        full = n > 0
        lo = (ends[a:b] - n)[full]
        bits = np.unpackbits(digests[lo[0] : ends[b - 1]].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, lo - lo[0], axis=0, dtype=np.int64)
        got = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
        out[a:b][full] = got
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text; null and texts without words have zero."""
    data, offs = text_bytes(texts)
    found = []
    for i in range(len(offs) - 1):
        found.append(_digests(data[offs[i] : offs[i + 1]].tobytes().lower()))
    return fingerprints_of(np.concatenate(found) if found else np.zeros(0, np.uint64), np.array([len(x) for x in found], np.int64))


def with_fingerprint(docs: DataFrame, marked: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fingerprint: long, the 64 bits), and `mark`, that of the text, if asked for."""
    names = ["doc_id", "fingerprint", *(["mark"] if marked else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    small_batches(docs.sparkSession)
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([_mark().alias("mark")] if marked else [])]
    return docs.select(*cols).mapInArrow(run, "doc_id long, fingerprint long" + (", mark string" if marked else ""))


def _mark() -> Column:
    """What tells texts apart, whatever their ids."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- the join within a trie


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n vertices' component, under links (a, b)."""
    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((at := up[up]) != up).any():
            up = at


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _apart(x: np.ndarray) -> np.ndarray:
    """Bits set in each."""
    return _POP[x & np.uint64(0xFFFF)] + _POP[x >> np.uint64(16) & np.uint64(0xFFFF)] + _POP[x >> np.uint64(32) & np.uint64(0xFFFF)] + _POP[x >> np.uint64(48)]


def _runs(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[k], lo[k] + 1, ... (size[k] of them) for each k, end to end."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())


def trie_links(left: np.ndarray, right: np.ndarray | None = None, lead: int = 16, most: int = MOST, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of `left` (with `right`, or with itself) that agree in the `lead` first bits and
    differ in at most `most` others into the same groups as all such pairs would: two arrays of positions,
    those of `right` counted on from `left`. seen: gets the node pairs walked and the leaf pairs compared.

    left and right are sorted and distinct. A node is a range of them with equal first bits; all node pairs
    of a level are split at once, each with its budget left."""
    both = left if right is None else np.concatenate([left, right])
    sides = (left, 0), (left, 0) if right is None else (right, len(left))
    depth = BITS - lead

    def nodes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(x >> np.uint64(depth), return_index=True)

    (ka, at_a), (kb, at_b) = nodes(left), nodes(sides[1][0])
    _, i, j = np.intersect1d(ka, kb, return_indices=True)
    a0, a1 = at_a[i], np.append(at_a[1:], len(left))[i]
    b0, b1 = at_b[j] + sides[1][1], np.append(at_b[1:], len(sides[1][0]))[j] + sides[1][1]
    same, budget = np.full(len(i), right is None), np.full(len(i), most)
    src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    walked = compared = 0

    def halves(lo: np.ndarray, hi: np.ndarray, side: tuple[np.ndarray, int]) -> np.ndarray:
        """Where the right child starts."""
        values, base = side
        first = (both[lo] >> np.uint64(depth) << np.uint64(depth)) | np.uint64(1 << (depth - 1))
        return np.clip(np.searchsorted(values, first) + base, lo, hi)

    while len(a0):
        walked += len(a0)
        m, n = a1 - a0, b1 - b0
        whole = depth <= budget  # nothing below can exceed it: a star
        for lo, size in ((a0[whole], m[whole]), (b0[whole], n[whole])):
            src.append(np.repeat(a0[whole], size))
            dst.append(_runs(lo, size))
        few = ~whole & (m * n <= LEAF)
        if few.any():
            x = _runs(a0[few], m[few])
            per = np.repeat(n[few], m[few])
            x, y = np.repeat(x, per), _runs(np.repeat(b0[few], m[few]), per)
            ok = (x < y) | ~np.repeat(np.repeat(same[few], m[few]), per)
            x, y = x[ok], y[ok]
            compared += len(x)
            near = _apart(both[x] ^ both[y]) <= most
            src.append(x[near])
            dst.append(y[near])
        on = ~whole & ~few
        a0, a1, b0, b1, same, budget = (x[on] for x in (a0, a1, b0, b1, same, budget))
        if not len(a0):
            break
        am, bm = halves(a0, a1, sides[0]), halves(b0, b1, sides[1])
        depth -= 1
        two = ~same  # of a node with itself, one of the two mixed pairs is enough
        mixed = (a0, am, bm, b1, same & False, budget - 1), (am[two], a1[two], b0[two], bm[two], same[two], budget[two] - 1)
        level = zip((a0, am, b0, bm, same, budget), (am, a1, bm, b1, same, budget), *mixed, strict=True)
        a0, a1, b0, b1, same, budget = (np.concatenate(x) for x in level)
        live = (a0 < a1) & (b0 < b1) & (budget >= 0) & ~(same & (a1 - a0 < 2))
        a0, a1, b0, b1, same, budget = (x[live] for x in (a0, a1, b0, b1, same, budget))
    if seen is not None:
        seen.append((walked, compared))
    src, dst = np.concatenate(src), np.concatenate(dst)
    up = roots(len(both), src, dst)
    child = np.flatnonzero(up != np.arange(len(both)))
    return up[child], child


def _orders(plan: tuple) -> list[list[tuple[int, int]]]:
    """For each trie, the blocks (shift, width) in its order, those that lead it first."""
    widths, leading = plan
    at, blocks = BITS, []
    for w in widths:
        at -= w
        blocks.append((at, w))
    return [[blocks[i] for i in c] + [x for i, x in enumerate(blocks) if i not in c] for c in combinations(range(len(widths)), leading)]


def _turned(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """Fingerprints with their blocks in the given order."""
    out = np.zeros_like(fp)
    for shift, width in order:
        out = out << np.uint64(width) | fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
    return out


def links(marks: DataFrame, plan: tuple | None = None) -> DataFrame:
    """marks(fingerprint, id), distinct fingerprints each with an id, to links (src, dst) of ids.

    A task joins the part of a trie below one node, about NODE fingerprints. Equal leading blocks with over
    PART of them are cut into parts by a hash, and every two parts meet in a task of their own, so no task
    holds more than 2 * PART rows or so whatever the skew. plan: COARSE or FINE (None: by number); both
    give all links."""
    n = marks.count()
    plan = plan or (COARSE if n < MANY else FINE)
    orders, leading = _orders(plan), plan[1]
    bits = [sum(w for _, w in o[:leading]) for o in orders]
    top = min(bits)
    depth = min(top, max(0, (n // NODE).bit_length()))

    def lead(order: list[tuple[int, int]]) -> Column:
        out = F.lit(0).cast("long")
        for shift, width in order[:leading]:
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out

    block = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), lead(o).alias("v")) for k, o in enumerate(orders))))
    rows = marks.select("fingerprint", "id", block.alias("b")).select("fingerprint", "id", "b.k", "b.v")
    big = rows.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART)
    big = big.select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = rows.join(big, (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v")), "left").drop("_k", "_v")
    below = F.element_at(F.array(*(F.lit(b - depth) for b in bits)), F.col("k") + 1)
    rows = rows.withColumn("node", F.when(F.col("parts").isNull(), F.call_function("shiftright", F.col("v"), below)).otherwise(-1 - F.col("v")))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("fingerprint", "id", "k", "node", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k, _, p, q = (int(x) for x in key)
        fp, ids, part = _turned(pdf["fingerprint"].to_numpy().view(np.uint64), orders[k]), pdf["id"].to_numpy(), pdf["part"].to_numpy()
        if p == q:
            o = np.argsort(fp)
            i, j = trie_links(fp[o], lead=bits[k])
        else:
            a, b = np.flatnonzero(part == p), np.flatnonzero(part == q)
            a, b = a[np.argsort(fp[a])], b[np.argsort(fp[b])]
            o = np.concatenate([a, b])
            i, j = trie_links(fp[a], fp[b], lead=bits[k])
        return pd.DataFrame({"src": ids[o[i]], "dst": ids[o[j]]})

    return rows.groupBy("k", "node", "p", "q").applyInPandas(run, "src long, dst long")


def _rooted(ids: DataFrame) -> DataFrame:
    """ids(fingerprint, least), distinct fingerprints, with `root`, the same for all that links join."""
    found = components(links(ids.select("fingerprint", F.col("fingerprint").alias("id"))))
    return ids.join(found, F.col("fingerprint") == F.col("id"), "left").select("fingerprint", "least", F.coalesce("component_id", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fingerprint, component_id): one row per row of docs.

    Fingerprints 3 bits apart or fewer are linked; component_id is the least doc_id that links reach,
    its own included. Texts that are null or have no words have fingerprint zero and link like any
    other. Repeated rows stay; a null doc_id is linked but never a component's id (the component is
    null if it holds no other). Other columns of docs are ignored. An empty table gives no rows."""
    marks = written(with_fingerprint(docs), "marks")
    ids = written(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    root = _rooted(ids)
    first = root.groupBy("root").agg(F.min("least").alias("component_id"))
    group = root.join(first, "root").select("fingerprint", "component_id")
    out = marks.join(group, "fingerprint")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near duplicates, whatever its id: the one with the least doc_id, null
    last. The survivor of a group is told by its id and text together, so different texts with one id or none
    go or stay each by its own group; of rows that repeat both, one stays. Null and empty texts are a group.
    All columns of docs stay, whatever their names; an empty table gives no rows."""
    marks = written(with_fingerprint(docs, marked=True), "marks")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    ids = written(marks.groupBy("fingerprint").agg(F.min(row).alias("least")), "distinct")
    key = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    kept = _rooted(ids).groupBy("root").agg(F.min("least").alias("least")).select(key(F.col("least.doc_id")).alias("_key"), F.col("least.mark").alias("_mark"))
    # rows with equal keys have equal texts, so they are of one group; both by key: the documents move once
    k, m = spare("key", docs.columns), spare("mark", docs.columns)
    rows = docs.select("*", key(F.col("doc_id").cast("long")).alias(k), _mark().alias(m))
    return rows.join(kept.select(F.col("_key").alias(k), F.col("_mark").alias(m)), [k, m], "left_semi").dropDuplicates([k, m]).drop(k, m)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op3_simhash": op3_simhash}
ORACLE: dict[str, str] = {}
