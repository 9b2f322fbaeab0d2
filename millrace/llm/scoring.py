"""Language-model scoring with a sharded n-gram trie.

The model is an interpolated bigram with absolute discounting over a unigram that is discounted too
and gives the freed mass to the unknown word. It grows with the corpus, so it is never broadcast:

1. Workers turn texts into blocks of about BLOCK_TOKENS tokens and send each shard the distinct words
   and pairs that it owns, with their training counts: sums per block come before the shuffle.
2. A shard adds up its counts, builds its trie (see trie.py) and looks up every requested pair. It
   answers each block with counts, coded backoffs and coded probabilities.
3. A block, sent in a second pass as indices into its distinct words, meets its answers and is scored.

A context that holds more than half a shard's share of all tokens (found on a bounded sample; the
choice moves rows, never results) has its pairs dealt by both words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import as_bytes, held_out, mixed, span_hashes, steps, table, text_bytes, words, written
from millrace.llm.trie import NgramTrie

BLOCK_TOKENS = 3 << 19
#: Bytes of text whose words and pairs a shard owns, about; shards at least.
SHARD_BYTES, LEAST_SHARDS = 6_000_000, 64
DISCOUNT = 0.75
#: Rows of the sample on which frequent contexts are found, besides one per shard.
SAMPLE_ROWS = 4096
#: End and start of a text: no word has these hashes but with a chance of 2**-64.
END, START = np.uint64(0x1C69B3F74AC4AE35), np.uint64(0x3C6EF372FE94F82B)


class Block:
    """Texts as one row of tokens: `word` are the sorted distinct ones, `at` each token's index there;
    `pair` are the distinct pairs, context index << 32 | word index (the start's index is the number
    of words), `of` each token's pair."""

    def __init__(self, word: np.ndarray, at: np.ndarray, n: np.ndarray):
        self.word, self.at, self.n = word, at.astype(np.int64), n
        self.first = np.cumsum(n) - n
        before = np.empty_like(self.at)
        before[1:] = self.at[:-1]
        before[self.first] = len(word)
        self.pair, self.of = np.unique(before << 32 | self.at, return_inverse=True)

    @staticmethod
    def of_hashes(hashes: np.ndarray, counts: np.ndarray) -> Block:
        n = counts + 1
        token = np.empty(int(n.sum()), np.uint64)
        last = np.zeros(len(token), bool)
        last[np.cumsum(n) - 1] = True
        token[last], token[~last] = END, hashes
        word, at = np.unique(token, return_inverse=True)
        return Block(word, at, n)

    def context(self) -> np.ndarray:
        return np.append(self.word, START)[self.pair >> 32]


def _owners(block: Block, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each word and of each pair."""
    of_word = (mixed(block.word) % np.uint64(shards)).astype(np.int64)
    context = block.context()
    spread = np.isin(context, hot)
    of_pair = np.append(of_word, 0)[block.pair >> 32]
    word = block.word[block.pair & 0xFFFFFFFF]
    of_pair[spread] = mixed(context[spread] + mixed(word[spread] ^ END)) % np.uint64(shards)
    return of_word, of_pair


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Block, np.ndarray, np.ndarray]]:
    """Blocks of a partition of (doc_id, text, held): number, block, doc_ids, held. Both passes cut
    a partition into the same blocks."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    kept: list = []

    def out():
        h, n, ids, held = (np.concatenate([x[i] for x in kept]) for i in range(4))
        return part << 24 | seq, Block.of_hashes(h, n), ids, held

    for b in batches:
        data, offs = text_bytes(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for i, j in steps(offs):
            bit, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, n = words(bit, o)
            kept.append((span_hashes(bit, s, e), n, ids[i:j], held[i:j]))
            size += len(s) + j - i
            if size >= BLOCK_TOKENS:
                yield out()
                kept, size, seq = [], 0, seq + 1
    if kept:
        yield out()


_REQUEST = "block long, shard int, w binary, wn binary, c binary, cn binary, p binary, q binary, pn binary"
_ANSWER = "block long, shard int, count binary, back binary, back_book binary, code binary, book binary, stats array<long>, spread array<struct<word:long,n:long>>"


def _requests(shards: int, hot: np.ndarray) -> Callable:
    def run(batches):
        for number, b, _, held in _blocks(batches):
            train = np.repeat(~held, b.n)
            wn = np.bincount(b.at, train, len(b.word)).astype(np.uint32)
            pn = np.bincount(b.of, train, len(b.pair)).astype(np.uint32)
            of_word, of_pair = _owners(b, shards, hot)
            context, second = b.context(), b.word[b.pair & 0xFFFFFFFF]
            by_word, by_pair = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
            cut_w, cut_p = (np.searchsorted(o[i], np.arange(shards + 1)) for o, i in ((of_word, by_word), (of_pair, by_pair)))
            rows = []
            # shards that own something of the block: no more than it has words and pairs
            for s in np.flatnonzero((np.diff(cut_w) > 0) | (np.diff(cut_p) > 0)).tolist():
                w, p = by_word[cut_w[s] : cut_w[s + 1]], by_pair[cut_p[s] : cut_p[s + 1]]
                if len(w) or len(p):
                    heads = np.flatnonzero(np.diff(context[p], prepend=~context[p[:1]]))
                    runs = np.diff(np.append(heads, len(p))).astype(np.uint32)
                    rows.append((number, s, *as_bytes(b.word[w], wn[w], context[p][heads], runs, (second[p] >> np.uint64(32)).astype(np.uint32), (second[p] & np.uint64(0xFFFF)).astype(np.uint16), pn[p])))
            for i in range(0, len(rows), 64):
                part = list(zip(*rows[i : i + 64], strict=True))
                yield pa.record_batch([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), *(pa.array(x, pa.binary()) for x in part[2:])], ["block", "shard", "w", "wn", "c", "cn", "p", "q", "pn"])

    return run


def _texts(batches):
    for number, b, ids, held in _blocks(batches):
        i = b.at
        cols = as_bytes(ids, held, b.n.astype(np.uint32), b.word, (i & 0xFFFF).astype(np.uint16), (i >> 16).astype(np.uint8 if len(b.word) < 1 << 24 else np.uint16))
        yield pa.record_batch([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in cols)], ["block", "ids", "held", "n", "word", "lo", "hi"])


def _joined(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col), kind)


def _answer(hot: np.ndarray) -> Callable:
    """What a shard does with all requests to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        w, wn = _joined(pdf["w"], np.uint64), _joined(pdf["wn"], np.uint32)
        word, wi = np.unique(w, return_inverse=True)
        count = np.bincount(wi, wn, len(word))
        heads, runs = _joined(pdf["c"], np.uint64), _joined(pdf["cn"], np.uint32)
        # within a context, 48 bits tell its successors apart
        second, pn = _joined(pdf["p"], np.uint32).astype(np.uint64) << np.uint64(16) | _joined(pdf["q"], np.uint16), _joined(pdf["pn"], np.uint32)
        context, hi = np.unique(heads, return_inverse=True)
        succ, si = np.unique(second, return_inverse=True)
        key, ki = np.unique(np.repeat(hi, runs).astype(np.int64) << 32 | si, return_inverse=True)
        n = np.bincount(ki, pn, len(key))
        ci, pi = key >> 32, key & 0xFFFFFFFF
        spread = np.isin(context, hot)
        # the words of a context that isn't spread are here: its count is too
        at = np.minimum(np.searchsorted(word, context), max(len(word) - 1, 0))
        of = np.where(spread, 1.0, np.maximum(count[at] if len(word) else 0, 1))
        seen = n > 0
        types = np.bincount(ci[seen], minlength=len(context))
        log_b = np.log10(np.maximum(DISCOUNT * types, 1e-9) / of)
        log_p = np.log10((n[seen] - DISCOUNT) / of[ci[seen]])
        trie = NgramTrie.built(len(context), len(succ) + 1, ci[seen], pi[seen], log_p, log_b).in_mapped_memory()
        code = np.concatenate([trie.find(ci[i : i + 1_000_000], pi[i : i + 1_000_000]) for i in range(0, max(len(key), 1), 1_000_000)])
        # backoffs of words that are contexts with successors in training; 255: none, all mass backs off
        back = np.full(len(word), 255, np.uint8)
        known = np.flatnonzero((types > 0) & ~spread)
        back[at[known]] = trie.b[known]
        ends_w, ends_p = (np.cumsum([len(x) // size for x in pdf[c]]) for c, size in (("w", 8), ("p", 4)))
        rows, a, b = [], 0, 0
        for block, ew, ep in zip(pdf["block"], ends_w, ends_p, strict=True):
            rows.append((block, shard, *as_bytes(count[wi[a:ew]].astype(np.uint32), back[wi[a:ew]], trie.b_book, code[ki[b:ep]], trie.p_book), None, None))
            a, b = ew, ep
        stats = [int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int((count == 2).sum())]
        hots = [(int(c), int(t)) for c, t in zip(context[spread].view(np.int64), types[spread], strict=True)]
        rows.append((-1, shard, None, None, None, None, None, stats, hots))
        return pd.DataFrame(rows, columns=["block", "shard", "count", "back", "back_book", "code", "book", "stats", "spread"])

    return run


def _score(shards: int, hot: np.ndarray, hot_types: np.ndarray, hot_start: float, total: int, types: int, ones: int, twos: int) -> Callable:
    """What a block does with the answers to it."""
    cut = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
    unknown = cut * types / total if total else 1.0

    def run(texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in texts.itertuples():
            at = np.frombuffer(t.lo, np.uint16).astype(np.int64)
            word = np.frombuffer(t.word, np.uint64)
            at |= np.frombuffer(t.hi, np.uint8 if len(t.hi) == len(at) else np.uint16).astype(np.int64) << 16
            b = Block(word, at, np.frombuffer(t.n, np.uint32).astype(np.int64))
            of_word, of_pair = _owners(b, shards, hot)
            by_word, by_pair = np.argsort(of_word, kind="stable"), np.argsort(of_pair, kind="stable")
            cut_w, cut_p = (np.searchsorted(o[i], np.arange(shards + 1)) for o, i in ((of_word, by_word), (of_pair, by_pair)))
            count, back, seen = np.zeros(len(word) + 1), np.ones(len(word) + 1), np.zeros(len(b.pair))
            done = 0
            for r in answers.itertuples():
                w, p = by_word[cut_w[r.shard] : cut_w[r.shard + 1]], by_pair[cut_p[r.shard] : cut_p[r.shard + 1]]
                got, code = np.frombuffer(r.count, np.uint32), np.frombuffer(r.code, np.uint8)
                if len(got) != len(w) or len(code) != len(p):
                    raise RuntimeError("a block was cut otherwise in the second pass: its input changed between them")
                count[w] = got
                book = np.append(10.0 ** np.frombuffer(r.back_book, np.float32).astype(float), np.zeros(256))[:256]
                book[255] = 1.0
                back[w] = book[np.frombuffer(r.back, np.uint8)]
                book = np.append(10.0 ** np.frombuffer(r.book, np.float32).astype(float), np.zeros(256))[:256]
                book[255] = 0.0
                seen[p] = book[code]
                done += len(w) + len(p)
            if done != len(word) + len(b.pair):
                raise RuntimeError("a block has not got all its answers")
            # contexts that are spread: their pairs have counts, and their types were added up
            context = np.append(word, START)
            count[-1] = hot_start
            i = np.minimum(np.searchsorted(hot, context), len(hot) - 1)
            is_hot = hot[i] == context
            back[is_hot] = np.where(count[is_hot] > 0, DISCOUNT * hot_types[i[is_hot]] / np.maximum(count[is_hot], 1), 1.0)
            ci = b.pair >> 32
            seen = np.where(is_hot[ci], seen / np.maximum(count[ci], 1), seen)
            uni = np.where(count[:-1] > 0, (count[:-1] - cut) / max(total, 1), unknown)
            log_p = np.log10(seen + back[ci] * uni[b.pair & 0xFFFFFFFF])
            base = np.log10((count[:-1] + 1) / (total + types + 1))
            known = (count[:-1] > 0).astype(np.int64)
            out.append(pd.DataFrame({
                "doc_id": np.frombuffer(t.ids, np.int64), "held_out": np.frombuffer(t.held, bool), "n_tokens": b.n,
                "n_known": np.add.reduceat(known[b.at], b.first), "train_tokens": np.int64(total),
                "base_score": np.add.reduceat(base[b.at], b.first), "score": np.add.reduceat(log_p[b.of], b.first),
            }))
        return pd.concat(out) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_NULL_ID = -(1 << 63)


def _hot(rows: DataFrame, n: int, shards: int) -> np.ndarray:
    """Sorted hashes of the contexts with over half a shard's share of the tokens of a sample; at most
    2 * shards of them, and the start of a text."""
    every = max(1, n // (SAMPLE_ROWS + shards))

    def run(batches):
        for b in batches:
            data, offs = text_bytes(b.column(0))
            for i, j in steps(offs):
                bit = data[offs[i] : offs[j]]
                s, e, _ = words(bit, offs[i : j + 1] - offs[i])
                h, k = np.unique(span_hashes(bit, s, e), return_counts=True)
                often = k > max(1, len(s) / (8 * shards))
                h, k = np.append(h[often], np.uint64(0)), np.append(k[often], len(s))
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(k.astype(np.int64))], ["h", "k"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    sums = sample.mapInArrow(run, "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
    total = sums.where("h = 0").select("k").first()
    found = sums.where(F.col("k") > (total[0] if total else 0) / (2 * shards)).where("h <> 0").collect() if total else []
    return np.unique(np.append(np.array([r["h"] for r in found], np.int64).view(np.uint64), START))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """docs(doc_id, text) to a row per row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    Rows whose crc32(doc_id as text) mod `modulus` is `remainder` are held out; the model learns from
    all others. Words are runs of other characters than space and U+0009 to U+000D, A-Z lower-cased,
    then one end per text. A null text is empty (one token, the end); a null doc_id counts as the
    empty id. Repeated rows are trained on and scored each. With no training rows, every token is the
    unknown word with probability 1. Other columns of docs are ignored."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), modulus, remainder).alias("held"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(LEAST_SHARDS, size // SHARD_BYTES)
    hot = _hot(rows, n, shards)
    asked = rows.mapInArrow(_requests(shards, hot), _REQUEST)
    answers = written(asked.groupBy("shard").applyInPandas(_answer(hot), _ANSWER), "answers")
    sums = answers.where("block = -1").select(*(F.sum(F.element_at("stats", i + 1)).alias(x) for i, x in enumerate(("total", "types", "ones", "twos")))).first()
    spread = answers.where("block = -1").select(F.explode("spread").alias("s")).groupBy("s.word").agg(F.sum("s.n").alias("n")).collect()
    kinds = dict(zip(np.array([r["word"] for r in spread], np.int64).view(np.uint64).tolist(), (r["n"] for r in spread), strict=True))
    hot_types = np.array([kinds.get(h, 0) for h in hot.tolist()], float)
    starts = rows.where(~F.col("held")).count()
    texts = rows.mapInArrow(_texts, "block long, ids binary, held binary, n binary, word binary, lo binary, hi binary")
    run = _score(shards, hot, hot_types, float(starts), *(int(x or 0) for x in sums))
    out = texts.groupBy("block").cogroup(answers.where("block >= 0").drop("stats", "spread").groupBy("block")).applyInPandas(run, _SCORES)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the model of those that aren't held out."""
    return score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op1_lm_scoring": op1_lm_scoring}
ORACLE: dict[str, str] = {
    # all columns but the model's score come in SQL; that one is held against brute force in the tests
}
