"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is cut where no piece can reach across (before runs of the space mark, around
characters that only stand alone); its distinct segments are laid end to end and indexed by a suffix
array, sorted as deep as the longest piece. Every piece is binary-searched for its range of
occurrences; these edges are sorted by position into a table of (position, length). The edges are then
relaxed. The vocabulary at hand is of the byte-pair kind, whose right result isn't the path of best
total score but that of merges in order of score, leftmost first: so of all edges that join two
neighbouring symbols of a segment, the best is taken, until none is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import _R, _R_INV, _power, mapped, mixed, others, steps, table, text_bytes

#: The vocabulary file; the driver reads it and sends it to the workers (its size is fixed).
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are cut into segments at once; characters of distinct segments indexed at once;
#: characters of a segment beyond which its symbols are merged from a heap.
BATCH, INDEXED, LONG = 1 << 20, 1 << 18, 192
SPACE = 0x2581
NONE = np.int64(1) << 30


class Vocabulary:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair vocabularies without text normalisation are supported")
        self.prefix = norm.add_dummy_prefix
        pieces = [(p.piece, p.score, p.type) for p in m.pieces]
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == 2)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, (s, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(s[3:5], 16)] = i
        normal = [(s, i, score) for i, (s, score, kind) in enumerate(pieces) if kind in (1, 4)]
        self.single = np.full(0x110000, -1, np.int32)
        joined = np.zeros(0x110000, bool)
        many = [(s, i) for s, i, _ in normal if len(s) > 1]
        for s, i, _ in normal:
            if len(s) == 1:
                self.single[ord(s)] = i
        for s, _ in many:
            joined[[ord(c) for c in s]] = True
        self.alone = ~joined
        self.cut_at_space = not any(chr(SPACE) in s.lstrip(chr(SPACE)) for s, _ in many)
        scores = sorted({-score for s, _, score in normal if len(s) > 1})
        rank = {x: i for i, x in enumerate(scores)}
        self.rank = np.full(len(pieces) + 1, NONE)  # 0: no piece; i + 1: piece i
        for s, i, score in normal:
            if len(s) > 1:
                self.rank[i + 1] = rank[-score]
        # characters as numbers from 1; 0 parts segments, the last stands for all others
        chars = sorted({c for s, _ in many for c in s})
        self.code = np.full(0x110000, len(chars) + 1, np.uint64)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.bits = int(len(chars) + 1).bit_length()
        self.per_key = 63 // self.bits
        self.longest = max((len(s) for s, _ in many), default=1)
        self.keys = -(-self.longest // self.per_key)
        self.many_ids = np.array([i for _, i in many], np.int32)
        self.many_len = np.array([len(s) for s, _ in many], np.int64)
        codes = np.zeros((len(many), self.keys * self.per_key), np.uint64)
        ends = np.zeros_like(codes)
        top = np.uint64((1 << self.bits) - 1)
        for k, (s, _) in enumerate(many):
            codes[k, : len(s)] = self.code[[ord(c) for c in s]]
            ends[k] = codes[k]
            ends[k, len(s) :] = top
        pack = lambda x: np.stack([self._packed(x[:, j * self.per_key : (j + 1) * self.per_key]) for j in range(self.keys)])
        self.low_keys, self.high_keys = pack(codes), pack(ends)
        # decoding: the bytes of each piece
        out = [b"" if kind == 3 else bytes([int(s[3:5], 16)]) if kind == 6 else " ⁇ ".encode() if kind == 2 else s.replace(chr(SPACE), " ").encode() for s, _, kind in pieces]
        self.out_len = np.array([len(x) for x in out], np.int64)
        self.out_from = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)

    def _packed(self, columns: np.ndarray) -> np.ndarray:
        key = np.zeros(len(columns), np.uint64)
        for c in columns.T:
            key = key << np.uint64(self.bits) | c
        return key

    # ------------------------------------------------------------ the index

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """All occurrences of pieces of two characters or more in a text of codes, as a table (position,
        length - 2) of piece id + 1, 0 where there is none."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.keys * self.per_key, np.uint64)])
        first = np.zeros(n + (self.keys - 1) * self.per_key, np.uint64)
        for j in range(self.per_key):
            first = first << np.uint64(self.bits) | padded[j : j + len(first)]
        # suffixes sorted by doubling: by the first key, then by pairs of ranks
        order = np.argsort(first[:n])
        depth = self.per_key
        s = first[:n][order]
        while True:
            new = np.concatenate([[True], s[1:] != s[:-1]])
            if depth >= self.longest or new.all():
                break
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(new)
            after = np.zeros(n, np.uint64)
            after[: n - depth] = rank[depth:] if depth < n else 0
            key = rank << np.uint64(32) | after
            order = np.argsort(key)
            s, depth = key[order], 2 * depth
        keys = [first[j * self.per_key : j * self.per_key + n] for j in range(self.keys)]
        lo, hi = (self._place(order, keys, k, right) for k, right in ((self.low_keys, False), (self.high_keys, True)))
        count = np.maximum(hi - lo, 0)
        table_ = np.zeros((n, max(1, self.longest - 1)), np.uint16 if len(self.rank) < 1 << 16 else np.int32)
        run = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
        table_[order[run], np.repeat(self.many_len - 2, count)] = np.repeat(self.many_ids + 1, count)
        return table_

    @staticmethod
    def _place(order: np.ndarray, keys: list[np.ndarray], wanted: np.ndarray, right: bool) -> np.ndarray:
        """For each column of `wanted`, the number of suffixes below it (right: or equal to it)."""
        lo, hi = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], len(order), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, len(order) - 1)]
            below, same = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                x = k[at]
                below |= same & (x < w)
                same &= x == w
            below |= same & right
            below &= lo < hi
            lo = np.where(below, mid + 1, lo)
            hi = np.where(below | (lo > mid), hi, np.minimum(hi, mid))
        return lo

    # ------------------------------------------------------------ relaxing

    def _heap(self, begin: int, end: int, edges: np.ndarray) -> list[int]:
        """Starts of the symbols of one segment, merged from a heap of (rank, start)."""
        nxt, prev = {i: i + 1 for i in range(begin, end)}, {i: i - 1 for i in range(begin, end)}

        def edge(a: int) -> tuple[int, int, int] | None:
            b = nxt[a]
            if b >= end or nxt[b] - a > self.longest:
                return None
            r = int(self.rank[edges[a, nxt[b] - a - 2]])
            return (r, a, nxt[b]) if r < NONE else None

        heap = [x for i in range(begin, end) if (x := edge(i))]
        heapq.heapify(heap)
        while heap:
            _, a, to = heapq.heappop(heap)
            b = nxt.get(a)
            if b is None or b >= end or nxt[b] != to:
                continue
            nxt[a] = to
            del nxt[b]
            if to < end:
                prev[to] = a
            for i in (a, prev[a]):
                if i >= begin and (x := edge(i)):
                    heapq.heappush(heap, x)
        out, i = [], begin
        while i < end:
            out.append(i)
            i = nxt[i]
        return out

    def _merged(self, begin: np.ndarray, size: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the symbols of all segments, in order of position."""
        done: list[np.ndarray] = []
        for a, n in zip(begin[size > LONG].tolist(), size[size > LONG].tolist(), strict=True):
            starts = np.array(self._heap(a, a + n, edges))
            done.append(np.stack([starts, np.append(starts[1:], a + n)]))
        begin, size = begin[size <= LONG], size[size <= LONG]
        seg = np.repeat(np.arange(len(begin)), size)
        b = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        e = b + 1
        while len(b):
            r = np.full(len(b), NONE)
            span = e[1:] - b[:-1]
            ok = np.flatnonzero((seg[1:] == seg[:-1]) & (span <= self.longest))
            r[ok] = self.rank[edges[b[ok], span[ok] - 2]]
            head = np.flatnonzero(np.diff(seg, prepend=-1))
            best = np.minimum.reduceat(r << 24 | np.arange(len(b)), head)
            going = best < NONE << 24
            stay = np.repeat(going, np.diff(np.append(head, len(b))))
            if not going.all():
                done.append(np.stack([b[~stay], e[~stay]]))
            at = best[going] & 0xFFFFFF
            e[at] = e[at + 1]
            stay[at + 1] = False
            b, e, seg = b[stay], e[stay], seg[stay]
        spans = np.concatenate(done, 1) if done else np.zeros((2, 0), np.int64)
        o = np.argsort(spans[0])
        return spans[0][o], spans[1][o]

    def _ids(self, chars: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments (ranges of chars) end to end, and how many each has."""
        room = size + 1  # a 0 after each
        at = np.cumsum(room) - room
        code = np.zeros(int(room.sum()), np.uint64)
        to = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        source = chars[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        code[to] = self.code[source]
        flat = np.zeros(len(code), np.uint32)
        flat[to] = source
        edges = self.edges(code)
        b, e = self._merged(at, size, edges)
        one = e - b == 1
        ids = np.where(one, self.single[flat[b]], edges[b, np.maximum(e - b - 2, 0)].astype(np.int64) - 1)
        lost = np.flatnonzero(ids < 0)
        count = np.ones(len(b), np.int64)
        if len(lost):  # by the bytes of the character
            c = flat[b[lost]]
            count[lost] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            raw = np.frombuffer(flat[b[lost]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            out = np.repeat(ids, count)
            out[np.repeat(ids < 0, count)] = self.byte_ids[raw]
            ids = out
        of = np.searchsorted(at, b, "right") - 1
        return ids.astype(np.int32), np.bincount(of, count, len(size)).astype(np.int64)

    # ------------------------------------------------------------ texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has; null and empty texts have none."""
        data, offs = text_bytes(texts)
        ids, counts = [], []
        for i, j in steps(offs, BATCH):
            got, n = self._encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ids.append(got)
            counts.append(n)
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        size = np.diff(leads)
        full = size > 0
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        start = leads[:-1][full]
        if self.prefix:
            chars = np.insert(raw, start, 0x20)
            start = start + np.arange(len(start))
        else:
            chars = raw.copy()
        chars[chars == 0x20] = SPACE
        cut = np.zeros(len(chars), bool)
        cut[start] = True
        alone = self.alone[chars]
        cut |= alone
        cut[1:] |= alone[:-1]
        if self.cut_at_space:
            space = chars == SPACE
            cut[1:] |= space[1:] & ~space[:-1]
        begin = np.flatnonzero(cut)
        length = np.diff(np.append(begin, len(chars)))
        h = _char_hashes(chars, begin, begin + length)
        _, first, of = np.unique(h, return_index=True, return_inverse=True)
        # distinct segments, a bounded part of them at a time
        ids, counts = [], []
        fb, fs = begin[first], length[first]
        ends = np.concatenate([[0], np.cumsum(fs + 1)])
        for a, z in steps(ends, INDEXED):
            got, n = self._ids(chars, fb[a:z], fs[a:z])
            ids.append(got)
            counts.append(n)
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        at = np.cumsum(counts) - counts
        n = counts[of]
        flat = ids[np.repeat(at[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        per = np.zeros(len(size), np.int64)
        per[full] = np.add.reduceat(n, np.searchsorted(begin, start))
        return flat, per

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids. Control ids have no text, the unknown id has its sign; bytes that form no
        character become U+FFFD. The space that encoding put in front goes. Raises ValueError for ids
        that the vocabulary hasn't."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.out_len)):
            raise ValueError("an id is not in the vocabulary")
        n = self.out_len[ids]
        data = self.out_bytes[np.repeat(self.out_from[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        offs = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        drop = np.zeros(len(counts), bool)
        if self.prefix:
            full = np.diff(offs) > 0
            drop[full] = data[offs[:-1][full]] == 0x20
            data = np.delete(data, offs[:-1][drop])
            offs = offs - np.concatenate([[0], np.cumsum(drop)])
        try:
            data.tobytes().decode()
            inner = offs[offs < len(data)]
            if ((data[inner] & 0xC0) == 0x80).any():
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "")
        except UnicodeDecodeError:
            return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:], strict=False)], pa.string())
        return pa.StringArray.from_buffers(len(counts), pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


_HASH = mixed(np.arange(1, 0x110001, dtype=np.uint64))


def _char_hashes(chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    pre = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_HASH[chars] * _power(_R, len(chars)), out=pre[1:])
    return mixed((pre[end] - pre[begin]) * _power(_R_INV, len(chars))[begin] + (end - begin).astype(np.uint64))


def _model(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_held: dict[int, Vocabulary] = {}


def _vocabulary(sent) -> Vocabulary:
    """One vocabulary for each worker process."""
    key = hash(sent.value)
    if key not in _held:
        _held[key] = Vocabulary(sent.value)
    return _held[key]


def encode(docs: DataFrame, column: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with `ids` (array of int) and `n_ids` in place of `column`; check: also `round_trip`, whether
    decoding the ids gives the text. Null and empty texts have no ids (and do round-trip, as the empty
    text). The space mark U+2581 in a text decodes as a space. Columns with these names are replaced, all
    others stay, whatever their names; repeated rows are encoded each, an empty table gives no rows. Texts
    are taken BATCH bytes at a time; one longer text needs some 60 bytes of memory for each of its own."""
    more = [("ids", T.ArrayType(T.IntegerType())), ("n_ids", T.IntegerType()), *([("round_trip", T.BooleanType())] if check else [])]
    cols = others(docs, column.lower(), *(n for n, _ in more))
    sent = _model(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent)
        for whole in batches:
            _, offs = text_bytes(whole.column(0))
            for i, j in steps(offs, BATCH):
                b = whole.slice(i, j - i)
                ids, n = v.encode(b.column(0))
                to = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                out = [*b.columns[1:], pa.ListArray.from_arrays(to, pa.array(ids)), pa.array(n.astype(np.int32))]
                if check:
                    back = v.decode(ids, n)
                    was = b.column(0).fill_null("")
                    out.append(pc.equal(was, back))
                yield pa.record_batch(out, [*cols, *(n for n, _ in more)])

    return mapped(docs, F.col(f"`{column}`").cast("string"), cols, run, more)


def decode(rows: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """rows with `text` in place of `column`, an array of ids; null and empty arrays give the empty text, a
    null id among others has no text. A column named text is replaced, all others stay."""
    cols = others(rows, column.lower(), "text")
    sent = _model(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(sent)
        for whole in batches:
            size = pc.fill_null(pc.list_value_length(whole.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in steps(np.concatenate([[0], np.cumsum(size)]), BATCH // 4):
                b = whole.slice(i, j - i)
                flat, n = b.column(0).flatten(), size[i:j]
                if flat.null_count:
                    there = flat.is_valid().to_numpy(zero_copy_only=False)
                    n = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(n)])])
                    flat = flat.drop_null()
                yield pa.record_batch([*b.columns[1:], v.decode(flat.to_numpy(zero_copy_only=False), n)], [*cols, "text"])

    return mapped(rows, F.col(f"`{column}`").cast("array<int>"), cols, run, [("text", T.StringType())])


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, round_trip of every document."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)


QUERIES: dict[str, Callable] = {"op4_sentencepiece": op4_sentencepiece}
ORACLE: dict[str, str] = {}
