"""What the corpus operators share: table access, tables in the shared folder, byte-level tokens."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as a Java regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that one vectorised step handles; bounds a worker's memory.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark hands to a worker, about: bounds both sides' memory, however long the rows.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. A local session (one
    machine, as in tests) without it gets a folder of its own; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files behind a table of written()."""
    spark, path = df.sparkSession, df._written_to
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spare(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as no column in `taken` has (names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those named, whatever their case."""
    return [c for c in df.columns if c.lower() not in names]


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session doesn't yet: a batch of long texts is as small as one
    of short texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def mapped(df: DataFrame, value: Column, keep: list[str], run: Callable, more: list[tuple[str, T.DataType]]) -> DataFrame:
    """mapInArrow over (value, *keep): run yields batches of the columns kept and `more`, by place."""
    small_batches(df.sparkSession)
    cols = [F.col(f"`{c}`") for c in keep]
    schema = df.select(*cols).schema
    for name, kind in more:
        schema = schema.add(name, kind)
    return df.select(value.alias(spare("value", keep)), *cols).mapInArrow(run, schema)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of doc_id as text, modulo modulus, is remainder; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


# ---------------------------------------------------------------- byte-level words

_WHITE = np.zeros(256, bool)
_WHITE[list(SPACES)] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed = _mixed
_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_R = 0x9E3779B97F4A7C13 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """Powers of base below the n-th; those of usual steps are kept, longer ones (a long text's) are not."""
    got = _powers.get(str(base))
    if got is None or len(got) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        got = np.cumprod(x)
        if n <= STEP_BYTES + (STEP_BYTES >> 1):
            _powers[str(base)] = got
    return got[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Bytes that part words where punctuation isn't wanted: all of ASCII but letters and digits.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the number of words of each text."""
    solid = ~white[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    start[inner] = solid[inner]
    end = np.zeros(len(data) + 1, bool)
    end[1:][solid] = True
    end[1:-1] &= ~(solid[1:] & ~start[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial over random byte values, from prefix sums."""
    n = len(data)
    if not n or not len(starts):
        return np.zeros(len(starts), np.uint64)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOW if lower else _BYTE)[data] * _power(_R, n), out=pre[1:])
    h = (pre[ends] - pre[starts]) * _power(_R_INV, n)[starts]
    return _mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def as_bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]
