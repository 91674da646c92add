"""Shared helpers: tables in the shared scratch folder, checked broadcasts, word kernels.

A *word* is a maximal run of bytes other than space and tab..carriage return.  The kernels
work on the UTF-8 buffer of an Arrow column, many documents at a time, so Python cost per
document stays small and memory follows the block size, not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one kernel block holds (a longer document is a block of its own).
BLOCK_BYTES = 1 << 18
#: Rows up to which a side may be broadcast; `bounded_broadcast` counts before it hints.
BROADCAST_ROWS = 200_000
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000
#: Bytes of a batch that goes to a Python worker: very long texts travel a few at a time.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Columns of the documents table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


# ------------------------------------------------------------------ scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a folder of our own only where it is unset and all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="cachelens-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and its size is known to the planner.

    While it is written, texts go to Python in batches of BATCH_ROWS rows and about BATCH_BYTES bytes, which
    bounds a worker's memory and the executor's native buffers.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_BATCH_SETTING, _BYTES_SETTING)}
    spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """For a pipeline's session: texts go to Python in batches of BATCH_ROWS rows in whatever it runs, unless it set its own size."""
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialise` wrote and that nothing reads any more."""
    for table in tables:
        spark, files = table.sparkSession, table.inputFiles()
        if files:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; else as it is (shuffle join, split by AQE)."""
    return F.broadcast(df) if df.count() <= rows else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows that no model learns from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def release_memory() -> None:
    """Hand memory that numpy and Arrow no longer use back to the system."""
    gc.collect()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# ------------------------------------------------------------------ Arrow text blocks
def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about `size` bytes."""
    data, offsets = utf8_view(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    del data, offsets, column
    _trim()  # workers live on from stage to stage


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of large batches in batches of at most `rows` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross documents, and words before each document."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each document of a block: byte starts, byte ends, index of each document's first word."""
    return runs((data != 32) & ((data < 9) | (data > 13)), offsets)


# ------------------------------------------------------------------ hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: the public-domain splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << int(n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.r_[_U(1), np.full(n - 1, b, np.uint64)]) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_PRIME), _Powers(_STEP)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end); starts ascend.  Long data go in parts, which bounds the tables of powers."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * BLOCK_BYTES and len(starts) > 1:
        cuts = np.unique(np.r_[0, np.searchsorted(starts, np.arange(BLOCK_BYTES, len(data), BLOCK_BYTES)), len(starts)])
        parts = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            lo, hi = int(starts[a]), int(ends[a:b].max())
            parts.append(_span_hashes(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo))
        return np.concatenate(parts)
    return _span_hashes(data, starts, ends)


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _BYTES.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(_STEP))


def window_hashes(word: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of words [i, i+k) for each i with such a window in the whole array."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.to(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[: len(word)], out=total[1:])
    salt = _U((seed * 0x9E3779B97F4A7C15 + k) & 0xFFFFFFFFFFFFFFFF)
    return mix((total[k:] - total[:-k]) * down[:n] + salt)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ------------------------------------------------------------------ id filters of bounded size
#: Bits of an id filter; its size does not depend on the data.
FILTER_BITS = 1 << 25
#: Ids up to which a filter keeps most other rows out; beyond them a semi-join takes its place.
FILTER_IDS = FILTER_BITS // 4
_BITMAP_BITS = 32768  # bits of one bitmap of bitmap_construct_agg


def python_bit(column: str) -> Column:
    """The bit that `hits` looks at: the low bits of the number itself (for hashes)."""
    return F.col(column).bitwiseAND(FILTER_BITS - 1)


def hits(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True for hashes that a filter made with python_bit lets through."""
    bit = values & (FILTER_BITS - 1)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def _bit(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, bit: Column) -> np.ndarray:
    """A bitmap with the bit of each id: no id is missed, some others pass, its size is fixed."""
    bit = bit + 1  # Spark counts buckets and positions from 1
    rows = ids.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros((FILTER_BITS // _BITMAP_BITS, _BITMAP_BITS // 8), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _in_filter(df: DataFrame, keys: Sequence[str], bits: np.ndarray, inside: bool, then: Callable, schema: str) -> DataFrame:
    """Rows of df whose keys the filter lets through (or the other rows), handed to `then` in the same Python worker."""
    shared = df.sparkSession.sparkContext.broadcast(bits)
    columns = df.columns

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(len(columns)).to_numpy()
            hit = (shared.value[bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0
            yield batch.select(columns).filter(pa.array(hit == inside))

    return df.withColumn("_bit", _bit(keys)).mapInArrow(lambda batches: then(pick(batches)), schema)


def same_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches


def only(df: DataFrame, keys: Sequence[str], ids: DataFrame, then: Callable = same_rows, schema: str | None = None) -> DataFrame:
    """Rows of df whose keys may be in ids (no row that is in is missed), handed to the mapInArrow function `then`.

    Up to FILTER_IDS ids a filter in the Python worker spares df a shuffle; beyond, it is a semi-join.
    """
    schema = schema or df.schema
    if ids.count() <= FILTER_IDS:
        return _in_filter(df, keys, id_filter(ids, _bit(keys)), True, then, schema)
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi").select(*df.columns).mapInArrow(then, schema)


def split(df: DataFrame, keys: Sequence[str], ids: DataFrame, then: Callable, schema: str) -> tuple[DataFrame | None, DataFrame]:
    """(rows of df that are surely not in ids, handed to `then`; the other rows); with many ids all are other rows."""
    if ids.count() > FILTER_IDS:
        return None, df
    bits = id_filter(ids, _bit(keys))
    return _in_filter(df, keys, bits, False, then, schema), _in_filter(df, keys, bits, True, same_rows, df.schema)


def row_key(docs: DataFrame) -> DataFrame:
    """docs with doc and twin: its doc_id (a hash of the text where there is none) and a second hash of the text.

    Repeated rows share both, as they share their result; rows of one doc_id with different texts differ in twin.
    """
    text = F.coalesce("text", F.lit(""))
    null = F.col("doc_id").isNull()
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))).withColumn("twin", F.when(null, -1).otherwise(1) * F.abs(F.hash(text, F.lit(7)).cast("long")))


KEY = ["doc", "twin"]
