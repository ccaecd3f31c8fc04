"""Helpers shared by the operators: scratch tables, Arrow streaming and vectorised hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: list[str] = []
_WRITTEN: list[str] = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="scratch-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, kind: str) -> str:
    path = f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables that operators wrote in this session's scratch folder; results that read them end with it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let Arrow batches to Python workers end at ``size`` bytes, however long the texts in them are (Spark: 64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).strip().lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(key, str(size))


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow; at the end of a task, what its worker holds free goes back to the system.

    Spark keeps workers for later tasks, and their allocators keep freed memory, so that each kind of task would add its
    own peak to that of the others.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return wrapped


def stored(df: DataFrame, kind: str, free: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    With ``free``, the shuffle files of that write go when it is done, on all executors; else Spark keeps them until the
    driver's garbage collector happens to run.
    """
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if free else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_parts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, bin) of rows with an id; ``part`` tells different texts of one id apart (0 where ids are unique).

    Rows that repeat an id and its text have one part, so each of them gets the same result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bin")).where(F.col("doc_id").isNotNull())
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return base.select("doc_id", F.lit(0).cast("long").alias("part"), "bin")
    from pyspark.sql import Window

    keyed = base.withColumn("_h", F.sha2("bin", 256))
    parts = (
        keyed.join(again.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "_h").distinct()
        .withColumn("part", F.row_number().over(Window.partitionBy("doc_id").orderBy("_h")).cast("long") - 1)
    )
    return keyed.join(parts, ["doc_id", "_h"], "left").select("doc_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "bin")


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and the n + 1 offsets of a binary or string Arrow column without nulls."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def batches_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Glue Arrow batches until ``rows`` rows are together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_keys(batches: Iterable[pa.RecordBatch], key: str, rows: int, *more: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key`` (and ``more`` columns): tables of about ``rows`` rows that never split a key."""
    held: pa.Table | None = None
    for t in batches_of(batches, rows):
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        other = np.zeros(t.num_rows, bool)  # rows of another key than the last one's
        for c in (key, *more):
            k = t[c].to_numpy()
            other |= k != k[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        held = t.slice(cut).combine_chunks()
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held


# -- hashing -----------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
LEVEL_ODD = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
PLACE_ODD = _RNG.integers(0, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
BLOCK_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return x


def times(x: np.uint64, n: int) -> np.uint64:
    """x n modulo 2^64, without numpy's warning for scalars."""
    return np.uint64(int(x) * n & 0xFFFFFFFFFFFFFFFF)


def doubled(h: np.ndarray, widths: Iterable[int]) -> dict[int, np.ndarray]:
    """Hashes of all runs of 2^k symbols, for the powers of two in ``widths``."""
    out, width, level, top = {}, 1, 0, max(widths)
    wanted = set(widths)
    while True:
        if width in wanted:
            out[width] = h
        if width >= top:
            return out
        h = h[:-width] * LEVEL_ODD[level] + h[width:] if len(h) > width else h[:0]
        width *= 2
        level += 1


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that are no separators) of each row; words before each row (n + 1)."""
    n = len(data)
    word = ~separator[data]
    first = word.copy()
    first[1:] &= separator[data[:-1]]
    begins = offsets[:-1]
    begins = begins[begins < n]
    first[begins] = word[begins]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
    place = inside - np.repeat(starts, lengths)
    odd = PLACE_ODD[place & 4095]
    if len(place) and place.max() > 4095:
        odd = odd + (place >> 12).astype(np.uint64) * BLOCK_ODD
    values = BYTE_HASH[data[inside]] * odd
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mix64(np.add.reduceat(values, heads) + lengths.astype(np.uint64) * LEVEL_ODD[63])
