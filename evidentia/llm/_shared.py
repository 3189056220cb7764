"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one NumPy step works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch that Spark hands to a Python worker.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once a context (Spark's file server hands it out)."""
    context = spark.sparkContext
    if getattr(context, "_evidentia_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="evidentia-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = Path(folder) / "evidentia_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(str(to))
    context._evidentia_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that long texts cannot fill a worker."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (local runs) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="evidentia-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it back; cuts the lineage there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of keys that are sent to all tasks at most, and their bytes.
SENT, SENT_BYTES = 500_000, 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 16 for a column, and those of strings, binaries and arrays of strings."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            size = size + F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
    return size


def few(rows: DataFrame, keys: DataFrame, on: str | list[str] | Column, how: str) -> DataFrame:
    """A join with a table of keys: sent to all tasks if it has SENT rows and SENT_BYTES at most, else by a shuffle."""
    held = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(keys)), F.lit(0)).alias("size")).first()
    return rows.join(F.broadcast(keys) if held["n"] <= SENT and held["size"] <= SENT_BYTES else keys, on, how)


def whole_ids(docs: DataFrame, id_col: str) -> None:
    """Refuse ids that are no whole numbers of 64 bits at most."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col}: whole numbers are needed, not {kind.simpleString()}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def large(column: pa.Array) -> pa.Array:
    """A string column with 64-bit offsets and empty texts for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def release() -> None:
    """Give freed memory back: a Python worker lives through many tasks, beside others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column and where each text begins (one more than texts)."""
    release()
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Ranges of texts of about `limit` bytes together; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


def word_spans(inside: np.ndarray, offsets: np.ndarray):
    """Starts and ends of runs of `inside` bytes, cut at text limits, and each text's first word."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(inside) + 1, bool)
    before[0], before[1:] = False, inside
    after = np.empty(len(inside) + 1, bool)
    after[:-1], after[-1] = inside, False
    limits = offsets[(offsets > 0) & (offsets < len(inside))]
    joined = before & after
    joined[limits] = False
    starts = np.flatnonzero(inside & ~joined[:-1])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xD6E8FEB86659FD93)
_powers: dict = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n + 1:
        size = max(n + 1, 1 << 19) * 9 // 8
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        held = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 3 << 20:
            _powers[int(base)] = held
    return held


def prefix_hash(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64, one more than bytes."""
    up, _ = powers(base, len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, base: np.uint64, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(base, len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads the polynomial's structure (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Spans of more bytes are hashed and compared one by one, shorter ones eight bytes at a time.
LONG = 64
EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros behind the end) as one number; a view that is read by places."""
    return np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of spans, decided by their bytes and the seed alone. Each step mixes eight bytes into all before, so
    no arrangement of bytes is prone to meet another one, as some are under a polynomial modulo 2**64."""
    size = ends - starts
    h = mix(size.astype(np.uint64) + np.uint64(seed))
    wide, at, k = eights(data), np.flatnonzero(size <= LONG), 0
    while len(at):
        left = size[at] - k
        h[at] = mix(h[at] ^ (wide[starts[at] + k] & EIGHT[np.minimum(left, 8)]))
        at, k = at[left > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, their_ends: np.ndarray) -> np.ndarray:
    """Which pairs of spans hold the same bytes."""
    size = ends - starts
    out = size == their_ends - others
    wide, at, k = eights(data), np.flatnonzero(out & (size <= LONG) & (starts != others)), 0
    while len(at):
        left = size[at] - k
        same = (wide[starts[at] + k] ^ wide[others[at] + k]) & EIGHT[np.minimum(left, 8)] == 0
        out[at[~same]] = False
        at, k = at[same & (left > 8)], k + 8
    for i in np.flatnonzero(out & (size > LONG) & (starts != others)).tolist():
        out[i] = np.array_equal(data[starts[i] : ends[i]], data[others[i] : their_ends[i]])
    return out


def grams(words: np.ndarray, k: int, base: np.uint64 = BASE_2) -> np.ndarray:
    """Hashes of k consecutive word hashes from each word on (the last k-1 are not whole)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h *= base
        h += words[i : n + i]
    return mix(h)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of starts[i], starts[i]+1, ... (counts[i] values each)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begin, counts) + np.repeat(starts, counts)


#: Bytes of input for one bucket at most, on average.
BUCKET_BYTES = 32 << 20


def buckets(spark: SparkSession, size: int = 0) -> int:
    """Groups that hashed keys are dealt to: several for each shuffle partition, so that they even out, and more
    where the input (`size` bytes) asks for it, so that one stays small."""
    return max(64, 8 * partitions(spark), -(-size // BUCKET_BYTES))


def blocks(bucket: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket that occurs, with each array's values of it as bytes: a few large rows to shuffle."""
    # Numbers of 16 bits are sorted by their digits, in one go.
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    held, first = np.unique(bucket[order], return_index=True)
    last = np.append(first[1:], len(order))[: len(held)]
    columns = [pa.array(held.astype(np.int32))]
    for x in arrays:
        data, size = np.ascontiguousarray(x[order]).tobytes(), x.dtype.itemsize
        columns.append(pa.array([data[a * size : b * size] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", *(f"c{i}" for i in range(len(arrays)))])


def unblock(table: pa.Table, dtypes: list[str]) -> list[np.ndarray]:
    """The arrays of one bucket's rows, joined."""
    out = []
    for i, dtype in enumerate(dtypes):
        parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(f"c{i}")]
        out.append(np.concatenate(parts) if parts else np.zeros(0, dtype))
    return out
