"""What the operators of this subpackage share: staging tables, binary exchange rows, size-driven bucket counts."""

from __future__ import annotations

import ctypes
import math
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no checkpoint folder, as in tests.
OWN_CHECKPOINTS = "/tmp/checkpoints/tidemark"
#: Rows of the binary exchange: `bucket` decides the task, `kind` says what `payload` holds.
EXCHANGE = "bucket long, kind int, payload binary"

#: Whether the shuffle files of a query are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _give_back(least: int = 2 << 20, top: int = 8 << 20) -> None:
    """In a worker: arrays of `least` bytes go back to the system when they are freed, and so does a free end of the heap beyond `top`.

    By default the bounds rise to 32 and 64 MB, and Arrow keeps what it frees: workers live on between stages with it.
    """
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, top)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another allocator
        return
    pa.set_memory_pool(pa.system_memory_pool())


if TaskContext.get() is not None:
    _give_back()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.  Only a local session, as in tests, may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (at or OWN_CHECKPOINTS).rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratches:
        _scratches[-1].paths.append(path)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")  # what the write shuffled goes when it has ended, not when the driver's heap is next collected
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_scratches: list[Scratch] = []


class Scratch:
    """Tables staged inside are deleted at the end but for those that are kept, which belong to the scratch around, if any."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], []

    def __enter__(self) -> Scratch:
        _scratches.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.append(table.staged_at)
        return table

    def __exit__(self, *_) -> None:
        _scratches.remove(self)
        for path in self.paths:
            if path not in self.kept:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        if _scratches:
            _scratches[-1].paths += self.kept


def ids_shared(df: DataFrame, id_col: str) -> bool:
    """Whether several rows have one id."""
    ids = df.select(F.col(id_col).alias("i")).filter("i is not null")
    return not ids.groupBy("i").count().filter("count > 1").limit(1).isEmpty()


def numbered(df: DataFrame, id_col: str, text_col: str, name: str = "__row") -> DataFrame:
    """df with a number of its own for each row that has an id, in order of ids and texts; written, so that it stays the same."""
    rows = df.sort(F.col(id_col).asc_nulls_last(), F.col(text_col))
    return staged(rows.withColumn(name, F.when(F.col(id_col).isNotNull(), F.monotonically_increasing_id())), "numbered")


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of df's size; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def bucket_count(df: DataFrame, bytes_each: int) -> int:
    """Buckets that grow with the input, so that what one bucket gathers stays near `bytes_each` of input."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    return _prime(least if size is None else max(least, min(math.ceil(size / bytes_each), 1 << 30)))


def _prime(n: int) -> int:
    """The first prime from n on: ids in steps are then dealt evenly by their remainder."""
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def doc_bucket(n_buckets: int):
    """The bucket of a document, in Spark; np.mod(ids, n_buckets) is the same."""
    return F.pmod(F.col("doc_id"), F.lit(n_buckets).cast("long")).alias("bucket")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, can't clash; rows without an id are left out."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")


# ---------------------------------------------------------------- binary rows


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the smallest unsigned type."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def deltas(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as a first value and zigzag differences in a narrow type: nearly free where ids are in order."""
    ids = ids.astype(np.int64)
    d = np.diff(ids)
    return ids[:1], narrow(((d << 1) ^ (d >> 63)).view(np.uint64))


def undeltas(first: np.ndarray, d: np.ndarray) -> np.ndarray:
    d = d.astype(np.uint64)
    back = (d >> np.uint64(1)).view(np.int64) ^ -(d & np.uint64(1)).view(np.int64)
    return np.concatenate([first, back]).cumsum() if len(first) else np.zeros(0, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    head = [struct.pack("<B", len(arrays))]
    body = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<3sQ", a.dtype.str[-2:].encode().ljust(3), len(a)))
        body.append(a.tobytes())
    return b"".join(head + body)


def unpack(b: bytes) -> list[np.ndarray]:
    n, at, out = b[0], 1 + 11 * b[0], []
    for k in range(n):
        kind, length = struct.unpack_from("<3sQ", b, 1 + 11 * k)
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(b, dtype, length, at))
        at += length * dtype.itemsize
    return out


def pack_rows(bucket: np.ndarray, n_buckets: int, ids: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One (bucket, payload) for each bucket that has rows; the order of rows in a bucket is kept."""
    if not len(bucket):
        return
    small = bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(small, kind="stable")
    small = small[order]
    cuts = np.flatnonzero(first_of_runs(small)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(small)], strict=True):
        at = order[lo:hi]
        yield int(small[lo]), pack(*deltas(ids[at]), *(narrow(c[at]) if c.dtype.kind == "i" else c[at] for c in columns))


def unpack_rows(payloads: Iterable[bytes]) -> list[np.ndarray]:
    """What pack_rows packed, put together: ids, then the columns."""
    parts: list[list[np.ndarray]] = []
    for b in payloads:
        first, d, *columns = unpack(b)
        parts.append([undeltas(first, d), *columns])
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def exchange_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    bucket, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "kind", "payload"])


def scatter(df: DataFrame, emit, n_buckets: int) -> DataFrame:
    """Run emit(ids, raw, off) -> iterable of (bucket, kind, payload) on each Arrow batch of (doc_id, text)."""
    from tidemark.llm.textcore import buffers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            if len(ids):
                yield from chunked(emit(ids, *buffers(batch.column("text"))))

    return df.mapInArrow(run, EXCHANGE)


def chunked(rows: Iterable[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most about `most` bytes, so no side of the Arrow pipe holds a whole task's output."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2]) + 32
        if size >= most:
            yield exchange_batch(held)
            held, size = [], 0
    if held:
        yield exchange_batch(held)


def table_rows(table: pa.Table, kind: int) -> list[bytes]:
    """The payloads of one kind in a bucket."""
    kinds = table.column("kind").to_numpy()
    return [b for b, k in zip(table.column("payload").to_pylist(), kinds, strict=True) if k == kind]


def first_of_runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Booleans: which rows of sorted columns differ from the row before."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return new
