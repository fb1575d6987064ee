"""Pieces that several operators share: shared folders, packed batches, components."""

from __future__ import annotations

import atexit
import ctypes
import io
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def use_shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    The session's checkpoint folder is used where it is set. Only where it is not (tests, a
    single machine) a folder of our own is set: below a warehouse on a cluster, a temporary
    one in local mode.
    """
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if found.isEmpty() and named:
        sc.setCheckpointDir(named)
    elif found.isEmpty():
        local = sc.master.startswith("local[") or sc.master == "local"
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and (warehouse.startswith("file:") or "://" not in warehouse):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-") if local else f"{warehouse}/_checkpoints")
    # Files of checkpoints go when nothing refers to them any more.
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    uri = f"{use_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, uri)
    return uri


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def remove_folder(uri: str) -> None:
    store, path = open_folder(uri)
    if store.get_file_info(path).type == pafs.FileType.Directory:
        store.delete_dir(path)


def put(uri: str, name: str, *data: np.ndarray) -> None:
    """Written under another name and moved, so that a task that is run again, or twice at once, leaves a whole file."""
    store, path = open_folder(uri)
    own = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for x in data:
            out.write(np.ascontiguousarray(x))
    move(store, own, f"{path}/{name}")


def move(store: pafs.FileSystem, own: str, to: str) -> None:
    """Some stores don't move onto a file; the one that is there has the same contents and may stay."""
    try:
        store.move(own, to)
    except OSError:
        if store.get_file_info(to).type != pafs.FileType.File:
            raise
        store.delete_file(own)


def saved(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; lineage ends there."""
    use_shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    base = int(offs[0])
    body = np.frombuffer(data, np.uint8)[base : int(offs[-1])] if data else np.zeros(0, np.uint8)
    return body, offs - base


def release() -> None:
    """Freed memory goes back to the system; else a Python worker keeps it, beside its executor's JVM, for as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries decide for themselves
    if trim:
        trim(0)


def releasing(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that leaves no freed memory behind when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return run


def releasing_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run


def releasing_groups(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def run(own: pa.Table, other: pa.Table) -> pa.Table:
        out = f(own, other)
        release()
        return out

    return run


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about ``most`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is changed in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def task_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c in counts, one after the other."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
#: Bytes whose prefix sums are made at once.
HASHED = 1 << 19


def power_tables(n: int) -> list[np.ndarray]:
    """P^i and P^-i modulo 2^64 for i up to n: with them, a prefix sum gives a hash of any run of bytes."""
    if not _powers or len(_powers[0]) < n + 1:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64) for base in (_P, pow(_P, -1, 1 << 64))]
    return _powers


def prefix_sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_tables(len(data))[0][: len(data)], dtype=np.uint64, out=total[1:])
    return total


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end], for ascending begins; the bytes between first and last are summed once."""
    out = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(end, begin[a] + HASHED, "right")))
        low = int(begin[a])
        total = prefix_sums(data[low : int(end[b - 1])])
        s, e = begin[a:b] - low, end[a:b] - low
        out[a:b] = mix((total[e] - total[s]) * power_tables(len(total))[1][s] + (e - s).astype(np.uint64))
        a = b
    return out


def pack_batches(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """(batch, blob): rows with about ``size`` bytes of text each, compressed, dealt by batch.

    A blob holds a struct of df's other columns and the text; see batch_rows(). One batch is a
    whole number of rows, so a longer text is a batch of its own.
    """
    source = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = task_id(), 0
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, size):
                out = io.BytesIO()
                some = batch.slice(a, b - a)
                with pa.ipc.new_stream(out, some.schema) as w:
                    w.write_batch(some)
                blob = zstandard.ZstdCompressor(level=1).compress(out.getbuffer())
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq]), pa.array([blob], pa.binary())], ["batch", "blob"])
                seq += 1

    return source.mapInArrow(releasing(pack), "batch long, blob binary").repartition(shuffle_partitions(df.sparkSession), "batch")


def batch_rows(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def compressed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def uncompressed(x: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for links a-b among 0..n-1."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
        if np.array_equal(before, label):
            break
    return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of the links a-b the smallest node that it reaches.

    Large-star and small-star rounds (Kiveris et al., 2014) until the links no longer change.
    Each round is two aggregations, combined before their shuffle, and two joins in which a
    hub's links can be split; links are written to the shared folder after each round. Nothing
    but a count and a sum of hashes a round comes to the driver: when both stay, so do the links. Rounds
    end, as each but the last makes some end of a link smaller. Links with a null end are left out.
    """
    links = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    size = None
    while True:
        # Large star: every neighbour above u is tied to the least of u and its neighbours.
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its lower neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        after = saved(small)
        before, size = size, tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        links = after
        if before == size:
            break
    stars = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
