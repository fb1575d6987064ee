"""Finding the numbers that more than one item of a table has, without shuffling the numbers in full.

Batches send hashes of their numbers, a little wider than needed to tell them apart, in ascending
steps; buckets report the hashes that they got more than once; and the batches then send
the numbers behind those alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import mix, releasing, releasing_group, releasing_groups, shuffle_partitions, task_id, utf8

#: A batch deals its numbers to 2 ** FAN_BITS buckets at most, so that a list's row costs little beside
#: its numbers; finer buckets are dealt from the lists of GROUP batches together.
FAN_BITS, GROUP = 12, 1 << 10
#: Numbers of one bucket, on average, and the bits beyond a bucket's that tell its numbers apart.
BUCKET, LOW_BITS = 1 << 22, 32
#: Numbers that are mixed, shifted or compared at once, so that a bucket or batch takes little more memory than its numbers.
BLOCK = 1 << 18


def pack_steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers as steps, each of as many bytes as the largest step needs."""
    steps = np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_steps(data: bytes) -> np.ndarray:
    width = data[0]
    columns = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    steps = np.zeros((columns.shape[1], 8), np.uint8)
    steps[:, :width] = columns.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def bits_of(numbers: int) -> tuple[int, int]:
    """(bits of a bucket's name, bits of a hash) for a table with so many numbers."""
    bucket_bits = max(2, (numbers // BUCKET).bit_length())
    return bucket_bits, min(64, bucket_bits + LOW_BITS, max(bucket_bits + 8, numbers.bit_length() + 7))


def deal(ascending: np.ndarray, low_bits: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of ascending numbers by the ``bits`` bits above the low ones; empty buckets are left out."""
    cuts = np.searchsorted(ascending, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low_bits))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, int(cuts[b]), int(cuts[b + 1])


def _sorted_with_owner(lists: list[np.ndarray], owners: list[np.ndarray], low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    number, owner = np.concatenate(lists), np.concatenate(owners)
    bits = max(1, int(owner.max(initial=0)).bit_length())
    if low_bits + bits <= 64:
        both = (number << np.uint64(bits)) | owner.astype(np.uint64)
        both.sort()
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    return number[order], owner[order]


def equal_neighbours(ascending: np.ndarray, bits: int) -> np.ndarray:
    """The places of numbers that are equal to one beside them, but for so many low bits."""
    hit, low = np.zeros(len(ascending), bool), np.uint64(bits)
    for a in range(0, len(ascending) - 1, BLOCK):
        some = ascending[a : a + BLOCK + 1] >> low
        same = some[1:] == some[:-1]
        hit[a + 1 : a + 1 + len(same)] |= same
        hit[a : a + len(same)] |= same
    return np.flatnonzero(hit)


def _met(column: pa.ChunkedArray, owners: list[np.ndarray] | None, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, owner), ascending, of the numbers of a bucket's lists that occur more than once; list i has the owners owners[i], or is owned by i.

    Owners stand below the numbers, in the same 64 bits, where there is room: so one array is filled list by list and sorted in place.
    """
    lists = (unpack_steps(x.as_py()) for x in column)
    bits = max(1, (max((int(o.max(initial=0)) for o in owners), default=0) if owners is not None else len(column) - 1).bit_length())
    if low_bits + bits > 64:
        whole = list(lists)
        number, owner = _sorted_with_owner(whole, owners if owners is not None else [np.full(len(x), i) for i, x in enumerate(whole)], low_bits)
        at = equal_neighbours(number, 0)
        return number[at], owner[at]
    sizes = [(x.as_buffer().size - 1) // x.as_buffer()[0] for x in column]
    both, a = np.empty(sum(sizes), np.uint64), 0
    for i, x in enumerate(lists):
        x <<= np.uint64(bits)
        x |= np.uint64(i) if owners is None else owners[i].astype(np.uint64)
        both[a : a + len(x)] = x
        a += len(x)
    both.sort()
    both = both[equal_neighbours(both, bits)]
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def met_again(packed: DataFrame, hashes: Callable[[bytes], np.ndarray], bucket_bits: int, hash_bits: int, hot: int | None = None, fan_bits: int = FAN_BITS, group: int = GROUP) -> DataFrame:
    """(batch, data, hot): for the rows (batch, blob) of ``packed`` the hashes that occur more than once in the table, ascending.

    hashes(blob) gives a batch's hashes, ascending, of hash_bits bits. ``hot`` holds those that
    more than ``hot`` batches have. A table of many buckets is dealt in two steps: to
    2 ** fan_bits buckets, whose lists are joined by groups of batches, sorted, and dealt again.
    A number costs a few bytes in either step, however many buckets there are. Only the number of
    batches of each task comes to the driver, and only for two steps.
    """
    n = shuffle_partitions(packed.sparkSession)
    first = min(bucket_bits, fan_bits)
    second = bucket_bits - first
    low_bits = hash_bits - bucket_bits
    base: dict[int, int] = {}
    if second:
        total = 0
        for part, k in sorted(tuple(r) for r in packed.groupBy(F.shiftright("batch", 32)).count().collect()):
            base[part], total = total, total + k

    def dense(batch: int) -> int:
        return base[batch >> 32] + (batch & 0xFFFFFFFF) if second else batch

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                short, low = hashes(blob), np.uint64((1 << (hash_bits - first)) - 1)
                dealt = list(deal(short, hash_bits - first, first))
                for a in range(0, len(dealt), 256):
                    some = dealt[a : a + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in some], pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array([dense(number)] * len(some), pa.int64()), pa.array([pack_steps(short[x:y] & low) for _, x, y in some], pa.binary())], ["bucket", "batch", "place", "data"])

    def regroup(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        lists = [unpack_steps(x) for x in table.column("data").to_pylist()]
        names = table.column("batch").to_pylist()
        number, owner = _sorted_with_owner(lists, [np.full(len(x), i) for i, x in enumerate(lists)], hash_bits - first)
        dealt = list(deal(number, low_bits, second))
        low = number & np.uint64((1 << low_bits) - 1)
        owner = owner.astype(np.uint16)
        return pa.table({"bucket": pa.array([(bucket << second) | b for b, _, _ in dealt], pa.int64()), "names": pa.array([names] * len(dealt), pa.list_(pa.int64())), "owner": pa.array([owner[x:y].tobytes() for _, x, y in dealt], pa.binary()), "data": pa.array([pack_steps(low[x:y]) for _, x, y in dealt], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        """For each batch the hashes of this bucket that occur more than once."""
        bucket = table.column("bucket")[0].as_py()
        owners, names = None, []
        if second:
            owners = []
            for x, own in zip(table.column("owner").to_pylist(), table.column("names").to_pylist(), strict=True):
                owners.append(np.frombuffer(x, np.uint16).astype(np.int32) + np.int32(len(names)))
                names += own
        else:
            names = table.column("batch").to_pylist()
        number, owner = _met(table.column("data"), owners, low_bits)
        number |= np.uint64(bucket << low_bits)
        once = np.ones(len(number), bool)
        once[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
        number, owner = number[once], owner[once]
        edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, np.int64)
        times = np.diff(np.append(edge, len(number)))
        is_hot = np.repeat(times > (len(number) if hot is None else hot), times)
        order = np.argsort(owner, kind="stable")
        owner, number, is_hot = owner[order], number[order], is_hot[order]
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        cuts = list(zip(head.tolist(), np.append(head[1:], len(owner)).tolist()))
        return pa.table({"batch": pa.array([names[owner[a]] for a, _ in cuts], pa.int64()), "data": pa.array([pack_steps(number[a:b]) for a, b in cuts], pa.binary()), "hot": pa.array([number[a:b][is_hot[a:b]].tobytes() for a, b in cuts], pa.binary())})

    out = packed.mapInArrow(releasing(ask), "bucket long, batch long, place long, data binary")
    if second:
        out = out.repartition(n, "bucket", F.floor(F.col("place") / group)).groupBy("bucket", F.floor(F.col("place") / group).alias("g")).applyInArrow(releasing_group(regroup), "bucket long, names array<long>, owner binary, data binary")
    return out.repartition(n, "bucket").groupBy("bucket").applyInArrow(releasing_group(meet), "batch long, data binary, hot binary")


def pack_rows(df: DataFrame, size: int) -> DataFrame:
    """(batch, blob): ``size`` rows each of the long columns of df, row by row; dealt by batch."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = task_id(), 0, []
        rows = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | seq]), pa.array([np.concatenate(held)[:size].tobytes()], pa.binary())], ["batch", "blob"])

        for batch in batches:
            held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1))
            rows += len(batch)
            while rows >= size:
                yield flush()
                held, rows, seq = [np.concatenate(held)[size:]], rows - size, seq + 1
        if rows:
            yield flush()

    return df.mapInArrow(pack, "batch long, blob binary").repartition(shuffle_partitions(df.sparkSession), "batch")


def shared_variants(packed: DataFrame, variants: Callable[[bytes], tuple[np.ndarray, np.ndarray]], total: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(bucket, data): every variant that more than one item has, with each item that has it, as pairs of 64-bit numbers.

    variants(blob) gives a batch's variants and the item that each is of. All of a variant's pairs are in one bucket.
    """
    bucket_bits, hash_bits = bits_of(total)
    second_bits = max(2, bucket_bits)

    def short(z: np.ndarray) -> np.ndarray:
        return mix(z.copy()) >> np.uint64(64 - hash_bits)

    def hashes(blob: bytes) -> np.ndarray:
        out = variants(blob)[0]
        for a in range(0, len(out), BLOCK):
            out[a : a + BLOCK] = short(out[a : a + BLOCK])
        out.sort()
        return out

    def send(own: pa.Table, met: pa.Table) -> pa.Table:
        if not len(own) or not len(met):
            return pa.table({"bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        wanted = np.unique(np.concatenate([unpack_steps(x) for x in met.column("data").to_pylist()]))
        z, item = variants(own.column("blob")[0].as_py())
        maybe = np.zeros(1 << 20, bool)
        maybe[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        places, buckets = [], []
        for a in range(0, len(z), BLOCK):
            hashed = short(z[a : a + BLOCK])
            at = np.flatnonzero(maybe[(hashed & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[wanted[np.minimum(np.searchsorted(wanted, hashed[at]), len(wanted) - 1)] == hashed[at]]
            places.append((at + a).astype(np.uint32))
            buckets.append((hashed[at] >> np.uint64(hash_bits - second_bits)).astype(np.int32))
        at, bucket = np.concatenate(places), np.concatenate(buckets)
        del places, buckets, wanted
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        del order
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        data = [np.stack([z[at[a:b]], item[at[a:b]].astype(np.uint64)], axis=1).tobytes() for a, b in zip(head, np.append(head[1:], len(at)))]
        return pa.table({"bucket": pa.array(bucket[head]), "data": pa.array(data, pa.binary())})

    met = met_again(packed, hashes, bucket_bits, hash_bits, fan_bits=fan_bits)
    return packed.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(releasing_groups(send), "bucket int, data binary")


def variant_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, number of its variant, where each variant begins) of one bucket's pairs, in order of variant and item, each once."""
    rows = utf8(table.column("data"))[0].view(np.uint64).reshape(-1, 2)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    variant, item = rows[:, 0][order], rows[:, 1][order]
    del order
    new = np.ones(len(variant), bool)
    new[1:] = variant[1:] != variant[:-1]
    once = new.copy()
    once[1:] |= item[1:] != item[:-1]
    if not once.all():
        item, new = item[once], new[once]
    return item, np.cumsum(new) - 1, np.flatnonzero(new)
