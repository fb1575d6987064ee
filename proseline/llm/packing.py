"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import saved, shuffle_partitions
from proseline.llm.tokens import TokenFiles, mapped, write_tokens

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Documents, and tokens, that are packed together: blocks are cut by the order of ids, whatever the split into tasks.
BLOCK, BLOCK_TOKENS = 50_000, 16 << 20
#: Sequences of one Arrow batch.
EMITTED = 64

Cost = Callable[[int], float]


def sequence_cost(capacity: int) -> float:
    """What a sequence costs, in tokens: its own, what any sequence costs besides, and its attention's share."""
    return 32 + capacity + capacity * capacity / 32768


class Sizes:
    """The permitted capacities with the least-cost one for every fill."""

    def __init__(self, capacities: Sequence[int], cost: Cost):
        self.all = sorted(set(map(int, capacities)))
        if not self.all or self.all[0] < 1:
            raise ValueError("capacities must be positive")
        self.cost = {c: float(cost(c)) for c in self.all}
        #: Capacity -> the one of least cost among it and the larger ones: costs need not grow with capacities.
        self.cheapest = {c: min((d for d in self.all if d >= c), key=lambda d: (self.cost[d], d)) for c in self.all}

    def final(self, fill: int) -> int:
        return self.cheapest[next(c for c in self.all if c >= fill)]


def best_fit(lengths: list[int], sizes: Sizes, least: int, by_token: bool) -> tuple[list[int], list[int], float]:
    """Best-fit decreasing; a piece that no open bin holds opens the least-cost size of at least ``least`` that holds it.

    The cost is the sequence's own, or (by_token) that of each token it will hold: all of it where enough
    pieces are still to come, else what is left. Returns each piece's bin, each bin's final
    (downsized) capacity, and the whole cost.
    """
    free: list[list[int]] = [[] for _ in range(sizes.all[-1] + 1)]
    mask, room, of = 0, [], [0] * len(lengths)
    left_over = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if fits := mask >> n:
            left = n + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                mask &= ~(1 << left)
        else:
            best = None
            for c in sizes.all:
                if c >= n and (c >= least or c == sizes.all[-1]):
                    fill = min(c, left_over)
                    price = sizes.cost[sizes.final(fill)] / fill if by_token else sizes.cost[c]
                    if best is None or price < best[0]:
                        best = price, c
            left, b = best[1], len(room)
            room.append(0)
        of[i] = b
        room[b] += n
        left -= n
        left_over -= n
        if left:
            free[left].append(b)
            mask |= 1 << left
    final = [sizes.final(f) for f in room]
    return of, final, sum(sizes.cost[c] for c in final)


def pack_lengths(lengths: Sequence[int], sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Sizes are optimised jointly: every least size to open is tried with either price, the cheapest outcome stays."""
    lengths = [int(n) for n in lengths]
    of, final, _ = min((best_fit(lengths, sizes, c, by_token) for c in sizes.all for by_token in (True, False)), key=lambda x: x[2])
    return np.array(of, np.int64), np.array(final, np.int64)


def place_pieces(n: np.ndarray, sizes: Sizes, first_bin: int) -> dict[str, np.ndarray]:
    """The pieces of documents of ``n`` tokens, by document: row, piece, start, length, bin_id (-1: none), slot, bin_start, bin_fill, bin_capacity.

    A document longer than the largest capacity is cut into pieces of that capacity, each a bin, and a rest.
    """
    largest = sizes.all[-1]
    count = np.maximum(1, -(-n // largest))
    row = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    length = np.minimum(largest, n[row] - piece * largest)
    whole, some = np.flatnonzero(length == largest), np.flatnonzero((length > 0) & (length < largest))
    of, final = pack_lengths(length[some], sizes)
    bins, capacity = np.full(len(row), -1), np.zeros(len(row), np.int64)
    bins[some], bins[whole] = of, len(final) + np.arange(len(whole))
    capacity[some], capacity[whole] = final[of] if len(some) else 0, largest
    order = np.lexsort((np.arange(len(row)), bins))
    ends, mine = np.cumsum(length[order]), bins[order]
    head = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(mine))))
    slot, at, fill = (np.zeros(len(row), np.int64) for _ in range(3))
    slot[order] = np.arange(len(mine)) - head[group]
    at[order] = ends - length[order] - (ends - length[order])[head][group]
    fill[order] = np.add.reduceat(length[order], head)[group] if len(head) else 0
    return {"row": row, "piece": piece, "start": piece * largest, "length": length, "bin_id": np.where(bins < 0, -1, first_bin + bins), "slot": slot, "bin_start": at, "bin_fill": fill, "bin_capacity": capacity}


def pack(df: DataFrame, length_col: str, id_col: str = "doc_id", capacities: Sequence[int] = CAPACITIES, cost: Cost = sequence_cost, block: int = BLOCK) -> DataFrame:
    """Pack documents of given lengths into sequences; one row for every piece of a document.

    Documents are range partitioned by (id, length), numbered by prefix sums of the partitions'
    counts, and packed ``block`` at a time (see place_pieces()). Rows of equal id and length are alike,
    so the result depends on the rows alone, not on how they are split into tasks. A bin's
    capacity is in the end the least-cost permitted one that holds its contents.

    Null or negative lengths count as 0. A document of length 0 takes up no room and has one
    piece of length 0 in no bin (bin_id null). Null ids come first; repeated rows are packed each for itself;
    an empty table gives no rows; other columns, of any name, take no part.

    Returns id_col, piece, start (in the document), length, bin_id, slot, bin_start, bin_fill, bin_capacity.
    """
    sizes = Sizes(capacities, cost)
    names = [id_col, "piece", "start", "length", "bin_id", "slot", "bin_start", "bin_fill", "bin_capacity"]
    length = F.greatest(F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(0)), F.lit(0))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), length.alias("n"), F.monotonically_increasing_id().alias("tie"))
    ranged = saved(rows.repartitionByRange(shuffle_partitions(df.sparkSession), "id", "n", "tie").sortWithinPartitions("id", "n", "tie").select("id", "n", F.monotonically_increasing_id().alias("k")))
    part = F.shiftright("k", 33)
    base, total = {}, 0
    for p, rows_there in sorted(tuple(r) for r in ranged.groupBy(part).count().collect()):
        base[p], total = total, total + rows_there

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.asarray(batch.column(2))
            position = np.array([base[p] for p in (k >> 33).tolist()], np.int64) + (k & ((1 << 33) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(position), pa.array(position // block)], ["id", "n", "position", "block"])

    def one_block(table: pa.Table) -> pa.Table:
        table = table.sort_by("position")
        places = place_pieces(table.column("n").to_numpy(), sizes, table.column("block")[0].as_py() << 36)
        none = places["length"] == 0
        ids = table.column("id").combine_chunks().take(pa.array(places.pop("row")))
        return pa.table([ids, *(pa.array(x, mask=none if name not in ("piece", "start", "length") else None) for name, x in places.items())], names=names)

    numbered = ranged.mapInArrow(number, "id long, n long, position long, block long")
    return numbered.groupBy("block").applyInArrow(one_block, f"`{id_col}` long, " + ", ".join(f"{x} long" for x in names[1:]))


def pack_tokens(files: TokenFiles, spark: SparkSession, capacities: Sequence[int] = CAPACITIES, cost: Cost = sequence_cost, block: int = BLOCK_TOKENS) -> DataFrame:
    """Sequences of the documents' token ids, read from token files.

    A block is the documents that begin in ``block`` tokens of all files; it is read from one run of
    the files, packed, and emitted sequence by sequence. So the result depends on the files' ids
    alone, no ids are shuffled, and a task holds one block's lengths and ids at most, and a
    long document's ids only where they are mapped.

    Returns bin_id, bin_capacity, bin_fill, ids (of the whole sequence) and pieces: an array, in
    order, of doc_id, piece, start (in the document's ids), length, slot, bin_start. Pieces are the documents'
    boundaries; a document's last piece ends with its end id.
    """
    sizes = Sizes(capacities, cost)
    blocks = -(-files.n_ids // block)
    piece = pa.struct([(x, pa.int64()) for x in ("doc_id", "piece", "start", "length", "slot", "bin_start")])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = list(files.documents(k * block, (k + 1) * block))
                if not found:
                    continue
                n = np.concatenate([x[4] for x in found])
                docs, nulls = (np.concatenate([x[i] for x in found]) for i in (2, 3))
                parts = [mapped(files.folder, f"ids-{part:06d}.bin", files.dtype, at, at + int(m.sum())) for part, at, _, _, m in found]
                source = np.repeat(np.arange(len(found)), [len(x[4]) for x in found])
                begin = np.concatenate([np.cumsum(x[4]) - x[4] for x in found])
                p = place_pieces(n, sizes, k << 36)
                order = np.lexsort((p["slot"], p["bin_id"]))
                head = np.flatnonzero(np.r_[True, np.diff(p["bin_id"][order]) != 0])
                cuts = np.append(head, len(order))
                for a in range(0, len(head), EMITTED):
                    some = order[cuts[a] : cuts[min(a + EMITTED, len(head))]]
                    row = p["row"][some]
                    ids = np.concatenate([parts[source[r]][begin[r] + s : begin[r] + s + m] for r, s, m in zip(row, p["start"][some], p["length"][some])]).astype(np.int32)
                    first = order[head[a : a + EMITTED]]
                    fill = p["bin_fill"][first]
                    lists = pa.StructArray.from_arrays([pa.array(docs[row], mask=nulls[row]), *(pa.array(p[x][some]) for x in ("piece", "start", "length", "slot", "bin_start"))], fields=list(piece))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(pa.array(p[x][first]) for x in ("bin_id", "bin_capacity", "bin_fill")),
                            pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(fill)].astype(np.int32)), pa.array(ids)),
                            pa.ListArray.from_arrays(pa.array((cuts[a : a + len(first) + 1] - cuts[a]).astype(np.int32)), lists),
                        ],
                        ["bin_id", "bin_capacity", "bin_fill", "ids", "pieces"],
                    )

    form = "bin_id long, bin_capacity long, bin_fill long, ids array<int>, pieces array<struct<doc_id:long,piece:long,start:long,length:long,slot:long,bin_start:long>>"
    return spark.range(0, blocks, 1, max(1, blocks)).mapInArrow(emit, form)


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts encoded as op7 writes them and packed by pack_tokens(): a row for each piece of a document, with its ids.

    A sequence is its bin's pieces in order of slot. The token files are read when the rows are, and go when the driver ends.
    Null and empty texts are one end id; null ids come
    first; repeated rows are packed each for itself; texts of any length are encoded whole and cut; an empty
    table gives no rows; other columns, of any name, take no part.
    """
    import public_tokenizers

    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), id_col=id_col, text_col=text_col)
    pieces = pack_tokens(files, docs.sparkSession).select("bin_id", "bin_capacity", "bin_fill", "ids", F.explode_outer("pieces").alias("p"))
    ids = F.slice("ids", (F.col("p.bin_start") + 1).cast("int"), F.col("p.length").cast("int"))
    return pieces.select(F.col("p.doc_id").alias(id_col), "p.piece", "p.start", "p.length", "bin_id", "p.slot", "p.bin_start", "bin_fill", "bin_capacity", ids.alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
