"""Sharding: contiguous shards of near-equal bytes, cut at global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import saved, shuffle_partitions


def balanced_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal all rows to shards 0..n_shards-1 that are contiguous in id order and near equal in bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1. Rows are range partitioned
    on (id, checksum, size, row number), so that rows that repeat one id, or one whole row, can
    still be split; only ids, sizes and checksums are moved, and texts of any length are read where they are. Each partition's totals give the
    global prefix sums, and a row whose middle byte lies in the k-th of n equal parts of all
    bytes belongs to shard k: every cut is off its target by at most half a row.

    The driver sees one total per partition and one row number per shard. Null ids come first;
    repeated rows each get their own slot; an empty table gives an empty result. Columns may have any name.

    Returns id_col, size, text_crc32, law, shard, slot, grown_shard and start (bytes before the row).
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    keys = ["id", "crc", "size", "tie"]
    ranged = saved(
        rows.repartitionByRange(shuffle_partitions(spark), *keys)
        .sortWithinPartitions(*keys)
        .select("id", "size", "crc", F.spark_partition_id().alias("part"))
    )
    totals = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.sum("size"), F.count("*")).collect())
    base, size, count = {}, 0, 0
    for part, part_bytes, part_rows in totals:
        base[part] = (size, count)
        size, count = size + part_bytes, count + part_rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            part = np.asarray(batch.column(3))
            sizes = np.asarray(batch.column(1))
            start, row = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                s0, r0 = seen.get(p) or base[p]
                ends = np.cumsum(sizes[at])
                start[at] = s0 + ends - sizes[at]
                row[at] = r0 + np.arange(len(at))
                seen[p] = (s0 + int(ends[-1]), r0 + len(at))
            shard = np.minimum(n_shards - 1, (2 * start + sizes) * n_shards // (2 * size)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(shard), pa.array(row), pa.array(start)], ["id", "size", "crc", "shard", "row", "start"])

    placed = ranged.mapInArrow(place, "id long, size long, crc long, shard int, row long, start long")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    first = spark.createDataFrame([tuple(r) for r in firsts.collect()], "shard int, first long")  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start",
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 8)


def _crc_of_byte(x: int) -> int:
    for _ in range(8):
        x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
    return x


_STEP = f"xor(c >> 8, [{', '.join(str(_crc_of_byte(x)) for x in range(256))}][xor(c & 255, x) + 1])"

#: grown_shard is null under this law; frames of both engines show an all-null column alike where it is a DOUBLE.
ORACLE_OP3 = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) + 1 AS size, hex(b) AS h FROM d),
x AS (SELECT doc_id, size, list_transform(range(0, size - 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM h),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: {_STEP}), 4294967295::BIGINT) AS crc FROM x),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, crc, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(7, (2 * start + size) * 8 // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::DOUBLE AS grown_shard, start::BIGINT AS start FROM s
"""
