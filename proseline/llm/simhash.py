"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import components, local_roots, saved, utf8
from proseline.llm.exchange import pack_rows, shared_variants, variant_rows
from proseline.llm.similarity import similar_texts

#: Fingerprints link at this many differing bits or fewer; each emits its ball of half of that.
RADIUS = 4
SHINGLE, SEED = 4, 42
#: Fingerprints whose variants are made at once.
BATCH = 2048

_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: All masks of up to two bits: the ball of radius RADIUS / 2.
_BALL = np.concatenate([np.zeros(1, np.uint64), _BITS, (_BITS[:, None] | _BITS)[np.triu_indices(64, 1)]])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: bit i is set if it is in over half of the shingles' hashes. No words: zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    begins = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(begins, begins[shingle:])), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """row (a struct of df's columns without text_col) and fp (the 64 bits as a signed long)."""
    others = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = utf8(batch.column(1))
            at, data = offsets.tolist(), memoryview(body)
            fps = np.fromiter((fingerprint(bytes(data[a:b]), shingle) for a, b in zip(at, at[1:])), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["row", "fp"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) links among the distinct 64-bit numbers of fps.fp that connect all that differ in RADIUS bits or fewer.

    Two fingerprints that close share a variant, with at most RADIUS / 2 bits changed in each;
    and two that share a variant are that close. So the fingerprints at one variant are tied to
    the least of them, and no bucket lists its pairs.

    Variants are 2,081 times the fingerprints, and nearly all have one owner. So they are
    shuffled twice (see exchange): as hashes in a few bytes each, and in full where a hash was
    met more than once. A batch has BATCH fingerprints; buckets grow in number with the table, not in size.
    """
    packed = saved(pack_rows(fps.select("fp"), BATCH))
    total = (packed.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // 8 * len(_BALL)

    def ball(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All variants, one row of the ball after the other, and the fingerprint of each."""
        fp = np.frombuffer(blob, np.uint64)
        return (_BALL[:, None] ^ fp).ravel(), np.tile(fp, len(_BALL))

    def verify(table: pa.Table) -> pa.Table:
        """Ties the fingerprints at each variant to the least one; a tie per fingerprint and component is kept."""
        fp, variant, begin = variant_rows(table)
        least = fp[begin][variant]
        near = (fp != least) & (np.bitwise_count(fp ^ least) <= RADIUS)
        nodes, ends = np.unique(np.concatenate([fp[near], least[near]]), return_inverse=True)
        half = len(ends) // 2
        root = nodes[local_roots(len(nodes), ends[:half], ends[half:])] if half else nodes
        tie = nodes != root
        return pa.table({"a": pa.array(nodes[tie].view(np.int64)), "b": pa.array(root[tie].view(np.int64))})

    return shared_variants(packed, ball, total).groupBy("bucket").applyInArrow(verify, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """row, fp and component (the least id reachable through links, itself included) for each document.

    Documents of one fingerprint are one node, so groups of copies cost no more than one of them.
    Null and empty texts, and those of white space, have fingerprint zero and link like any other;
    null ids take part but name a component only where all of its ids are null; repeated rows are each reported.
    """
    docs = saved(fingerprints(df, text_col, shingle))
    nodes = saved(docs.groupBy("fp").agg(F.min(F.col(f"row.`{id_col}`")).alias("least")))
    tied = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = nodes.join(tied, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return docs.join(rooted.join(named, "root").select("fp", "component"), "fp").select("row", "fp", "component")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One document of each group of similar texts, with all of its columns: that of the least id.

    Texts are similar at a Jaccard similarity of 0.8 or more of their shingles; candidates come
    from ball hashing of several fingerprints, and every link is confirmed by the whole sets (see
    similar_texts()). Texts without words are one group.

    Null ids come after all others. Ties (null or repeated ids) are broken by the text's digest; of rows
    that are equal in id and text one stays, the same whatever the split into tasks: that of the
    least values of its other columns that can be ordered. An empty table stays empty; a column may have any name.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    tied = similar_texts(docs.select(text.alias("text")), "text", shingle)
    name = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("digest"))
    first = rows.select("id", "digest").join(tied, "digest", "left").groupBy(F.coalesce("root", "digest").alias("root")).agg(F.min(name).alias("x"))
    kept = first.select(F.col("x.id").alias("kept_id"), F.col("x.digest").alias("kept_digest"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))
    others = [f"row.`{c}`" for c, t in docs.dtypes if c not in (id_col, text_col) and not t.startswith("map")]
    found = rows.join(kept, same, "left_semi").groupBy("id", "digest")
    least = F.min_by("row", F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(others)))) if others else F.first("row")
    return found.agg(least.alias("row")).select("row.*")
