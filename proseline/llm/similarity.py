"""Near-duplicates at a Jaccard similarity of shingles, found by ball hashing of several SimHash fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.llm.common import components, local_roots, ranges, releasing, releasing_group, saved, shuffle_partitions, slices, utf8
from proseline.llm.exchange import pack_rows, shared_variants, variant_rows

#: Texts link at a similarity of OVER / UNDER or more.
OVER, UNDER = 4, 5
SEED = 42
#: SimHash bits of a text, in words of 64; fingerprints that are drawn from them, and the bits of each.
#: At the least similarity two texts differ in about 15 of 100 bits.
WORDS, FINGERPRINTS, BITS = 8, 72, 40
#: Fingerprints meet at this many differing bits or fewer: each emits its ball of half of that.
RADIUS = 2
#: Pairs that differ in more of all bits are far from similar (unrelated texts: 256 of 512) and not compared.
FAR = 150
#: A block is cut into parts of PART texts, PARTS at most, unless a part has more hashes than MOST_HASHES; two parts meet in a task.
PART, PARTS, MOST_HASHES = 64, 32, 4_000_000
#: Texts whose variants are made at once.
BATCH = 1400
#: Digests that are sent to all tasks; beyond it they are joined.
MOST_BROADCAST = 1_000_000

_CHOSEN = np.stack([np.random.default_rng([SEED, t]).permutation(64 * WORDS)[:BITS] for t in range(FINGERPRINTS)])
_BALL = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(BITS, dtype=np.uint64)])
_SALTS = np.random.default_rng(SEED).integers(1, 1 << 63, WORDS, dtype=np.uint64)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The ascending distinct hashes of all runs of so many words; a shorter text is one run, and so is an empty one."""
    import xxhash

    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *ends[: len(words) - shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(begins)))


def simhash_bits(hashes: np.ndarray) -> np.ndarray:
    """64 * WORDS bits, packed: each is set if it is in over half of the shingles' mixed hashes."""
    counts = np.zeros(64 * WORDS, np.int64)
    for a in range(0, len(hashes), 1 << 13):
        x = hashes[a : a + (1 << 13), None] ^ _SALTS
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def fingerprint_values(bits: np.ndarray) -> np.ndarray:
    """(texts, FINGERPRINTS) numbers of packed bits: which fingerprint, and its BITS bits."""
    plain = np.unpackbits(bits, axis=1, bitorder="little")
    out = np.zeros((len(bits), FINGERPRINTS, 8), np.uint8)
    out[:, :, : BITS // 8] = np.packbits(plain[:, _CHOSEN], axis=2, bitorder="little")
    return out.view("<u8")[:, :, 0] | (np.arange(FINGERPRINTS, dtype=np.uint64) << np.uint64(BITS))


def _texts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches whose last column is the text, with the texts' shingles, some at a time."""
    for whole in batches:
        for a in range(0, len(whole), 512):
            batch = whole.slice(a, 512)
            body, offsets = utf8(batch.column(batch.num_columns - 1))
            at, data = offsets.tolist(), memoryview(body)
            yield batch, [shingles(bytes(data[x:y]), shingle) for x, y in zip(at, at[1:])]


def ties(items: DataFrame, ball: np.ndarray) -> DataFrame:
    """(a, b): ties that connect all items (item, words) that share a variant, each fingerprint changed by the masks of ``ball``.

    A bucket emits a tie for an item and component of its own, so no list of pairs arises. Rows of one item count as one.
    """
    packed = saved(pack_rows(items, BATCH))
    total = (packed.agg(F.sum(F.octet_length("blob"))).first()[0] or 0) // (8 * (1 + WORDS)) * FINGERPRINTS * len(_BALL)  # few numbers are dealt as widely as many

    def variants(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(blob, np.int64).reshape(-1, 1 + WORDS)
        values = fingerprint_values(np.ascontiguousarray(rows[:, 1:]).view(np.uint8))
        return (ball[:, None] ^ values.ravel()).ravel(), np.tile(np.repeat(rows[:, 0], FINGERPRINTS), len(ball))

    def tie(table: pa.Table) -> pa.Table:
        item, variant, begin = variant_rows(table)
        nodes = np.unique(item)
        own = np.searchsorted(nodes, item).astype(np.int32)
        least = own[begin][variant]
        del item, variant, begin
        other = own != least
        once = np.unique(own[other].astype(np.int64) * len(nodes) + least[other])  # two items often share many variants
        root = nodes[local_roots(len(nodes), once // len(nodes), once % len(nodes))] if len(nodes) else nodes
        tied = nodes != root
        return pa.table({"a": pa.array(nodes[tied].view(np.int64)), "b": pa.array(root[tied].view(np.int64))})

    return shared_variants(packed, variants, total).groupBy("bucket").applyInArrow(releasing_group(tie), "a long, b long")


def blocks(nodes: DataFrame) -> DataFrame:
    """(node, block): the nodes that reach others by shared variants, with the same number for all that reach each other.

    Equal fingerprints come first, as they are few to send. What they connect goes under one number into
    the balls, so that a group of near copies is not met again at each of its variants.
    """
    words = [f"w{k}" for k in range(WORDS)]
    alike = saved(components(ties(nodes.select("node", *words), _BALL[:1])))
    named = saved(nodes.join(alike, "node", "left").select("node", F.coalesce("component", "node").alias("name"), F.col("component").isNotNull().alias("alike"), *words))
    joined = saved(components(ties(named.select("name", *words), _BALL))).select(F.col("node").alias("name"), "component")
    return named.join(joined, "name", "left").where("alike or component is not null").select("node", F.coalesce("component", "name").alias("block"))


def tiles(members: DataFrame, parallel: int) -> DataFrame:
    """The rows of members (node, block, n), dealt so that any two of one block meet in one tile: with tile, i, j and part.

    A block is cut into parts, and a tile has two of them, or one. So a row has at most PARTS copies,
    unless that many parts of a block are too long for a task. Blocks of one part share tiles.
    """
    size = members.groupBy("block").agg(F.greatest(F.least(F.lit(PARTS), F.ceil(F.count("*") / PART)), F.ceil(F.sum("n") / MOST_HASHES)).alias("parts"))
    cut = members.join(size, "block").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    return met.withColumn("tile", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("block"), F.lit(parallel).cast("long"))).otherwise(F.xxhash64("block", "i", "j"))).drop("parts", "other")


def similar_roots(sets: list[np.ndarray], bits: np.ndarray, part: np.ndarray) -> np.ndarray:
    """For each set the first of those that it reaches by links; if there are two parts, by links between them.

    Pairs that are connected already are not compared.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    begin = np.cumsum(n) - n
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root = np.zeros(len(distinct), bool), np.arange(len(sets))
    bits = np.ascontiguousarray(bits).view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    two = part.min() != part.max()
    for x in range(len(sets) - 1):
        y = x + 1 + np.flatnonzero(root[x + 1 :] != root[x])
        if two:
            y = y[part[y] != part[x]]
        y = y[np.minimum(n[y], n[x]) * UNDER >= np.maximum(n[y], n[x]) * OVER]
        y = y[np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64) <= FAR]
        if not len(y):
            continue
        own = ids[begin[x] : begin[x] + n[x]]
        mark[own] = True
        for a, b in slices(np.concatenate([[0], np.cumsum(n[y])]), 1 << 21):
            some = y[a:b]
            at = np.repeat(begin[some], n[some]) + ranges(n[some])
            common = np.add.reduceat(mark[ids[at]], np.cumsum(n[some]) - n[some], dtype=np.int64)
            good = some[common * UNDER >= (n[some] + n[x] - common) * OVER]
            if len(good):
                met = np.unique(root[np.append(good, x)])
                root[np.isin(root, met)] = met[0]
        mark[own] = False
    return root


def links_of_tile(table: pa.Table) -> pa.Table:
    """(a, b): ties that connect the nodes of each of a tile's blocks as their links do; a tie for a node at most."""
    block, i, j, part, node = (np.asarray(table.column(c)) for c in ("block", "i", "j", "part", "node"))
    bits = np.stack([np.asarray(table.column(f"w{k}")) for k in range(WORDS)], axis=1)
    hashes = table.column("hashes").to_pylist()
    order = np.lexsort((node, part, j, i, block))
    key = np.stack([block, i, j], axis=1)[order]
    cuts = np.append(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]), len(order))
    a, b = [node[:0]], [node[:0]]
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = order[x:y]
        root = similar_roots([np.frombuffer(hashes[k], np.uint64) for k in rows.tolist()], bits[rows], part[rows])
        tied = root != np.arange(len(rows))
        a.append(node[rows[tied]])
        b.append(node[rows[root[tied]]])
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def similar_texts(docs: DataFrame, text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(digest, root): the texts that are linked to others, by MD5 digest, with one name for all that reach each other.

    Texts link if the Jaccard similarity of their sets of word shingles is OVER / UNDER or more. Each
    distinct text has FINGERPRINTS fingerprints of BITS bits, drawn from its SimHash bits, and emits each one's
    ball of RADIUS / 2; texts that reach each other by shared variants are a block. Within a block every
    text is compared with every other, in tiles, unless the two are connected already: most of those that are
    not similar are told by all bits together, the others by their whole sets. Pairs are never listed.
    """
    spark = docs.sparkSession
    texts = docs.select(F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))).alias("digest"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    new.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(d)
            for some, sets in _texts(iter([batch.take(pa.array(new, pa.int64()))]), shingle):
                bits = np.stack([simhash_bits(x) for x in sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in sets], pa.int32()), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS))], ["digest", "n", *(f"w{k}" for k in range(WORDS))])

    signed = texts.mapInArrow(releasing(sign), "digest binary, n int, " + ", ".join(f"w{k} long" for k in range(WORDS)))
    nodes = saved(signed.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", *(f"w{k}" for k in range(WORDS))))))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # of written rows: the same whenever it is asked for

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _texts(batches, shingle):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"])

    members = saved(nodes.join(blocks(nodes), "node"))
    small = members.count() <= MOST_BROADCAST
    wanted = members.select("node", "digest")
    one_each = texts.join(F.broadcast(wanted) if small else wanted, "digest").select("node", "text").mapInArrow(releasing(whole), "node long, hashes binary")
    sets = one_each.groupBy("node").agg(F.first("hashes").alias("hashes"))
    met = tiles(members.drop("digest").join(sets, "node"), 4 * shuffle_partitions(spark))
    links = saved(met.groupBy("tile").applyInArrow(releasing_group(links_of_tile), "a long, b long"))
    tied = saved(components(links))
    digest = nodes.select("node", "digest")
    named = digest.join(tied.select("component").distinct().withColumnRenamed("component", "node"), "node").select(F.col("node").alias("component"), F.col("digest").alias("root"))
    return digest.join(tied, "node").join(named, "component").select("digest", "root")
