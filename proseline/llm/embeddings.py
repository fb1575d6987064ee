"""Embedding near-duplicates by lattice hashing with the E8 lattice."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import components, local_roots, mix, saved, shuffle_partitions

THRESHOLD = 0.93
#: Tables, cells probed beside a vector's own, and how far apart (in the lattice, whose points are
#: sqrt(2) apart) two vectors at the threshold lie in the mean.
TABLES, PROBES, SPREAD = 10, 2, 0.6
#: Distinct vectors that one E8 block of a key is enough for; more vectors take more blocks and tables.
ONE_BLOCK = 1_000_000
#: Members of a cell that one task compares with as many; rows that a task holds.
TILE, ROWS = 2048, 16_384
#: Hot cells up to this number are sent to all tasks; beyond it they are joined.
MOST_BROADCAST = 100_000


def _least_vectors() -> np.ndarray:
    """The 240 vectors of E8 next to zero, doubled."""
    pairs = [[2 * s if k == i else 2 * t if k == j else 0 for k in range(8)] for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    halves = [x for x in product((1, -1), repeat=8) if x.count(-1) % 2 == 0]
    return np.array([*pairs, *halves], np.int64)


_LEAST = _least_vectors()


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The point of E8 next to each row of x, doubled (all whole numbers)."""

    def d8(y: np.ndarray) -> np.ndarray:
        out = np.rint(y)
        off = y - out
        odd = np.flatnonzero(out.sum(axis=1) % 2 != 0)
        worst = np.abs(off[odd]).argmax(axis=1)
        out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return out

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def signatures(x: np.ndarray, tables: int, blocks: int, probes: int, threshold: float) -> np.ndarray:
    """(vectors, tables, 1 + probes) cell numbers: the cell of each unit row of x, and those next to it.

    A table projects onto ``blocks`` sets of 8 directions and decodes each to E8. The cells
    probed are those whose point, one least lattice vector away in one block, is nearest.
    """
    n, dim = x.shape
    scale = SPREAD / (math.sqrt(2 - 2 * threshold) * math.sqrt(8 / max(dim, 8)))
    out = np.empty((n, tables, 1 + probes), np.uint64)
    for t in range(tables):
        gauss = np.random.default_rng([t, dim, blocks]).standard_normal((dim, 8 * blocks))
        directions = np.linalg.qr(gauss)[0] if 8 * blocks <= dim else gauss / np.linalg.norm(gauss, axis=0)
        points = scale * (x @ directions)
        key = np.full(n, t + 1, np.uint64)
        homes, gains, steps = [], [], []
        for b in range(blocks):
            p = points[:, 8 * b : 8 * b + 8]
            home = nearest_e8(p)
            gain = (p - home / 2) @ _LEAST.T
            best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
            homes.append(home)
            gains.append(np.take_along_axis(gain, best, axis=1))
            steps.append(best)
        block_keys = [_hash(h) for h in homes]
        for b in block_keys:
            key = mix(key * np.uint64(31) + b)
        out[:, t, 0] = key
        gain, step = np.concatenate(gains, axis=1), np.concatenate(steps, axis=1)
        best = np.argsort(-gain, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            block, vector = best[:, k] // probes, step[np.arange(n), best[:, k]]
            key = np.full(n, t + 1, np.uint64)
            for b in range(blocks):
                moved = _hash(homes[b] + _LEAST[vector])
                key = mix(key * np.uint64(31) + np.where(block == b, moved, block_keys[b]))
            out[:, t, 1 + k] = key
    return (out >> np.uint64(33)).astype(np.int32)


def tables_for(blocks: int) -> int:
    """More blocks tell more cells apart, and so part more pairs: more tables make up for it."""
    return math.ceil(TABLES * 2.5 ** (blocks - 1))


def _hash(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.uint64)
    for column in points.T:
        out = mix(out * np.uint64(1_000_003) + column.astype(np.uint64))
    return out


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) for each length of vector."""
    sizes = np.asarray(column.value_lengths())
    found = []
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        x = np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(-1, dim)
        found.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return found


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """Links between vectors of one label whose cosine, in double precision, is at least ``threshold``.

    Equal vectors of a label are one node that counts its copies. Every node goes to its own
    cell in each table and asks in the cells next to it; those that meet are verified by their
    cosine. A pair that meets in several places is counted at the first of them only, which
    both vectors' cell numbers tell; so no pairs are listed or shuffled: a task returns each
    node's number of links and a tie to the least node it is connected with there. The members
    of a cell above TILE are dealt to tiles, and each task compares two tiles.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those
    without a label, link with nothing. Vectors of different length do not link. Null ids take
    part and name a component only where all of its ids are null; repeated rows are each counted. An empty
    table gives no rows; other columns, of any name, take no part.

    Returns id_col, n_links (other vectors linked), component_id (least id reachable, itself included), kept.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    nodes = saved(rows.where("usable").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least")))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # of written rows: the same whenever it is asked for
    n_nodes = nodes.count()
    blocks = 1 if n_nodes <= ONE_BLOCK else 1 + math.ceil(math.log(n_nodes / ONE_BLOCK) / math.log(200))
    tables = tables_for(blocks)
    wide = dict(rows.dtypes)["v"] == "array<double>"

    def cells(batches: Iterator[pa.RecordBatch], only_counts: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch = whole.slice(a, 1024)
                labels = label_numbers(batch.column(0))
                for at, x in _unit(batch.column(1)):
                    sig = signatures(x, tables, blocks, PROBES, threshold)
                    base = mix(labels[at] * np.uint64(31) + np.uint64(x.shape[1]))
                    cell = mix((base[:, None, None] * np.uint64(31) + np.arange(tables, dtype=np.uint64)[None, :, None]) * np.uint64(0x9E3779B97F4A7C15) + sig.astype(np.uint32)).view(np.int64)
                    if only_counts:
                        one, n = np.unique(cell, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n)], ["cell", "n"])
                        continue
                    take = np.repeat(np.arange(len(at)), tables * (1 + PROBES))
                    raw = x.astype(np.float64 if wide else np.float32)
                    source = batch.column(1).take(pa.array(at)).flatten()
                    raw = np.asarray(source, raw.dtype).reshape(len(at), -1)
                    vectors, sigs = pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())
                    index = pa.array(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(cell.ravel()),
                            pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + PROBES), len(at))),
                            pa.array(np.tile(np.arange(1 + PROBES) == 0, len(at) * tables)),
                            batch.column(3).take(pa.array(at)).take(index),
                            batch.column(2).take(pa.array(at)).take(index),
                            vectors.take(index),
                            sigs.take(index),
                        ],
                        ["cell", "t", "home", "node", "copies", "vector", "sig"],
                    )

    source = nodes.select("label", "v", "copies", "node")
    counts = source.mapInArrow(lambda b: cells(b, True), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    hot = saved(counts.where(F.col("n") > TILE).select("cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))
    members = source.mapInArrow(lambda b: cells(b, False), "cell long, t int, home boolean, node long, copies long, vector binary, sig binary")
    n_hot = hot.count()
    if n_hot:
        members = members.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, "cell", "left")
        own, every = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"), F.sequence(F.lit(0), F.col("tiles") - 1)
        asks = F.transform(every, lambda k: F.struct(own.alias("i"), k.alias("j"), F.lit(True).alias("asks"), (F.col("home") & (k == own)).alias("answers")))
        answers = F.transform(F.filter(every, lambda k: F.col("home") & (k != own)), lambda k: F.struct(k.alias("i"), own.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers")))
        single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("asks"), F.col("home").alias("answers")))
        members = members.withColumn("x", F.explode(F.when(F.col("tiles").isNull(), single).otherwise(F.concat(asks, answers))))
        members = members.select("cell", "t", "node", "copies", "vector", "sig", "x.i", "x.j", "x.asks", "x.answers")
    else:
        members = members.select("cell", "t", "node", "copies", "vector", "sig", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("asks"), F.col("home").alias("answers"))
    buckets = max(shuffle_partitions(spark), n_nodes * tables * (1 + PROBES) // ROWS)
    place = F.xxhash64("cell", "i", "j")
    members = members.withColumn("bucket", F.pmod(place, F.lit(buckets)).cast("int")).withColumn("place", place)
    dtype = np.float64 if wide else np.float32

    def compare(table: pa.Table) -> pa.Table:
        place, node, copies = (table.column(c).to_numpy() for c in ("place", "node", "copies"))
        width = np.array([len(v) for v in table.column("vector").to_pylist()])
        order = np.lexsort((width, place))
        cuts = np.flatnonzero(np.r_[True, (np.diff(place[order]) != 0) | (np.diff(width[order]) != 0), True])
        asks, answers, t = (table.column(c).to_numpy() for c in ("asks", "answers", "t"))
        vectors, sigs = table.column("vector").combine_chunks(), table.column("sig").combine_chunks()
        links = np.zeros(len(node), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(cuts, cuts[1:]):
            run = order[a:b]
            q, i = run[asks[run]], run[answers[run]]
            if not len(i) or len(run) < 2:
                continue
            xq, xi = (_rows(vectors, k, dtype).astype(np.float64) for k in (q, i))
            xq /= np.linalg.norm(xq, axis=1, keepdims=True)
            xi /= np.linalg.norm(xi, axis=1, keepdims=True)
            sq, si = (_rows(sigs, k, np.int32).reshape(-1, tables, 1 + PROBES) for k in (q, i))
            for c in range(0, len(q), 512):
                near = xq[c : c + 512] @ xi.T >= threshold
                near &= node[q[c : c + 512]][:, None] != node[i][None, :]
                u, v = np.nonzero(near)
                u += c
                if not len(u):
                    continue
                ends.append((q[u], i[v]))
                both = (sq[u, t[q[0]], :1] == si[v, t[q[0]]]).any(axis=1)
                first = ~both | (node[q[u]] < node[i[v]])
                u, v = u[first], v[first]
                for k in range(int(t[q[0]])):
                    met = (si[v, k, :1] == sq[u, k]).any(axis=1) | (sq[u, k, :1] == si[v, k]).any(axis=1)
                    u, v = u[~met], v[~met]
                np.add.at(links, q[u], copies[i[v]])
                np.add.at(links, i[v], copies[q[u]])
        if not ends:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        u, v = (np.concatenate(x) for x in zip(*ends))
        names, number = np.unique(node, return_inverse=True)
        root = names[local_roots(len(names), number[u], number[v])]
        n = np.bincount(number, weights=links, minlength=len(names)).astype(np.int64)
        some = np.zeros(len(names), bool)
        some[number[u]] = some[number[v]] = True
        return pa.table({"node": names[some], "n": n[some], "root": root[some]})

    met = saved(members.groupBy("bucket").applyInArrow(compare, "node long, n long, root long"))
    n_links = met.groupBy("node").agg(F.sum("n").alias("n"))
    tied = components(met, "node", "root").select("node", F.col("component").alias("root"))
    named = nodes.join(n_links, "node", "left").join(tied, "node", "left").select("label", "v", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.col("n")).alias("n_links"), "component")
    found = rows.where("usable").join(known, ["label", "v"]).select("id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast("long").alias("component_id"), F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def label_numbers(labels: pa.Array) -> np.ndarray:
    """A number for each label, of whatever type: 64 bits, as two labels of one number would be compared."""
    values = labels.to_pylist()
    known = {x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") for x in set(values)}
    return np.array([known[x] for x in values], np.uint64)


def _rows(column: pa.Array, at: np.ndarray, dtype: type) -> np.ndarray:
    """Equally long binary values as the rows of a matrix."""
    data = b"".join(column.take(pa.array(at)).to_pylist())
    return np.frombuffer(data, dtype).reshape(len(at), -1)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_OP10 = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS k FROM embeddings
), u AS (
  SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b, b.vec_id AS other FROM u AS a JOIN u AS b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}
), r AS (
  SELECT k AS a, k AS b FROM e UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), c AS (
  SELECT r.a AS k, min(e.vec_id) AS component_id FROM r JOIN e ON r.b = e.k GROUP BY r.a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM e JOIN c USING (k) LEFT JOIN (SELECT a AS k, count(*) AS n FROM p GROUP BY a) AS m USING (k)
"""
