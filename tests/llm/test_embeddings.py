import math
import random

import numpy as np
import pytest

from proseline.llm import embeddings

NAN = float("nan")


def brute(rows, threshold=embeddings.THRESHOLD):
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = [np.asarray(v, np.float32).astype(np.float64) / np.linalg.norm(np.asarray(v, np.float32).astype(np.float64)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(str((d, links[i], least.get(root(i)), d == least.get(root(i)))) for i, (d, _, _) in enumerate(rows))


def near(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as node", "3 as cell")
    return sorted(str(tuple(r)) for r in embeddings.near_vectors(df).collect())


def vectors(seed=1):
    r = random.Random(seed)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = [r.gauss(0, 1) for _ in range(16)]
            for _ in range(r.randrange(1, 6)):
                rows.append((k, [x + r.gauss(0, 0.2) for x in centre], label))
                k += 1
        rows.append((k, rows[-1][1], label))
        k += 1
    odd = [None, [], [0.0] * 16, [NAN] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.01], [1.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0][1], 0), (None, None, 0), (2, rows[2][1], 0), (2, rows[2][1], 0)]
    return rows


@pytest.mark.parametrize("tile", [2048, 5])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = vectors()
    assert near(spark, rows) == brute(rows)


def test_a_dense_group_with_tiles(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 20)
    r = random.Random(2)
    centre = [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, [x + r.gauss(0, 0.15) for x in centre], 7) for i in range(90)]
    assert near(spark, rows) == brute(rows)


def test_more_blocks_and_tables(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "ONE_BLOCK", 30)
    rows = vectors(3)
    assert near(spark, rows) == brute(rows)


def test_empty(spark):
    assert near(spark, []) == []


def test_nearest_point_is_the_nearest():
    r = np.random.default_rng(0)
    x = r.uniform(-0.6, 0.6, (500, 8))
    points = np.concatenate([np.zeros((1, 8)), embeddings._LEAST / 2])
    two = (points[:, None] + points[None]).reshape(-1, 8)
    best = ((x[:, None] - two[None]) ** 2).sum(axis=2).min(axis=1)
    found = embeddings.nearest_e8(x) / 2
    assert np.allclose(((x - found) ** 2).sum(axis=1), best)
    assert np.allclose(found.sum(axis=1) % 2, 0)


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for blocks in (1, 2, 3):
        a, b = (embeddings.signatures(v, embeddings.tables_for(blocks), blocks, embeddings.PROBES, 0.93) for v in (x, y))
        met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
        assert met.any(axis=1).mean() > 0.99
