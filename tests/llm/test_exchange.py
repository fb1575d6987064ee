import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from proseline.llm import exchange


@pytest.mark.parametrize("numbers", [[], [0], [5, 5, 5], [0, 1 << 40, (1 << 62) + 3], list(range(0, 70000, 7))])
def test_steps_round_trip(numbers):
    x = np.array(numbers, np.uint64)
    assert np.array_equal(exchange.unpack_steps(exchange.pack_steps(x)), x)


@pytest.mark.parametrize("fingerprints", [200_000, 13_000_000, 1_000_000_000, 40_000_000_000])
def test_bytes_of_a_number_stay_flat(fingerprints):
    """A batch's lists, as they are at the first step of a table of so many fingerprints of 2,081 variants."""
    bucket_bits, hash_bits = exchange.bits_of(fingerprints * 2081)
    first = min(bucket_bits, exchange.FAN_BITS)
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 2048 * 2081, dtype=np.uint64) << np.uint64(1) >> np.uint64(64 - hash_bits))
    low = hashes & np.uint64((1 << (hash_bits - first)) - 1)
    size = sum(len(exchange.pack_steps(low[a:b])) + 20 for _, a, b in exchange.deal(hashes, hash_bits - first, first))
    assert size <= 6 * len(hashes)
    # The second step: one bucket's list of GROUP batches that hold as many numbers each.
    second = bucket_bits - first
    if second:
        n = max(1, (len(hashes) >> bucket_bits) * exchange.GROUP) if len(hashes) >> bucket_bits else max(1, len(hashes) * exchange.GROUP >> bucket_bits)
        some = np.sort(np.random.default_rng(2).integers(0, 1 << (hash_bits - bucket_bits), n, dtype=np.uint64))
        assert len(exchange.pack_steps(some)) + 2 * n <= 7 * n + 16


@pytest.mark.parametrize(("fan_bits", "group"), [(12, 1 << 10), (2, 4), (1, 1)])
def test_numbers_met_again(spark, fan_bits, group):
    r = np.random.default_rng(3)
    table = {(part << 32) | k: np.sort(r.integers(0, 1 << 16, 300, dtype=np.uint64)) for part in (0, 3) for k in range(5)}
    every = np.concatenate(list(table.values()))
    value, times = np.unique(every, return_counts=True)
    packed = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in table.items()], "batch long, blob binary")
    rows = exchange.met_again(packed, lambda b: np.frombuffer(b, np.uint64), 5, 16, 2, fan_bits, group).collect()
    got = {k: np.sort(np.concatenate([exchange.unpack_steps(x.data) for x in rows if x.batch == k])) for k in table}
    hot = {int(h) for x in rows for h in np.frombuffer(x.hot, np.uint64)}
    for k, v in table.items():
        assert np.array_equal(got[k], np.unique(v[np.isin(v, value[times > 1])]))
    assert hot == {int(v) for v in value if sum(v in t for t in table.values()) > 2}


class _Plan:
    """Stands for a DataFrame and its session; keeps the function that is applied last."""

    def __getattr__(self, name):
        return lambda *a, **b: self

    sparkSession = conf = property(lambda self: self)
    get = staticmethod(lambda *a: "4")

    def applyInArrow(self, f, schema):
        self.f = f
        return self


def test_a_bucket_takes_little_more_memory_than_its_numbers():
    rng = np.random.default_rng(7)
    lists = [np.unique(rng.integers(0, 1 << 27, 100_000, dtype=np.uint64)) for _ in range(10)]
    plan = _Plan()
    exchange.met_again(plan, None, 3, 30)
    table = pa.table({"bucket": [2] * 10, "batch": list(range(10)), "data": pa.array([exchange.pack_steps(x) for x in lists], pa.binary())})
    tracemalloc.start()
    out = plan.f(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    number, times = np.unique(np.concatenate(lists), return_counts=True)
    assert out.column("batch").to_pylist() == list(range(10))
    for x, data in zip(lists, out.column("data").to_pylist(), strict=True):
        assert np.array_equal(exchange.unpack_steps(data), x[np.isin(x, number[times > 1])] | np.uint64(2 << 27))
    assert peak < 20 * sum(map(len, lists))  # 8 bytes are the numbers themselves


def test_variants_are_sorted_in_little_memory():
    rng = np.random.default_rng(8)
    rows = np.stack([rng.integers(0, 1 << 17, 1 << 19), rng.integers(0, 1 << 9, 1 << 19)], axis=1).astype(np.uint64)
    table = pa.table({"data": pa.array([rows[a : a + 1000].tobytes() for a in range(0, len(rows), 1000)], pa.binary())})
    tracemalloc.start()
    item, variant, begin = exchange.variant_rows(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    once = np.unique(rows, axis=0)
    assert np.array_equal(item, once[:, 1]) and np.array_equal(once[begin, 0][variant], once[:, 0])
    assert peak < 40 * len(rows)
