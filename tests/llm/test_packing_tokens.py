import random
from collections import Counter

import corpus_pipeline
from proseline.llm import packing
from tests.llm.tables import awkward, docs


def check(rows, out):
    """Pieces cover the encoded ids of each text and its end id, and no bin holds more than its capacity."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = Counter((i, len(encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    ends = Counter()
    fill, capacity = Counter(), {}
    for x in out:
        ends[x.doc_id] += x.length
        fill[x.bin_id] += x.length
        capacity[x.bin_id] = x.bin_capacity
    totals = Counter()
    for (i, n), k in want.items():
        totals[i] += n * k
    assert ends == totals
    assert all(fill[b] <= capacity[b] <= max(packing.CAPACITIES) for b in fill)


def test_op2_packs_encoded_lengths(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check([tuple(x) for x in given], packing.op2_best_fit_packing(spark, sf).collect())


def test_last_stage_packs_encoded_lengths(spark, sf):
    rows = awkward()
    check(rows, corpus_pipeline.packing_stage(spark, docs(spark, rows), sf).collect())


def test_sequences_hold_the_encoded_ids_whatever_the_split(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    rows = awkward()
    want = Counter((i, (*encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    seen = []
    for parts in (1, 7):
        out = packing.pack_texts(docs(spark, rows).selectExpr("*", "1 as piece", "2 as ids").repartition(parts)).collect()
        by_bin, by_doc = {}, {}
        for x in out:
            assert len(x.ids) == x.length
            by_bin.setdefault(x.bin_id, []).append(x)
            by_doc.setdefault(x.doc_id, []).append(x)
        for xs in by_bin.values():
            xs.sort(key=lambda x: x.slot)
            assert [x.slot for x in xs] == list(range(len(xs))) and [x.bin_start for x in xs] == [sum(y.length for y in xs[:i]) for i in range(len(xs))]
            assert sum(x.length for x in xs) == xs[0].bin_fill <= xs[0].bin_capacity
        for (i, ids), k in want.items():
            if sum(v for (j, _), v in want.items() if j == i) == 1:
                assert [t for x in sorted(by_doc[i], key=lambda x: x.piece) for t in x.ids] == list(ids) and k == 1
        seen.append(sorted((x.bin_id, x.slot, x.doc_id or -1, x.piece, tuple(x.ids)) for x in out))
    assert seen[0] == seen[1]


def test_lengths_are_packed_alike_whatever_the_split(spark):
    r = random.Random(8)
    rows = [(r.choice([None, *range(300)]), r.choice([None, 0, 100, r.randrange(20_000)])) for _ in range(900)]
    outs = [sorted(map(str, packing.pack(spark.createDataFrame(some, "doc_id long, n long").repartition(k), "n", block=100).collect())) for some, k in ((rows, 1), (rows[::-1], 5))]
    assert outs[0] == outs[1]


def optimum(lengths, sizes):
    """The least cost of all ways to part the pieces into bins."""

    def ways(left):
        if not left:
            yield []
            return
        for mask in range(1 << (len(left) - 1)):
            one = [left[0]] + [x for i, x in enumerate(left[1:]) if mask >> i & 1]
            if sum(one) <= sizes.all[-1]:
                for rest in ways([x for i, x in enumerate(left[1:]) if not mask >> i & 1]):
                    yield [one, *rest]

    return min(sum(sizes.cost[sizes.final(sum(b))] for b in w) for w in ways(lengths))


def test_cost_against_the_optimum():
    r = random.Random(6)
    ratios = []
    costs = (packing.sequence_cost, lambda c: c + 32, lambda c: {16: 30, 32: 25, 64: 70}.get(c, 0))
    for k in range(60):
        cost = costs[k % 3]
        sizes = packing.Sizes((16, 32, 64) if k % 3 == 2 else (512, 1024, 2048), cost)
        lengths = [r.randrange(1, sizes.all[-1]) for _ in range(r.randrange(1, 8))]
        of, final = packing.pack_lengths(lengths, sizes)
        fill = Counter()
        for b, n in zip(of, lengths):
            fill[b] += n
        assert all(fill[b] <= final[b] == sizes.final(fill[b]) for b in fill)
        ratios.append(sum(cost(c) for c in final) / optimum(lengths, sizes))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.06
    # A size that costs less than a smaller one is opened, and kept when bins are downsized.
    assert packing.pack_lengths([10, 12], packing.Sizes((16, 32, 64), costs[2]))[1].tolist() == [32]
