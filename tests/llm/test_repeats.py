import hashlib
import random

import numpy as np
import pytest

from proseline.llm import quality, repeats
from tests.llm.tables import awkward, docs, prose


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            if d is not None:
                least[s] = min(d, least.get(s, d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least.get(b[i : i + 50], 1 << 62) < (1 << 62 if d is None else d):
                gone[i : i + 50] = b"\x01" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append(str((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def shared_rows(seed=0):
    r = random.Random(seed)
    passages = [prose(100 + i, r.randrange(8, 60)) for i in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + 7 * i + k, r.randrange(1, 30)) for k in range(3)]
        text = " ".join([parts[0], r.choice(passages)[r.randrange(5) :], parts[1], r.choice(passages), parts[2]])
        rows.append((r.randrange(40), text))
    return rows + [(70, passages[0] * 3), (71, passages[0] * 3), (72, "ab" * 200), (73, "b" + "ab" * 30), (74, "x" * 49), (75, "x" * 49), (76, "x" * 50), (77, "y" + "x" * 50)]


@pytest.mark.parametrize("merged", [1 << 18, 300])
def test_equals_brute_force(spark, monkeypatch, merged):
    monkeypatch.setattr(repeats, "MERGED", merged)
    rows = shared_rows() + awkward()
    out = repeats.repeats(docs(spark, rows).selectExpr("*", "1 as n_bytes", "2 as row"), with_text=True).collect()
    assert sorted(str((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in out) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


@pytest.mark.parametrize("hot", [2048, 1, 0])
def test_small_blocks_and_batches(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK", 700)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 900)
    rows = shared_rows(1)
    out = repeats.repeats(docs(spark, rows)).collect()
    assert sorted(str((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256)) for r in out) == brute(rows)


def test_empty(spark):
    assert repeats.repeats(docs(spark, [])).count() == 0
    assert repeats.repeats(docs(spark, [(1, None)])).first().n_bytes == 0


def test_merged_intervals_equal_sorted_windows():
    r = random.Random(4)
    strings = ["".join(r.choice("ab") for _ in range(r.randrange(50, 77))) for _ in range(60)]
    strings += [s[3:] + "b" * 8 for s in strings[:30] if len(s) > 52]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    owner = np.array([r.randrange(20) for _ in strings])
    want = {}
    for s, o in zip(strings, owner):
        for i in range(len(s) - 49):
            want[s[i : i + 50]] = min(int(o), want.get(s[i : i + 50], 99))
    string, place, least = repeats.least_owners(data, begin, owner)
    assert len(string) == sum(len(s) - 49 for s in strings)
    assert all(want[strings[s][p : p + 50]] == o for s, p, o in zip(string, place, least))


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney by the book, in dictionaries."""
    order = quality.ORDER
    tables = {order: {}}
    for t in texts:
        b = bytes(order - 1) + t
        for i in range(len(t)):
            g = b[i : i + order]
            tables[order][g] = tables[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        tables[k] = {}
        for g in tables[k + 1]:
            tables[k][g[1:]] = tables[k].get(g[1:], 0) + 1
    cut = {k: quality.discounts(np.array([0] + [sum(1 for v in t.values() if v == c) for c in range(1, 5)])) for k, t in tables.items()}

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        lower = p(g[1:])
        same = {x: v for x, v in tables[k].items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return lower
        own = tables[k].get(g, 0)
        return (own - cut[k][min(own, 3)] + sum(cut[k][min(v, 3)] for v in same.values()) * lower) / total

    return p


def test_perplexity_equals_the_textbook(spark):
    good = [prose(i, 12) for i in range(8)]
    seen = good + ["", None, "QQ é zz", good[0], "thonx"]
    model = quality.train(docs(spark, list(enumerate(good))).select("text"))
    out = {r.row.doc_id: r for r in quality.perplexities(docs(spark, list(enumerate(seen))).selectExpr("*", "1 as surprise"), model).collect()}
    p = kneser_ney([t.encode() for t in good])
    for i, t in enumerate(seen):
        b = bytes(quality.ORDER - 1) + (t or "").encode()
        want = -sum(np.log(p(b[k : k + quality.ORDER])) for k in range(len(b) - quality.ORDER + 1))
        assert out[i].n_bytes == len((t or "").encode()) and abs(out[i].surprise - want) <= len(b) * quality.STEP


def test_junk_goes_and_clean_text_stays(spark):
    rows = [(i, prose(i, 40 + i % 50)) for i in range(300)] + [(1000 + i, "".join(random.Random(i).choice("#$%ZQX!7") for _ in range(200))) for i in range(30)]
    rows += [(None, None), (2000, ""), (None, prose(5, 30)), (299, prose(299, 89))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 250)] + [(1000, 0, 0), (None, 1, 0), (1001, 1, 0), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs(spark, rows), labels).collect()
    kept = [r.row.doc_id for r in out if r.keep]
    assert len(out) == len(rows)
    assert not any(1000 <= (i or 0) for i in kept)
    assert sum(i is not None and i < 300 for i in kept) >= 295
    odd = quality.good_documents(docs(spark, rows).selectExpr("*", "1 as keep", "2 as __id", "3 as __digest", "4 as __lang", "5 as key"), labels)
    assert odd.count() == len(kept) and odd.columns[-5:] == ["keep", "__id", "__digest", "__lang", "key"]
    everything = quality.judge(docs(spark, rows), labels.limit(0)).collect()
    assert all(r.keep == bool(r.n_bytes) for r in everything)
    assert quality.judge(docs(spark, []), labels).count() == 0


@pytest.mark.parametrize("block", [1 << 16, 700, 64])
def test_strings_hold_every_window_once(monkeypatch, block):
    import pyarrow as pa

    from proseline.llm.common import utf8

    monkeypatch.setattr(repeats, "BLOCK", block)
    texts = [t for _, t in shared_rows(2)] + ["", None, "short", "é" * 60]
    body, offsets = utf8(pa.array(texts))
    for hot in (False, True):
        w = repeats.Windows(body, offsets)
        if hot:
            w.refine(np.sort(w.anchor >> np.uint64(20)), 44)
        places = np.concatenate([np.arange(a, b + 1) for a, b in zip(w.first, w.last)])
        want = np.concatenate([np.arange(a, b - 49) for a, b in zip(offsets, offsets[1:]) if b - a >= 50])
        assert np.array_equal(np.sort(places), want)
        anchors = {}
        for a, b, anchor in zip(w.first, w.last, w.anchor):
            for p in range(a, b + 1):
                assert anchors.setdefault(body[p : p + 50].tobytes(), anchor) == anchor
