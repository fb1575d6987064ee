import random

import numpy as np

from proseline.llm import simhash, similarity
from proseline.llm.common import local_roots
from tests.llm.tables import docs


def sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def kept_by_brute_force(rows):
    """Least ids of the components of all pairs at 0.8 or more."""
    root = {i: i for i, _ in rows}
    have = {i: sets(t) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in have:
        for j in have:
            if i < j and 5 * len(have[i] & have[j]) >= 4 * len(have[i] | have[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if find(i) == i}


def test_keep_one_against_brute_force_jaccard(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustrnl") for _ in range(5))
    passage = " ".join(word() for _ in range(40))
    rows = [(9000, None), (9001, " "), (9002, "one two"), (9003, "One  two"), (9004, "one two three")]
    for k in range(25):
        own = [word() for _ in range(r.choice([6, 20, 60, 200]))]
        rows.append((100 * k, " ".join(own)))
        for c in range(1, 9):
            new = list(own)
            for _ in range(r.randint(1, max(1, len(own) // 30))):
                new[r.randrange(len(new))] = word()
            rows.append((100 * k + c, " ".join(new)))
        rows.append((100 * k + 9, passage + " " + " ".join(own[:8])))
    rows += [(5000 + k, " ".join(["same"] * (5 + k))) for k in range(5)]
    kept = {x.doc_id for x in simhash.keep_one(docs(spark, rows)).collect()}
    want = kept_by_brute_force(rows)
    # Ball hashing may miss a link at the very threshold, and never makes a wrong one.
    assert want <= kept and len(kept - want) <= 0.05 * (len(rows) - len(want))


def test_keep_one_takes_similar_documents_of_the_given_table(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in given.collect()]
    kept = {x.doc_id for x in simhash.keep_one(given).collect()}
    assert kept == kept_by_brute_force(rows)


def test_columns_of_any_name_and_repeated_rows(spark):
    rows = [(1, "one two three"), (1, "one two three"), (None, "four five"), (None, None), (2, "")]
    table = docs(spark, rows).selectExpr("*", "7 as __id", "8 as __digest", "9 as __lang", "doc_id as node", "array(1) as root")
    out = simhash.keep_one(table)
    assert out.columns == table.columns and {(r["__id"], r["__digest"], r["__lang"]) for r in out.collect()} == {(7, 8, 9)}
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "four five"), (1, "one two three"), (2, "")]


def test_a_group_of_near_copies_lists_no_pairs(spark, monkeypatch):
    """Copies of one text changed in 1 to 6 places: many are near, few of them similar. Everything that is written stays within a few rows a text."""
    r = random.Random(7)
    own = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        new = list(own)
        for k in r.sample(range(len(new)), 1 + i % 6):
            new[k] = f"x{r.random()}"
        rows.append((i, " ".join(new)))
    written = []

    def counted(df, keep=similarity.saved):
        out = keep(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(similarity, "saved", counted)
    monkeypatch.setattr(similarity, "PART", 20, raising=False)  # one block is cut into many parts
    kept = {x.doc_id for x in simhash.keep_one(docs(spark, rows)).collect()}
    want = kept_by_brute_force(rows)
    assert 100 < len(want) < 250 and want <= kept and len(kept - want) <= 0.05 * (len(rows) - len(want))
    assert max(written) <= 8 * len(rows)


def test_links_between_and_within_the_parts_of_a_block():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        x = base.copy()
        at = r.choice(60, r.integers(1, 12), replace=False)
        x[at] = r.integers(0, 1 << 63, len(at), dtype=np.uint64)
        sets.append(np.unique(x))
    bits = np.stack([similarity.simhash_bits(x) for x in sets]).view(np.int64)
    part = np.repeat([0, 1], 40)
    pairs = [(a, b) for a in range(80) for b in range(a + 1, 80) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    for parts in (part, part * 0):
        some = [(a, b) for a, b in pairs if parts[a] != parts[b] or not parts.any()]
        want = local_roots(80, *np.array(some).T)
        assert np.array_equal(similarity.similar_roots(sets, bits, parts), want)
