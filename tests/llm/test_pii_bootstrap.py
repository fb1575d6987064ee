import hashlib
import re

import pytest

from proseline.llm import pii
from tests.llm.tables import awkward, docs, prose
from tests.llm.test_text_ops import plain_spans


def brute_context(rows):
    """The bootstrapped spans by dictionaries of plain strings: {text: [(start, end)]}."""
    graph, places, met, slots = {}, [], {}, {}
    for t in {t or "" for _, t in rows}:
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        say = lambda k: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t[slice(*words[k])]) if 0 <= k < len(words) else None  # noqa: B023, E731
        base = [(a, b) for _, a, b in plain_spans(t)]
        found = [(a, b, True, True) for a, b in base]
        for a, b in words:
            core = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", t[a:b])
            if any(c in "0123456789@_" for c in core):
                x = a + t[a:b].index(core)
                y = x + len(core)
                if not any(p < y and q > x for p, q in base):
                    secret = len(core) >= 20 and bool(re.fullmatch("[A-Za-z0-9]+", core)) and bool(re.search("[0-9]", core)) and bool(re.search("[A-Za-z]", core))
                    found.append((x, y, secret, False))
        for k in range(len(words)):
            for key in ((2, say(k - 2), say(k - 1)), (0, say(k - 1), say(k + 1))):
                slots[key] = slots.get(key, 0) + sum((x or "") == t for _, x in rows)
        for x, y, known, own in found:
            i = next((k for k, (_, e) in enumerate(words) if e > x), 0)
            j = max(k for k, (s, _) in enumerate(words) if s < y)
            context = [(2, say(i - 2), say(i - 1)), (0, say(i - 1), say(j + 1)), (1, say(i - 1)), (3, say(j + 1))]
            keys = context[:2] + [(c, pii.shape(t[x:y])) for c in context]
            for key in keys[:2]:
                met[key] = met.get(key, 0) + sum((z or "") == t for _, z in rows)
            for key in keys:
                graph.setdefault(key, {})
                graph[key][t[x:y].lower()] = graph[key].get(t[x:y].lower(), False) or known
            if not own:
                places.append((t, x, y, keys))
    was = {}
    for fillers in graph.values():
        for f, known in fillers.items():
            was[f] = max(was.get(f, 0.0), float(known))
    score, trusted = dict(was), None
    while True:
        trust = {k: sum(score[f] for f in fs) / (len(fs) + pii.SMOOTHING) for k, fs in graph.items()}
        now = {k for k, fs in graph.items() if trust[k] >= pii.CONFIDENCE and sum(score[f] >= pii.CONFIDENCE for f in fs) >= pii.SUPPORT}
        if now == trusted:
            break
        trusted = now
        raised = {}
        for k in trusted:
            for f in graph[k]:
                raised[f] = raised.get(f, 1.0) * (1 - min(trust[k], 0.999))
        score = {f: max(was[f], 1 - raised.get(f, 1.0)) for f in was}
    good = {k for k in trusted if k not in met or met[k] >= pii.CONFIDENCE * slots.get(k, 0)}
    out = {}
    for t, x, y, keys in places:
        if good & set(keys):
            out.setdefault(t, set()).add((x, y))
    return out


def listed(base, context):
    names = (*pii.KINDS, "context")
    return ",".join(f"{names[k]}:{a}:{b}" for k, a, b in [*base, *((4, a, b) for a, b in sorted(context))])


def rows_of_contexts():
    rows = [(500 + i, f'{prose(i, 5)} api_key = "{hashlib.sha1(str(i).encode()).hexdigest()}"; {prose(i, 3)}') for i in range(12)]
    rows += [(100 + i, f'{prose(i, 4)} api_key = "{v}" {prose(i, 2)}') for i, v in enumerate(["s3cret", "PW9", "x_y"])]
    rows += [(200 + i, f"{prose(i, 6)} contact me at user{i}@mail{i % 3}.org now {prose(i, 3)}") for i in range(9)] + [(250, "please contact me at maria_k now")]
    rows += [(300 + i, f"{prose(i, 9)} 49293483851463{i:02d} the {prose(i, 5)} 4929348385146306 the") for i in range(30)]
    return rows + rows[:2] + awkward()


def test_context_spans_equal_brute_force(spark):
    rows = rows_of_contexts()
    want = brute_context(rows)
    out = pii.find_personal_data(docs(spark, rows).selectExpr("*", "1 as base", "2 as context", "3 as digest", "4 as k")).collect()
    text = dict(rows)
    got = {}
    for r in out:
        if r.row.doc_id is not None:
            assert {(s.start, s.end) for s in r.context} == want.get(text[r.row.doc_id] or "", set())
            got[r.row.doc_id] = [text[r.row.doc_id][s.start : s.end] for s in r.context]
    assert len(out) == len(rows)
    assert [got[100 + i] for i in range(3)] == [["s3cret"], ["PW9"], ["x_y"]] and got[250] == ["maria_k"]
    assert all(got[500 + i] == [hashlib.sha1(str(i).encode()).hexdigest()] for i in range(12))
    assert not any(got[300 + i] for i in range(30))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_query_equals_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    context = brute_context(rows)
    out = {r.doc_id: r for r in pii.op6_pii(spark, folder).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        base = plain_spans(t or "")
        r = out[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(listed(base, []).encode()).hexdigest()
        assert r.spans == listed(base, context.get(t or "", []))
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or ""):
            if sf == "sf0.01":
                assert f"context:{m.start(1)}:{m.end(1)}" in r.spans
