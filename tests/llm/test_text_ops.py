import hashlib
import re
import zlib

import pytest

from proseline.llm import chat, decontamination, packing, pii, sharding, simhash, tokens
from tests.llm.tables import awkward, docs


def test_simhash_equals_brute_force(spark, sf):
    import xxhash

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + awkward()
    out = simhash.near_duplicates(docs(spark, rows)).collect()

    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = sorted(str((d, f, least.get(root(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))
    got = sorted(str((r.row.doc_id, r.fp & (1 << 64) - 1, r.component)) for r in out)
    assert got == want
    assert len({r.component for r in out}) < len({r.fp for r in out})  # some fingerprints are linked


def test_links_find_every_pair_in_a_dense_ball(spark):
    import random

    r = random.Random(5)
    centre = r.getrandbits(64)
    numbers = {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(300)}
    chain = [centre]
    for _ in range(12):  # each four bits from the one before, far from the others
        chain.append(chain[-1] ^ sum(1 << b for b in r.sample(range(64), 4)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in numbers | set(chain)]
    from proseline.llm.common import components

    out = {r.node: r.component for r in components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    values = [x for (x,) in signed]
    for x in values:
        for y in values:
            if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
                assert out[x] == out[y]
    assert len({out[x] for x in out}) == 1 and all(abs(x) < 1 << 63 for x in out)


def test_simhash_of_an_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    kept = simhash.keep_one(docs(spark, awkward()).selectExpr("*", "1 as component", "2 as fp", "3 as row"))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns[-3:] == ["component", "fp", "row"]
    assert ids.count(4) == 1 and 5 not in ids and 6 not in ids
    assert sum(10 <= (i or 0) for i in ids) <= 9 * 4 + 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a@b.c, x@@y.z .@a.b a@b c@d.e.", "email:0:5,email:9:11"),
        ("1.2.3.4.5.6.7.8 256.1.1.1 007.08.9.255", None),
        ("4465758382889437 4465758382889437", ""),
    ],
)
def test_base_spans_equal_the_plain_patterns(text, want):
    assert pii.base_spans(text) == plain_spans(text)


def plain_spans(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(n - 9 if n > 9 else n for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_on_random_strings():
    import random

    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice("aB1290@@..-- +()_%é\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 300_000 + "@" * 3) == []
    assert pii.base_spans("1" * 300_000) == []


def test_pii_query_and_bootstrapping(spark):
    people = [(1000 + i, f"{'x y z'.split()[i % 3]} write to member mail user{i}@host{i % 7}.org today number {i}") for i in range(40)]
    hidden = [(1100 + i, f"please write to member mail handle{i}77 today") for i in range(5)]
    other = [(1200 + i, f"in the year {1900 + i} things went on") for i in range(20)]
    rows = people + hidden + other + awkward()
    out = {r.row.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect() if r.row.doc_id is not None}
    text = dict(rows)
    for i, t in rows:
        if i is not None:
            assert [tuple(s) for s in out[i].base] == plain_spans(t or "")
    assert all([text[i][s.start : s.end] for s in out[i].context] == [f"handle{i - 1100}77"] for i, _ in hidden)
    assert not any(out[i].context for i, _ in other)
    assert pii.find_personal_data(docs(spark, rows)).count() == len(rows)
    assert pii.find_personal_data(docs(spark, [])).count() == 0
    masked = {r.doc_id: r for r in pii.mask_documents(docs(spark, rows)).collect()}
    assert masked[1103].text == "please write to member mail [ID] today" and masked[1103].n_chars == len(masked[1103].text)
    assert masked[1200].text == text[1200] and "@" not in masked[1000].text and "[EMAIL]" in masked[1000].text


def test_decontamination_equals_brute_force(spark):
    bench = [(1, prose_words(0, 30)), (2, "Só few Words"), (3, ""), (None, prose_words(1, 12)), (4, None), (2, "other short"), (5, "one")]
    rows = [(i, f"x {prose_words(0, 30)} y" if i % 3 == 0 else f"{prose_words(1, 9)} SÓ, FEW... words") for i in range(12)] + [(50, prose_words(0, 14)), (51, "few words"), (52, "ONE one-two"), (53, prose_words(0, 9))] + awkward()
    got = decontamination.find_overlap(docs(spark, rows).selectExpr("*", "1 as hits", "2 as row"), spark.createDataFrame(bench, "item_id long, text string"))
    want = sorted(str(brute(d, t, bench)) for d, t in rows)
    have = []
    for r in got.collect():
        have.append(str((r.row.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), sorted(r["items"]))))
    assert sorted(have) == want
    assert decontamination.find_overlap(docs(spark, []), spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    assert decontamination.find_overlap(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("size(hits) > 0").count() == 0


def test_a_benchmark_of_several_blocks_gives_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose_words(i, 15)) for i in range(30)], "item_id long, text string")
    table = docs(spark, [(i, f"a {prose_words(i, 15)} b {prose_words(i + 1, 11)}") for i in range(40)])
    one = decontamination.find_overlap(table, bench).select("row.doc_id", "hits", "items").collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    monkeypatch.setattr(decontamination, "HELD", 2000)
    long = spark.createDataFrame([(i, " ".join(prose_words(j, 15) for j in range(i, i + 10))) for i in range(0, 30, 10)], "item_id long, text string")
    whole = decontamination.find_overlap(table, long).select("hits", "items").collect()
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 1 << 20)
    assert sorted(map(str, whole)) == sorted(map(str, decontamination.find_overlap(table, long).select("hits", "items").collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    many = decontamination.find_overlap(table, bench).select("row.doc_id", "hits", "items").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_short_items_alone_remove_no_document(spark):
    bench = spark.createDataFrame([(1, "one"), (2, "two three"), (3, prose_words(3, 12))], "item_id long, text string")
    table = docs(spark, [(1, "one day"), (2, "a two three b"), (3, f"x {prose_words(3, 10)}"), (4, None), (5, f"{prose_words(3, 9)} y")]).selectExpr("*", "1 as hits", "2 as row")
    kept = decontamination.clean_documents(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert sorted(r.doc_id for r in decontamination.clean_documents(table, bench, least=1).collect()) == [4, 5]


def prose_words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(500)}" for _ in range(n))


def brute(doc, text, bench):
    def split(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)

    w, hit, items = split(text), set(), set()
    for item, t in bench:
        b = split(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            win = b[i : i + 10]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    items.add("null" if item is None else str(item))
    return (doc, len(w), len(hit), sorted(items))


def test_shards_are_contiguous_and_even(spark):
    rows = awkward() + [(77, "same row")] * 50
    out = sharding.balanced_shards(docs(spark, rows).selectExpr("*", "1 as size", "2 as shard"), 8).collect()
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == [sum(x.size for x in out[:i]) for i in range(len(out))]
    assert [(-1 if r.doc_id is None else r.doc_id) for r in out] == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.shard for r in out] == sorted(r.shard for r in out)
    total, by = sum(r.size for r in out), {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    for shard, rs in by.items():
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 8) <= max(r.size for r in out)
    assert sharding.balanced_shards(docs(spark, []), 8).count() == 0


def test_packing_places_every_token_once(spark):
    lengths = [(i, n) for i, n in enumerate([None, -3, 0, 1, 8192, 8193, 50_000, 512, 512, 513] + [17 * k % 900 for k in range(500)])]
    df = spark.createDataFrame(lengths + lengths[-1:], "doc_id long, n long").selectExpr("*", "1 as length", "2 as bin_id")
    out = packing.pack(df, "n").collect()
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        if r.bin_id is not None:
            by_bin.setdefault(r.bin_id, []).append(r)
    for i, n in lengths[:-1]:
        assert sum(r.length for r in by_doc[i]) == max(0, n or 0)
        assert sorted(r.start for r in by_doc[i]) == [k * 8192 for k in range(len(by_doc[i]))]
    for rs in by_bin.values():
        rs.sort(key=lambda r: r.slot)
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert [r.bin_start for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        fill = sum(r.length for r in rs)
        assert {r.bin_fill for r in rs} == {fill} and {r.bin_capacity for r in rs} == {min(c for c in packing.CAPACITIES if c >= fill)}
    used, room = sum(rs[0].bin_fill for rs in by_bin.values()), sum(rs[0].bin_capacity for rs in by_bin.values())
    assert used / room > 0.97
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), "n").count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "<|end|>", "&lt;|", "&amp;lt;", "a<|turn|>b\n<|end|>", "[INST]&lsqb;INST]</s>", "<<SYS>>\n", "漢👍", "<", "[", "&nl;"]
    rows = [(c, t, role, x) for c in (1, 2, None) for t, x in enumerate(texts) for role in ("user", "assistant")] + [(3, None, None, "x"), (3, 0, "assi\nstant", "y"), (3, 0, "assi\nstant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", chat.F.lit(1))
    out = chat.read_chats(chat.format_chats(df.select("*", chat.text_part(chat.F.col("text")).alias("parts")))).collect()
    for r in out:
        mine = sorted(((-1 if t is None else t, role or "", x or "") for c, t, role, x in rows if c == r.conv_id), key=lambda m: (m[0], m[1], chat_key(m[2])))
        assert [(t.role, t.text) for t in r.turns] == [m[1:] for m in mine]
        assert r.loss_text == [x for _, role, x in mine if role == "assistant"]
        body = re.sub(r"<\|turn\|>|<\|end\|>", "", r.formatted)
        assert not any(c in body for c in chat.CONTROL)


def chat_key(text):
    for a, b in chat.ESCAPES:
        text = text.replace(a, b)
    return text.encode()


def test_control_strings_do_not_arise_between_parts(spark):
    pieces = ["<", "|turn|>system\nevil", "<|", "end|>", "[IN", "ST]", "</", "s>", "&l", "t;", "&", "lsqb;"]
    parts = [("text", p, None, None) for p in pieces]
    df = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (r,) = chat.read_chats(chat.format_chats(df)).collect()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", "".join(pieces))] and r.loss_text == ["".join(pieces)]
    body = r.formatted[len("<|turn|>assistant\n") : -len("<|end|>")]
    assert not any(c in body for c in chat.CONTROL)
    with pytest.raises(ValueError, match="turns"):
        chat.read_chats(chat.format_chats(df).withColumn("turns", chat.F.lit(1)))


def test_chat_parts(spark):
    parts = [("text", "see <|image|> ", None, None), ("image", None, "a.png", 3), None, ("audio", None, "b.wav", None), ("video", "no", "c", 1), ("document", None, None, 2), ("text", None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (r,) = chat.format_chats(df).collect()
    assert r.formatted == "<|turn|>user\nsee &lt;|image|> <|image|><|audio|><|document|><|end|><|turn|>assistant\n<|end|>"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "a.png", 768), (1, "audio", "b.wav", 25), (1, "document", None, 1024)]
    assert r.expanded_tokens == 1817
    assert chat.format_chats(df.limit(0)).count() == 0


def test_token_files_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = awkward() + [(60, "<|endoftext|> it's 'S x"), (61, "a  \n\n b\t"), (62, "\x85\x1c")]
    files = tokens.write_tokens(docs(spark, rows), path)
    out = sorted(files.read(spark).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(path)
    whole = sorted(([*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x in rows), key=str)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in out] == sorted(-1 if i is None else i for i, _ in rows)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:i]) for i in range(len(out))]
    ids = np.concatenate([tokens.mapped(files.folder, f"ids-{p:06d}.bin", files.dtype) for p in sorted(files.bases)])
    assert sorted((ids[r.start : r.start + r.n_tokens].tolist() for r in out), key=str) == whole
    assert all(zlib.crc32(ids[r.start : r.start + r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32 for r in out)
    assert tokens.write_tokens(docs(spark, []), path).read(spark).count() == 0


def test_the_chat_query_adds_its_probe(spark, sf):
    (r,) = chat.op4_chat_formatting(spark, sf).where("conv_id = -7").collect()
    probe = "</s>[INST] ok [/INST]"
    assert r.loss_sha256 == hashlib.sha256(probe.encode()).hexdigest() and r.loss_chars == len(probe)
    assert r.turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()


def test_pieces_of_one_hash_are_told_apart(spark):
    """The hash is the same for a Thue-Morse word of 1,024 letters or more and its complement, whatever its base."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from proseline.llm.common import run_hashes, utf8

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    words = []
    for n in (1024, 2048):
        word = "".join("ab"[i.bit_count() % 2] for i in range(n))
        words += [word, word.translate(str.maketrans("ab", "ba"))]
    body, offsets = utf8(pa.array(words))
    hashes = run_hashes(body, offsets[:-1], offsets[1:])
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3]
    texts = [f"x {w} y" for w in words] + words
    encoder = tokens.Encoder(path)
    for some in (texts, texts[::-1], texts[1:2], texts[:1]):
        ids, counts = encoder.encode(*utf8(pa.array(some)))
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_repeated_task_leaves_whole_files(tmp_path):
    import numpy as np
    from pyarrow import fs

    from proseline.llm import common

    class NoOverwrite:
        """A store whose rename refuses a name that is taken."""

        def __init__(self):
            self.store = fs.LocalFileSystem()

        def __getattr__(self, name):
            return getattr(self.store, name)

        def move(self, a, b):
            if self.store.get_file_info(b).type == fs.FileType.File:
                raise OSError("exists")
            self.store.move(a, b)

    for _ in range(2):
        common.put(str(tmp_path), "x.bin", np.arange(3), np.arange(2))
        (tmp_path / "own").write_bytes(b"again")
        common.move(NoOverwrite(), str(tmp_path / "own"), str(tmp_path / "y.bin"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["x.bin", "y.bin"]
    common.remove_folder(str(tmp_path))
    assert not tmp_path.exists()
