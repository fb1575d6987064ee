"""Token-ID output: flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import move, open_folder, put, ranges, remove_folder, run_hashes, saved, shared_folder, shuffle_partitions, slices, task_id, utf8

END_ID = 2
#: Text encoded at once, and pieces of text whose ids a worker remembers.
BLOCK, REMEMBERED = 4 << 20, 600_000

#: Classes of bytes: blank, other white space, letter, number, other. A character beyond ASCII has the class of its first byte.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[32], _CLASS[[9, 10, 13]] = 0, 1
_CLASS[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = 2
_CLASS[48:58] = 3
#: Second bytes of the letters and numbers among U+00A1 to U+00BF, and of the signs among U+00C0 to U+00FF.
_LETTERS_C2, _NUMBERS_C2, _SIGNS_C3 = (0xAA, 0xB5, 0xBA), (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE), (0x97, 0xB7)
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Byte-level BPE spells bytes that are no visible Latin-1 characters as those from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SPELT = np.arange(256, dtype="<u4")
_SPELT[_HIDDEN] = 256 + np.arange(len(_HIDDEN))

_UNUSUAL = np.array([not (b in (9, 10, 13) or 32 <= b < 127 or 128 <= b < 192 or 194 <= b < 198) for b in range(256)])

_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def usual_texts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, whether it has only tabs, line ends, visible ASCII and U+00A1 to U+017F, and no "<|"."""
    odd = _UNUSUAL[body]
    odd[:-1] |= ((body[:-1] == 0xC2) & (body[1:] <= 0xA0)) | ((body[:-1] == 60) & (body[1:] == 124))
    return np.diff(np.searchsorted(np.flatnonzero(odd), offsets)) == 0


def piece_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin that byte-level BPE cuts usual texts into.

    These are contractions, and runs of letters, numbers or other signs with one blank before;
    of white space before them, the last character stands apart.
    """
    cls = _CLASS[body]
    two = np.flatnonzero(body[:-1] == 0xC2)
    after = body[two + 1]
    cls[two[np.isin(after, _LETTERS_C2)]] = 2
    cls[two[np.isin(after, _NUMBERS_C2)]] = 3
    two = np.flatnonzero(body[:-1] == 0xC3)
    cls[two[np.isin(body[two + 1], _SIGNS_C3)]] = 4
    inner = np.flatnonzero((body & 0xC0) == 0x80)
    cls[inner] = cls[inner - 1]
    first = np.zeros(len(body) + 1, bool)
    first[offsets] = True
    blank = cls <= 1
    was, had = np.zeros(len(body), bool), np.full(len(body), 255, np.uint8)
    was[1:], had[1:] = blank[:-1], cls[:-1]
    was &= ~first[:-1]
    begins = np.where(blank, ~was, np.where(was, had != 0, cls != had)) | first[:-1]
    begins[:-1] |= blank[:-1] & ~blank[1:] & ~first[1:-1]
    for ending in _ENDINGS:
        n = len(ending)
        at = np.flatnonzero(begins[: len(body) - n] & (body[: len(body) - n] == 39))
        for k in range(n):
            at = at[(body[at + 1 + k] == ending[k]) & ~first[at + 1 + k]]
        begins[at + 1] = False
        begins[(at + 1 + n)[at + 1 + n < len(body)]] = True
    return np.flatnonzero(begins)


def differing(body: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The pieces whose bytes are not those of piece ``other`` of each."""
    size = end - begin
    bad = [np.flatnonzero(size != size[other])]
    # Eight bytes at a time; what lies beyond a piece is masked away.
    wide = np.zeros(len(body) + 8, np.uint8)
    wide[: len(body)] = body
    words = np.lib.stride_tricks.sliding_window_view(wide, 8)
    left = np.flatnonzero((size == size[other]) & (other != np.arange(len(begin))))
    at = 0
    while len(left):
        mask = _LOW_BYTES[np.minimum(size[left] - at, 8)]
        x, y = (np.ascontiguousarray(words[begin[i] + at]).view("<u8")[:, 0] & mask for i in (left, other[left]))
        bad.append(left[x != y])
        at += 8
        left = left[(x == y) & (size[left] > at)]
    return np.concatenate(bad)


class Encoder:
    """Encodes texts with a byte-level BPE tokenizer; each distinct piece of text is encoded once.

    Byte-level BPE never merges across pieces, so a text's ids are those of its pieces in order.
    Hashes only bring pieces together: their bytes are compared, and remembered ones are known by their
    bytes. Texts with a piece that differs from the first of its hash, with other characters
    than piece_starts() knows, or that may hold a special token, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        rule = made["pre_tokenizer"] or {}
        #: Whether texts are cut by the usual rule of byte-level BPE; else all go to the library whole.
        self.by_piece = made["normalizer"] is None and made["model"]["type"] == "BPE" and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space") and all(x["content"].startswith("<|") for x in made["added_tokens"])
        #: A piece -> its number; piece 0 has no ids.
        self.number: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _learn(self, body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """The library's model encodes a piece at once; its bytes are spelt as the model's characters."""
        tokenize, sizes = self.tokenizer.model.tokenize, end - begin
        spelt = _SPELT[body[np.repeat(begin, sizes) + ranges(sizes)]].tobytes().decode("utf-32-le")
        ends = np.cumsum(sizes).tolist()
        encoded = [[t.id for t in tokenize(spelt[a:b])] for a, b in zip([0, *ends], ends)]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in body, and how many each text has."""
        usual = usual_texts(body, offsets) & self.by_piece
        begin = piece_starts(body, offsets)
        end = np.append(begin[1:], len(body))
        _, sample, which = np.unique(run_hashes(body, begin, end), return_index=True, return_inverse=True)
        pieces = np.searchsorted(begin, offsets)
        usual[np.searchsorted(pieces, differing(body, begin, end, sample[which]), "right") - 1] = False
        before, data = len(self.begin), body.tobytes()
        names = [data[a:b] for a, b in zip(begin[sample].tolist(), end[sample].tolist())]
        numbers = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(numbers < 0)
        numbers[new] = before - 1 + np.arange(len(new))
        self._learn(body, begin[sample[new]], end[sample[new]])
        fresh = [names[i] for i in new.tolist()]
        self.number.update(zip(fresh, numbers[new].tolist(), strict=True))
        at = np.where(np.repeat(usual, np.diff(pieces)), numbers[which], 0)
        sizes = self.begin[at + 1] - self.begin[at]
        ids = self.ids[np.repeat(self.begin[at], sizes) + ranges(sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[pieces[1:]]
        counts = np.diff(ends, prepend=0)
        whole = np.flatnonzero(~usual).tolist()
        if whole:
            runs, last = [], 0
            for i, e in zip(whole, self.tokenizer.encode_batch([data[offsets[i] : offsets[i + 1]].decode() for i in whole], add_special_tokens=False), strict=True):
                runs += [ids[last : ends[i]], np.asarray(e.ids, np.uint32)]
                last, counts[i] = ends[i], len(e.ids)
            ids = np.concatenate([*runs, ids[last:]])
        if len(self.number) > REMEMBERED:  # what came first is kept: it is what is frequent
            for name in fresh:
                del self.number[name]
            self.begin = self.begin[:before]
            self.ids = self.ids[: self.begin[-1]]
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def mapped(uri: str, name: str, dtype: str, begin: int = 0, end: int | None = None) -> np.ndarray:
    """A file's numbers from begin to end; memory-mapped where the folder is a local or mounted one, else read."""
    store, path = open_folder(uri)
    if isinstance(store, pafs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(f"{path}/{name}").read_buffer(), dtype)[begin:end]
    size = np.dtype(dtype).itemsize
    with store.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read_at((f.size() // size if end is None else end) * size - begin * size, begin * size), dtype)


class TokenFiles:
    """Token files in one folder: for part k ids-k.bin (u2 or u4), offsets-k.bin (i8, one more than
    documents, counted from the first id of all parts), docs-k.bin (i8 ids) and nulls-k.bin (u1)."""

    def __init__(self, folder: str, dtype: str, bases: dict[int, int], n_ids: int):
        self.folder, self.dtype, self.bases, self.n_ids = folder, dtype, bases, n_ids

    def documents(self, low: int, high: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, place in the part's ids, ids, nulls, lengths) of the documents whose first id is the low-th to the one before the high-th."""
        parts = sorted(self.bases)
        ends = [*(self.bases[p] for p in parts[1:]), self.n_ids]
        for part, end in zip(parts, ends, strict=True):
            if self.bases[part] < high and end > low:
                offsets = mapped(self.folder, f"offsets-{part:06d}.bin", "<i8")
                a, b = np.searchsorted(offsets[:-1], [low, high]).tolist()
                if a < b:
                    docs, nulls = mapped(self.folder, f"docs-{part:06d}.bin", "<i8", a, b), mapped(self.folder, f"nulls-{part:06d}.bin", "u1", a, b)
                    yield part, int(offsets[a] - offsets[0]), docs, nulls.astype(bool), np.diff(offsets[a : b + 1])

    def read(self, spark: SparkSession, id_col: str = "doc_id") -> DataFrame:
        """One row for each document: id_col, start, n_tokens, ids_crc32 (of the ids as little-endian u4), part."""
        folder, dtype, names = self.folder, self.dtype, [id_col, "start", "n_tokens", "ids_crc32", "part"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    docs, nulls, offsets = mapped(folder, f"docs-{part:06d}.bin", "<i8"), mapped(folder, f"nulls-{part:06d}.bin", "u1"), mapped(folder, f"offsets-{part:06d}.bin", "<i8")
                    ids = mapped(folder, f"ids-{part:06d}.bin", dtype)
                    for a in range(0, len(docs), 20_000):
                        offs = offsets[a : a + 20_001]
                        at = (offs - offsets[0]).tolist()
                        crc = [zlib.crc32(ids[x:y].astype("<u4")) for x, y in zip(at, at[1:])]
                        m = len(crc)
                        yield pa.RecordBatch.from_arrays([pa.array(docs[a : a + m], mask=nulls[a : a + m].astype(bool)), pa.array(offs[:-1]), pa.array(np.diff(offs)), pa.array(crc, pa.int64()), pa.array(np.full(m, part, np.int64))], names)

        return parts_of(spark, self.bases).mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, part long")


def parts_of(spark: SparkSession, bases: dict[int, int]) -> DataFrame:
    """One row and one task for each part that has documents."""
    numbers = sorted(bases)
    at = F.element_at(F.lit(numbers) if numbers else F.array().cast("array<bigint>"), (F.col("id") + 1).cast("int"))
    return spark.range(0, len(numbers), 1, max(1, len(numbers))).select(at.cast("long").alias("part"))


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode whole texts and write them in ascending id order; returns the files' description.

    Texts are range partitioned by id (ties: by text; nulls first), and each task encodes and
    writes one part, text by text in blocks. The parts' numbers of ids give each part's base by a
    prefix sum (one number per part on the driver), and a second, small job writes the offsets.
    Ids take two bytes where the vocabulary allows it, else four. Files go to the folder that the
    executors share: ``folder``, or one that is removed when the driver ends. Null texts are empty: a
    document of the end id alone. Repeated rows are written as often as they occur; texts of any length are encoded
    whole; an empty table gives no parts; other columns, of any name, take no part.
    """
    spark = df.sparkSession
    uri = folder or shared_folder(spark, "tokens")
    store, path = open_folder(uri)
    store.create_dir(path, recursive=True)
    dtype = "<u2" if max(encoder(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), task_id()
        docs, nulls, counts = [], [], []
        store, path = open_folder(uri)
        name = f"ids-{part:06d}.bin"
        own = f"{path}/.{name}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for batch in batches:
                body, offsets = utf8(batch.column(1))
                for a, b in slices(offsets, BLOCK):
                    ids, n = enc.encode(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    ends = np.cumsum(n)
                    out.write(np.insert(ids, ends, end_id).astype(dtype))
                    counts.append(n + 1)
                docs.append(np.asarray(batch.column(0).fill_null(0)))
                nulls.append(np.asarray(batch.column(0).is_null()).astype(np.uint8))
        total = int(sum(map(np.sum, counts)))
        if docs:
            move(store, own, f"{path}/{name}")
            put(uri, f"docs-{part:06d}.bin", *docs)
            put(uri, f"nulls-{part:06d}.bin", *nulls)
            put(uri, f"counts-{part:06d}.bin", *counts)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total], pa.int64())], ["part", "n"])
        else:
            store.delete_file(own)

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keys = ["id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.select("*", keys[1].alias("h"), keys[2].alias("tie"))
    ranged = rows.repartitionByRange(shuffle_partitions(spark), "id", "h", "tie").sortWithinPartitions("id", "h", "tie").select("id", "text")
    bases, base = {}, 0
    for part, n in sorted(tuple(r) for r in ranged.mapInArrow(write, "part long, n long").collect()):
        bases[part] = base
        base += n

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                counts = mapped(uri, f"counts-{part:06d}.bin", "<i8")
                put(uri, f"offsets-{part:06d}.bin", bases[part] + np.concatenate([[0], np.cumsum(counts)]).astype("<i8"))
            yield batch

    parts_of(spark, bases).mapInArrow(finish, "part long").count()
    return TokenFiles(uri, dtype, bases, base)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    found = saved(files.read(spark).drop("part"))
    remove_folder(files.folder)
    return found
