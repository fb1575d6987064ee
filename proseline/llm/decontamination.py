"""Benchmark decontamination: Wu-Manber search for windows of benchmark words."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import mix, open_folder, power_tables, put, ranges, shared_folder, utf8

WINDOW = 10
#: Benchmark text of one search table, and rows that are searched for one table after the other.
BLOCK_BYTES, HELD = 8 << 20, 32 << 20
#: Bytes hashed at once, and windows of a lane of the search.
SEGMENT, LANE = 1 << 19, 256

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_FOLD = np.zeros(256, np.uint8)
_FOLD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_FOLD[65:91] = range(97, 123)
_P = 0x9E3779B97F4A7C15


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the texts in body, and each text's first word (n+1 numbers).

    Bytes of UTF-8 characters beyond ASCII are word bytes, so words can be found among bytes.
    A long text is hashed in segments that end between words.
    """
    fold = _FOLD[body]
    is_word = fold != 0
    begin, last = is_word.copy(), is_word.copy()
    begin[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    begin[inner] = is_word[inner]
    last[inner - 1] = is_word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SEGMENT, "right")))
        low, high = int(starts[a]), int(ends[b - 1])
        power, inverse = power_tables(max(SEGMENT, high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(fold[low:high] * power[: high - low], dtype=np.uint64, out=total[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        hashes[a:b] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        a = b
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def word_list(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class WuManber:
    """Finds word sequences of one length m in sequences of words.

    SHIFT tells for a block of two words how far the search may move on: m-1 where no pattern
    has the block, else the block's least distance from a pattern's end. A block with shift 0
    selects the patterns that end with it; their first word is compared, then all of the bytes.
    """

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.patterns = [b" ".join(p) for p in patterns]
        self.m = m = len(patterns[0])
        self.block = 2 if m > 1 else 1
        flat = b" ".join(self.patterns)
        hashes = words(np.frombuffer(flat, np.uint8), np.array([0, len(flat)]))[0].reshape(len(patterns), m)
        self.bits = min(24, max(12, int(len(patterns) * m * 8).bit_length()))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint16)
        for end in range(self.block - 1, m):
            at = self._slot(self._key(hashes[:, end - 1] if self.block > 1 else None, hashes[:, end]))
            self.shift[at] = np.minimum(self.shift[at], m - 1 - end)
        suffix = self._key(hashes[:, -2] if self.block > 1 else None, hashes[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.first, self.number = suffix[order], hashes[order, 0], order

    def _key(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return mix(last.copy() if before is None else before * np.uint64(_P) + last)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - self.bits)).astype(np.int64)

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, pattern) wherever suffix block and first word agree."""
        windows = np.maximum(0, np.diff(first) - self.m + 1)
        lanes = -(-windows // LANE)
        text = np.repeat(np.arange(len(windows)), lanes)
        pos = first[:-1][text] + self.m - 1 + ranges(lanes) * LANE
        stop = np.minimum(pos + LANE, first[1:][text])
        ends, keys = [], []
        while len(pos):
            key = self._key(hashes[pos - 1] if self.block > 1 else None, hashes[pos])
            move = self.shift[self._slot(key)].astype(np.int64)
            if (hit := move == 0).any():
                ends.append(pos[hit])
                keys.append(key[hit])
            pos = pos + np.maximum(move, 1)
            pos, stop = pos[go := pos < stop], stop[go]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, key = np.concatenate(ends), np.concatenate(keys)
        low, high = np.searchsorted(self.suffix, key, "left"), np.searchsorted(self.suffix, key, "right")
        begin, entry = np.repeat(end - self.m + 1, high - low), np.repeat(low, high - low) + ranges(high - low)
        same = hashes[begin] == self.first[entry]
        return begin[same], self.number[entry[same]]


class Benchmark:
    """One block of the benchmark: windows by length, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        of: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = word_list((text or "").encode())
            for i in range(max(1, len(w) - window + 1) if w else 0):
                of.setdefault(tuple(w[i : i + window]), set()).add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = {}
        for p in of:
            by_length.setdefault(len(p), []).append(p)
        self.searches = [(WuManber(ps), [sorted(of[p]) for p in ps]) for ps in by_length.values()]

    def search(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, set[tuple[int, int]]], dict[int, set[str]]]:
        """Number of words of each text; for each text that is hit, its windows (from, to) in words, and the items."""
        hashes, starts, ends, first = words(body, offsets)
        spans: dict[int, set[tuple[int, int]]] = {}
        found: dict[int, set[str]] = {}
        for search, items in self.searches:
            begin, number = search.candidates(hashes, first)
            texts = np.searchsorted(first, begin, "right") - 1
            for b, p, t in zip(begin.tolist(), number.tolist(), texts.tolist(), strict=True):
                there = body[starts[b] : ends[b + search.m - 1]].tobytes()
                if b" ".join(word_list(there)) == search.patterns[p]:
                    at = b - int(first[t])
                    spans.setdefault(t, set()).add((at, at + search.m))
                    found.setdefault(t, set()).update(items[p])
        return np.diff(first), spans, found


def parts_of_item(text: str, window: int) -> Iterator[str]:
    """A text in parts of some BLOCK_BYTES, which have all but one of a window's words in common."""
    if len(text) < BLOCK_BYTES:
        yield text
        return
    w = word_list(text.encode())
    per = max(window, BLOCK_BYTES * len(w) // (1 + sum(map(len, w)) + len(w)))
    for a in range(0, max(1, len(w) - window + 1), per):
        yield b" ".join(w[a : a + per + window - 1]).decode()


def write_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[str, int]:
    """The benchmark's search tables in blocks of BLOCK_BYTES, a file each in the shared folder; returns the folder and their number.

    Only one block's rows are on the driver at a time.
    """
    spark = benchmark.sparkSession
    folder = shared_folder(spark, "benchmark")
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)
    rows = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")), F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    held, size, n = [], 0, 0

    def write() -> None:
        put(folder, f"{n}.bin", np.frombuffer(pickle.dumps(Benchmark(held, window)), np.uint8))

    for item, text in rows.toLocalIterator():
        for part in parts_of_item(text, window):
            held.append((item, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                write()
                held, size, n = [], 0, n + 1
    if held or not n:
        write()
        n += 1
    return folder, n


def read_block(folder: str, number: int) -> Benchmark:
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{number}.bin") as f:
        return pickle.loads(f.read())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_overlap(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Search every whole text for the windows of all benchmark items.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none,
    is one window. The benchmark's search tables are files of a fixed size in the shared folder; a
    task holds HELD bytes of rows and one table at a time, and searches them for each table in turn; one is
    enough for any usual benchmark. There is no shuffle, and nothing of the benchmark is in the plan.
    Null texts have no words; texts and items of any length are searched whole; null item ids are named 'null';
    repeated rows are each searched; an empty table gives no rows, an empty benchmark no hits.

    Returns row (a struct of all columns of df, so that names cannot clash), n_words, hits
    (array of start, end in words, merged) and items (ids of the items found, as strings, sorted).
    """
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    folder, n_blocks = write_blocks(benchmark, item_col, item_text_col, window)
    span, item = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Benchmark] = {}

        def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [utf8(b.column(0).field(text_col)) for b in held]
            n_words = [np.zeros(len(b), np.int64) for b in held]
            hits: list[dict[int, list[tuple[int, int]]]] = [{} for _ in held]
            items: list[dict[int, set[str]]] = [{} for _ in held]
            for number in range(n_blocks):
                if number not in known:
                    known.clear()
                    known[number] = read_block(folder, number)
                for k, (body, offsets) in enumerate(texts):
                    n_words[k], spans, found = known[number].search(body, offsets)
                    for t, new in spans.items():
                        hits[k][t] = merged(hits[k].get(t, []) + list(new))
                        items[k].setdefault(t, set()).update(found[t])
            for k, batch in enumerate(held):
                spans = [[{"start": a, "end": b} for a, b in hits[k].get(t, ())] for t in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words[k]), pa.array(spans, span), pa.array([sorted(items[k].get(t, ())) for t in range(len(batch))], item)], ["row", "n_words", "hits", "items"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD or n_blocks == 1:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    form = f"row {rows.schema['row'].dataType.simpleString()}, n_words long, hits array<struct<start:int,end:int>>, items array<string>"
    return rows.mapInArrow(run, form)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_overlap(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: int = WINDOW) -> DataFrame:
    """The documents without a run of ``least`` or more words, side by side, that windows of the benchmark cover; with their columns.

    So an item of fewer words, which may be one common word, removes no document where it stands alone; with least=1 any hit does.
    """
    long = F.exists("hits", lambda x: x["end"] - x["start"] >= least)
    return find_overlap(docs, benchmark, text_col).where(~long).select("row.*")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_OP5 = rf"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS m, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)
), d AS (
  SELECT doc_id, row_number() OVER () AS k, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), o AS (
  SELECT k, i, p.m, p.item
  FROM (SELECT k, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
        FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM p) AS ms)) AS x
  JOIN p ON p.m = x.m AND p.win = x.win
), h AS (
  SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS q FROM o) GROUP BY k
), t AS (
  SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
