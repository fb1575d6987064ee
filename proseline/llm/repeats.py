"""Removal of repeated strings, found by merging shards' Burrows-Wheeler transforms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import batch_rows, compressed, mix, pack_batches, power_tables, prefix_sums, ranges, run_hashes, shuffle_partitions, uncompressed, utf8
from proseline.llm.exchange import met_again, unpack_steps

#: Bytes of a string that counts when repeated; of the anchor that every such string contains.
LENGTH, ANCHOR = 50, 24
#: Bytes that one symbol of a transform stands for: LENGTH is a whole number of symbols.
SYMBOL = 10
#: Shards that a bucket's strings are dealt to before their transforms are merged.
SHARDS = 4
#: Text of a batch, of a block that is hashed at once, and of the input for each bucket.
BATCH_BYTES, BLOCK, BUCKET_BYTES = 8 << 20, 1 << 16, 6 << 20
#: Bytes of strings whose transforms are merged together; strings of one anchor are not parted.
MERGED = 1 << 18
#: Batches beyond which an anchor that they all have is hot: each of its windows is then a string of its own.
HOT = 2048
#: An id for documents that have none: nothing is smaller than null, and null is smaller than nothing.
NO_ID = np.iinfo(np.int64).max


class Windows:
    """The strings of one batch: each run of LENGTH-byte windows with the same anchor is one string.

    A window's anchor is its ANCHOR-byte gram with the least hash, the leftmost of them; it
    depends on the window's bytes alone. So a window that is in two documents has the same
    anchor in both, and the strings around it meet wherever that anchor is looked at.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        self.body, self.offsets = body, offsets
        parts = [self._block(a, b) for a, b in _blocks(offsets)]
        self.first, self.last, self.anchor = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts) if parts else [()] * 3, (np.int64, np.int64, np.uint64), strict=True))
        self.text = np.searchsorted(offsets, self.first, "right") - 1

    def _block(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window (as places in body) and anchor of each string among the windows that start in [low, high)."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        end = min(len(self.body), high + LENGTH - 1)
        n = end - low
        if n < LENGTH:
            return none
        total = prefix_sums(self.body[low:end])
        hashes = mix((total[ANCHOR:] - total[:-ANCHOR]) * power_tables(n)[1][: n - ANCHOR + 1])
        key = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        least, width = key, 1
        span = LENGTH - ANCHOR + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        # The places where a text's windows end: LENGTH - 1 bytes before the next text.
        edges = self.offsets[np.searchsorted(self.offsets, low, "right") : np.searchsorted(self.offsets, end, "right")] - low
        valid = np.ones(len(at) + 1, bool)
        valid[high - low :] = False
        for e in edges.tolist():
            valid[max(0, e - LENGTH + 1) : e] = False
        change = np.ones(len(at) + 1, bool)
        change[1:-1] = at[1:] != at[:-1]
        change[edges[edges < len(at)]] = True
        change[1:] |= ~valid[:-1]
        first = np.flatnonzero(change[:-1] & valid[:-1])
        last = np.flatnonzero(valid[:-1] & (change[1:] | ~valid[1:]))
        # Anchors are least hashes, so small ones are common; mixed again, they spread evenly.
        return first + low, last + low, mix(hashes[at[first]] ^ np.uint64(0x5851F42D4C957F2D))

    def refine(self, hot: np.ndarray, bits: int) -> None:
        """Part the strings whose anchor is in ``hot`` into single windows, each with its own hash as anchor.

        A passage in very many contexts has the same anchors at its ends in all of them. Nothing
        is left to part then: windows of one hash are equal, and each batch sends one of them.
        """
        is_hot = _in_sorted(_spread(self.anchor, bits), hot) if len(hot) else np.zeros(len(self.anchor), bool)
        if not is_hot.any():
            return
        windows = (self.last - self.first + 1)[is_hot]
        place = np.repeat(self.first[is_hot], windows) + ranges(windows)
        text = np.repeat(self.text[is_hot], windows)
        order = np.argsort(place, kind="stable")
        place, text = place[order], text[order]
        anchor = mix(run_hashes(self.body, place, place + LENGTH) ^ np.uint64(0x2545F4914F6CDD1D))
        parts = ((self.first[~is_hot], place), (self.last[~is_hot], place), (self.anchor[~is_hot], anchor), (self.text[~is_hot], text))
        self.first, self.last, self.anchor, self.text = (np.concatenate(x) for x in parts)
        self._take(np.argsort(self.first, kind="stable"))

    def _take(self, which: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.text = self.first[which], self.last[which], self.anchor[which], self.text[which]

    def contents(self, which: np.ndarray) -> np.ndarray:
        """A name for each string, the same for equal ones alone: a hash of its bytes, told apart where two strings have one."""
        out = np.empty(len(which), np.uint64)
        for a in range(0, len(which), 1 << 14):
            some = which[a : a + (1 << 14)]
            out[a : a + len(some)] = run_hashes(self.body, self.first[some], self.last[some] + LENGTH)
        return told_apart(self.body, self.first[which], self.last[which] + LENGTH - self.first[which], out)


def told_apart(data: np.ndarray, begin: np.ndarray, size: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Names of strings, changed so that different strings have different ones: those that differ from the first of their name, byte by byte, get another."""
    name = name.copy()
    mine = np.arange(len(name))
    while len(mine):
        _, first, which = np.unique(name[mine], return_index=True, return_inverse=True)
        one = mine[first[which]]
        same = size[mine] == size[one]
        at = np.flatnonzero(same & (mine != one))
        for a in range(0, len(at), 1 << 14):
            x, y = mine[at[a : a + (1 << 14)]], one[at[a : a + (1 << 14)]]
            steps = ranges(size[x])
            equal = data[np.repeat(begin[x], size[x]) + steps] == data[np.repeat(begin[y], size[x]) + steps]
            same[at[a : a + (1 << 14)]] = np.add.reduceat(equal, np.cumsum(size[x]) - size[x]) == size[x]
        mine = mine[~same]
        name[mine] = mix(name[mine] + np.uint64(1))
    return name


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a in range(0, int(offsets[-1]), BLOCK):
        yield a, min(a + BLOCK, int(offsets[-1]))


def _spread(anchor: np.ndarray, bits: int) -> np.ndarray:
    return anchor >> np.uint64(64 - bits)


def stable_order(x: np.ndarray, most: int) -> np.ndarray:
    """A stable sort of numbers up to ``most``, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if most >= 1 << 16:
        order = order[np.argsort((x[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Collection:
    """Strings as suffixes over SYMBOL-byte symbols; every phase of a string is a sequence of its own.

    Symbols are ranks of the exact bytes, with 0 for a sequence's end. A string of n bytes has
    n + 1 suffixes: one for each byte that starts a symbol, and one empty suffix for each phase.
    """

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        sizes = np.diff(begin)
        n = int(begin[-1]) + len(sizes)
        self.string = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.place = ranges(sizes + 1)
        whole = self.place <= (sizes - SYMBOL)[self.string]
        at = (begin[:-1][self.string] + self.place)[whole]
        words = np.zeros((len(at), 2), np.uint64)
        for k in range(SYMBOL):
            words[:, k // 5] = (words[:, k // 5] << np.uint64(8)) | data[at + k]
        left, right = (_ranks(words[:, k]) for k in (0, 1))
        self.symbol = np.zeros(n, np.int64)
        self.symbol[whole] = _ranks((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)) + 1
        self.most = int(self.symbol.max(initial=0))
        #: The symbol before each suffix: 0 before a sequence's first.
        self.before = np.zeros(n, np.int64)
        later = np.flatnonzero(self.place >= SYMBOL)
        self.before[later] = self.symbol[later - SYMBOL]

    def transform(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes ``rows`` in order of their first LENGTH bytes, and the symbols before them: one shard's transform."""
        order = rows
        ends = len(self.symbol)
        for k in range(LENGTH // SYMBOL - 1, -1, -1):
            at = order + k * SYMBOL
            inside = at < ends
            at = np.where(inside, at, 0)
            symbol = np.where(inside & (self.string[at] == self.string[order]), self.symbol[at], 0)
            order = order[stable_order(symbol, self.most)]
        return order, self.before[order]


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def merge_transforms(transforms: list[np.ndarray], most: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards' transforms by refining their interleave (Holt and McMillan, 2014); texts are not looked at.

    The interleave tells for each row of the merged transform which shard it comes from. At
    first it is all of the first shard, then the second, and so on. A round reads the shards'
    symbols in the order of the interleave and deals the shard numbers to their symbols'
    buckets; after k rounds, rows are in the order of their first k symbols. Two rows that lie
    side by side and share k symbols are in one interval: their symbols were equal and the
    rows that they came from shared k - 1, so each round derives the common prefixes from the last.

    Returns the interleave and the number of each row's interval: the rows that share ``rounds`` symbols.
    """
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), sizes)
    interval = np.zeros(len(shard), np.int64)
    symbols = np.empty(len(shard), np.int64)
    for _ in range(rounds):
        for s, t in enumerate(transforms):
            symbols[shard == s] = t
        order = stable_order(symbols, most)
        shard, symbol, came = shard[order], symbols[order], interval[order]
        new = np.zeros(len(order), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])
        interval = np.cumsum(new)
    return shard, interval


def least_owners(data: np.ndarray, begin: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, window, least owner of a string that contains the window), for every window of the strings."""
    strings = Collection(data, begin)
    dealt = np.arange(len(owner)) * SHARDS // max(1, len(owner))
    rows = [np.flatnonzero(dealt[strings.string] == s) for s in range(SHARDS)]
    orders, transforms = zip(*(strings.transform(r) for r in rows), strict=True)
    shard, interval = merge_transforms(list(transforms), strings.most, LENGTH // SYMBOL)
    suffix = np.empty(len(shard), np.int64)
    for s, order in enumerate(orders):
        suffix[shard == s] = order
    string, place = strings.string[suffix], strings.place[suffix]
    is_window = place <= (np.diff(begin) - LENGTH)[string]
    string, place, interval = string[is_window], place[is_window], interval[is_window]
    if not len(string):
        return string, place, owner[:0]
    head = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    least = np.minimum.reduceat(owner[string], head)
    return string, place, np.repeat(least, np.diff(np.append(head, len(string))))


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Mark each byte covered by a LENGTH-byte string that also starts in a document with a smaller id.

    1. Every batch of texts tells its anchors (see Windows) as short hashes, and hears of those
       that are in more than one text (see exchange).
    2. Every batch sends the strings with such an anchor, equal ones once, with their least id.
       A bucket makes equal strings one, byte by byte. A string that no other shares its anchor with shares no
       window with another either. The others are dealt to shards, each shard's transform is
       built, the transforms are merged, and the intervals of the merged transform give for every
       window the least id of a text that has it. The batches get these numbers back.
    3. Every batch marks the windows whose least id is smaller than their own text's.

    Texts are compressed and shuffled once, and read three times. Buckets grow with the input in
    number, not in size: strings of an anchor that very many batches have are parted into windows,
    of which each batch sends one. Little comes to the driver: the number of bytes, and of each task's batches.

    Null texts are empty. Texts with a null id keep what only they have, and lose what a text with
    an id has; they are never a reason to remove. Texts of one id (repeated rows) don't remove each
    other's strings. Strings are those of the input, whatever is removed elsewhere. A text of any length
    is one row of a batch, hashed in blocks. An empty table gives no rows; columns may have any name.

    Returns row (a struct of df's columns without text_col), n_bytes, n_removed, spans (array of start,
    end: maximal removed runs, in bytes), kept_sha256 and, if asked for, kept (the bytes that stay).
    """
    n = shuffle_partitions(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    bucket_bits = max(2, (size // BUCKET_BYTES).bit_length())
    hash_bits = max(bucket_bits + 8, min(bucket_bits + 31, (size // 12 + 1).bit_length() + 8))
    kept_columns = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col))
    packed = pack_batches(df.select(kept_columns.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", BATCH_BYTES)

    def ids_of(rows: pa.RecordBatch) -> np.ndarray:
        return np.asarray(rows.column(0).field("id").fill_null(NO_ID))

    def anchors(blob: bytes) -> np.ndarray:
        """A batch's anchors, ascending; one that two of its texts have is there twice."""
        w = Windows(*utf8(batch_rows(blob).column(1)))
        order = np.lexsort((w.text, w.anchor))
        anchor, text = w.anchor[order], w.text[order]
        first = np.ones(len(order), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        other = np.zeros(len(order), bool)
        other[1:] = ~first[1:] & (text[1:] != text[:-1])
        run = np.cumsum(first) - 1
        again = np.flatnonzero(other)
        again = again[np.r_[True, run[again][1:] != run[again][:-1]]] if len(again) else again
        return _spread(np.sort(np.concatenate([anchor[first], anchor[again]])), hash_bits)

    def send(own: pa.Table, met: pa.Table) -> pa.Table:
        none = pa.table({"bucket": pa.array([], pa.int32()), "batch": pa.array([], pa.int64()), "sizes": pa.array([], pa.binary()), "ids": pa.array([], pa.binary()), "names": pa.array([], pa.binary()), "data": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())})
        if not len(own) or not len(met):
            return none
        rows = batch_rows(own.column("blob")[0].as_py())
        w = Windows(*utf8(rows.column(1)))
        shared = np.sort(np.concatenate([unpack_steps(x) for x in met.column("data").to_pylist()]))
        w._take(np.flatnonzero(_in_sorted(_spread(w.anchor, hash_bits), shared)))
        if not len(w.first):
            return none
        hot = b"".join(met.column("hot").to_pylist())
        w.refine(np.sort(np.frombuffer(hot, np.uint64)), hash_bits)
        which = np.arange(len(w.first))
        name, ids = w.contents(which), ids_of(rows)[w.text[which]]
        order = np.lexsort((ids, name, _spread(w.anchor[which], bucket_bits)))
        which, name, ids = which[order], name[order], ids[order]
        one = np.r_[True, name[1:] != name[:-1]]
        which, name, ids = which[one], name[one], ids[one]
        sizes = w.last[which] + LENGTH - w.first[which]
        ends = np.cumsum(sizes)
        data = w.body[np.repeat(w.first[which], sizes) + ranges(sizes)]
        bucket = _spread(w.anchor[which], bucket_bits).astype(np.int64)
        head = np.flatnonzero(np.diff(bucket, prepend=-1))
        cuts = list(zip(head, np.append(head[1:], len(bucket)), strict=True))
        return pa.table(
            {
                "bucket": pa.array(bucket[head], pa.int32()),
                "batch": pa.array(np.full(len(head), own.column("batch")[0].as_py())),
                "sizes": pa.array([compressed(sizes[a:b].astype(np.uint8)) for a, b in cuts], pa.binary()),
                "ids": pa.array([compressed(ids[a:b]) for a, b in cuts], pa.binary()),
                "names": pa.array([name[a:b].tobytes() for a, b in cuts], pa.binary()),
                "data": pa.array([compressed(data[ends[a] - sizes[a] : ends[b - 1]]) for a, b in cuts], pa.binary()),
                "hot": pa.array([hot if i == 0 else b"" for i in range(len(cuts))], pa.binary()),
            }
        )

    def merge(table: pa.Table) -> pa.Table:
        counts = [len(x) // 8 for x in table.column("names").to_pylist()]
        sizes = np.concatenate([uncompressed(x, np.uint8) for x in table.column("sizes").to_pylist()]).astype(np.int64)
        ids = np.concatenate([uncompressed(x, np.int64) for x in table.column("ids").to_pylist()])
        name = np.frombuffer(b"".join(table.column("names").to_pylist()), np.uint64)
        data = np.concatenate([uncompressed(x, np.uint8) for x in table.column("data").to_pylist()])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        # Equal strings become one, with the least of their ids; a name is one batch's, so strings of other batches are compared.
        kind, number = np.unique(told_apart(data, begin[:-1], sizes, name), return_inverse=True)
        sample = np.zeros(len(kind), np.int64)
        sample[number[::-1]] = np.arange(len(name))[::-1]
        owner = np.full(len(kind), NO_ID)
        np.minimum.at(owner, number, ids)
        length = sizes[sample]
        windows = length - LENGTH + 1
        base = np.concatenate([[0], np.cumsum(windows)])
        least = np.repeat(owner, windows)
        anchor = _anchors(data, begin[sample], length)
        order = np.argsort(anchor, kind="stable")
        edge = np.r_[True, anchor[order][1:] != anchor[order][:-1]]
        group = np.cumsum(edge) - 1
        several = order[np.bincount(group)[group] > 1]
        at = 0
        ends = np.cumsum(length[several])
        groups = anchor[several]
        while at < len(several):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MERGED, "right"))
            stop = max(stop, at + 1)
            while stop < len(several) and groups[stop] == groups[stop - 1]:
                stop += 1
            here = several[at:stop]
            some = data[np.repeat(begin[sample[here]], length[here]) + ranges(length[here])]
            string, place, found = least_owners(some, np.concatenate([[0], np.cumsum(length[here])]), owner[here])
            least[base[here[string]] + place] = found
            at = stop
        # Runs of windows with the same least id, for each string.
        cut = np.ones(len(least), bool)
        cut[1:] = least[1:] != least[:-1]
        cut[base[:-1]] = True
        head = np.flatnonzero(cut)
        run = np.diff(np.append(head, len(least)))
        runs_of = np.searchsorted(head, base)
        out, a = [], 0
        for c in counts:
            mine = number[a : a + c]
            n_runs = runs_of[mine + 1] - runs_of[mine]
            at = np.repeat(runs_of[mine], n_runs) + ranges(n_runs)
            out.append((compressed(n_runs.astype(np.uint8)), compressed(run[at].astype(np.uint8)), compressed(least[head[at]])))
            a += c
        return pa.table({"batch": table.column("batch"), "names": table.column("names"), "hot": table.column("hot"), "n_runs": pa.array([x[0] for x in out], pa.binary()), "run": pa.array([x[1] for x in out], pa.binary()), "least": pa.array([x[2] for x in out], pa.binary())})

    row_type = df.select(kept_columns.alias("row")).schema["row"].dataType.toNullable()
    kept_field = ", kept binary" if with_text else ""

    def mark(own: pa.Table, got: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = batch_rows(own.column("blob")[0].as_py())
        body, offsets = utf8(rows.column(1))
        gone = np.zeros(len(body) + 1, np.int32)
        if len(got):
            w = Windows(body, offsets)
            w.refine(np.sort(np.frombuffer(b"".join(got.column("hot").to_pylist()), np.uint64)), hash_bits)
            name = np.frombuffer(b"".join(got.column("names").to_pylist()), np.uint64)
            n_runs = np.concatenate([uncompressed(x, np.uint8) for x in got.column("n_runs").to_pylist()]).astype(np.int64)
            run = np.concatenate([uncompressed(x, np.uint8) for x in got.column("run").to_pylist()]).astype(np.int64)
            least = np.concatenate([uncompressed(x, np.int64) for x in got.column("least").to_pylist()])
            base = np.cumsum(n_runs) - n_runs
            order = np.argsort(name)
            mine = w.contents(np.arange(len(w.first)))
            at = np.minimum(np.searchsorted(name[order], mine), len(name) - 1)
            known = name[order][at] == mine
            which, entry = np.flatnonzero(known), order[at[known]]
            begins = np.cumsum(run) - run
            string = np.repeat(which, n_runs[entry])
            piece = np.repeat(base[entry], n_runs[entry]) + ranges(n_runs[entry])
            start = w.first[string] + begins[piece] - begins[np.repeat(base[entry], n_runs[entry])]
            removed = least[piece] < ids_of(rows)[w.text[string]]
            np.add.at(gone, start[removed], 1)
            np.add.at(gone, (start + run[piece] + LENGTH - 1)[removed], -1)
        out = np.cumsum(gone[:-1]) > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(out)])[offsets])
        kept, spans = [], []
        for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
            if n_removed[i]:
                edges = np.flatnonzero(np.diff(out[a:b].astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(body[a:b][~out[a:b]].tobytes())
            else:
                spans.append([])
                kept.append(body[a:b].tobytes() if with_text else memoryview(body[a:b]))
        columns = {"row": rows.column(0).field("row").cast(to_arrow_type(row_type)), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed.astype(np.int64)), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        return pa.table(columns | ({"kept": pa.array([bytes(x) for x in kept], pa.binary())} if with_text else {}))

    met = met_again(packed, anchors, bucket_bits, hash_bits, HOT)
    sent = packed.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(send, "bucket int, batch long, sizes binary, ids binary, names binary, data binary, hot binary")
    known = sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(merge, "batch long, names binary, hot binary, n_runs binary, run binary, least binary")
    return packed.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(mark, f"row {row_type.simpleString()}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string{kept_field}")


def _in_sorted(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Whether each of x is in ascending; a table of low bits spares most searches."""
    if not len(ascending):
        return np.zeros(len(x), bool)
    mask = np.uint64((1 << 22) - 1)
    maybe = np.zeros(1 << 22, bool)
    maybe[(ascending & mask).astype(np.int64)] = True
    out = maybe[(x & mask).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = ascending[np.minimum(np.searchsorted(ascending, x[at]), len(ascending) - 1)] == x[at]
    return out


def _anchors(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The anchor of each string: that of its first window."""
    order = np.argsort(begin)
    out = np.empty(len(begin), np.uint64)
    for a in range(0, len(order), 1 << 12):
        some = order[a : a + (1 << 12)]
        low, high = int(begin[some[0]]), int(begin[some[-1]]) + LENGTH
        w = data[low:high]
        total = prefix_sums(w)
        grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * power_tables(len(w))[1][: len(w) - ANCHOR + 1])
        at = (begin[some] - low)[:, None] + np.arange(LENGTH - ANCHOR + 1)[None, :]
        mine = grams[at]
        best = (mine & ~np.uint64(0xFFFFFF)).argmin(axis=1)
        out[some] = mine[np.arange(len(some)), best]
    return out


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs).select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE_OP1 = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), w AS (
  SELECT k, doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) AS s FROM (SELECT *, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d)
), g AS (
  SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1 AND min(doc_id) < max(doc_id)
), r AS (
  SELECT k, i, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS step FROM w JOIN g USING (s) WHERE doc_id > least
), q AS (
  SELECT k, i, sum(CASE WHEN step <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM r
), p AS (
  SELECT k, run, min(i) AS a, max(i) + {LENGTH} AS b FROM q GROUP BY k, run
), e AS (
  SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS last FROM p
), t AS (
  SELECT k, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS fin, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept
  FROM e JOIN d USING (k) GROUP BY k
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * fin + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (k)
"""
