"""Personal data: fixed patterns, and identifiers found through their contexts by bootstrapping."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import mix, run_hashes, saved, slices, utf8

KINDS = ("email", "ip", "card", "phone")
#: Least confidence of a pattern, and how many instances that score as much it must have met.
CONFIDENCE, SUPPORT = 0.8, 3
#: Added to a pattern's number of instances, so that rare patterns score lower.
SMOOTHING = 1.0
#: A seed besides the base spans: a value of so many letters and digits, both among them, as keys and tokens of programs are.
SECRET = 20
#: Bytes of text looked at together; patterns that are sent to all tasks at once.
SCANNED, MOST_BROADCAST = 2 << 20, 2_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ENDS = re.compile(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$")
_MAYBE = np.zeros(256, bool)
_MAYBE[[*range(48, 58), 64, 95]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RUNS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "context": "[ID]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As by a scan from the left, but started at each @: every try takes time in proportion to what it reads."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end), by kind and start: leftmost and not overlapping within a kind.

    Matches that fail their test are dropped and not tried anew. An address's digits are looked
    for at the start of a run only: a match ends with a run, and if a run's start fails, so do its other digits.
    """
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


class Words:
    """The words between white space of the texts in body, with hashes and the places in code points."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        space = _SPACE[body]
        begins, last = ~space, ~space
        begins[1:] &= space[:-1]
        last[:-1] &= space[1:]
        edge = offsets[(offsets > 0) & (offsets < len(body))]
        begins[edge] = ~space[edge]
        last[edge - 1] = ~space[edge - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(last) + 1
        self.hash = run_hashes(_LOWER[body], self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)
        chars = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
        base = np.repeat(chars[offsets[:-1]], np.diff(self.first))
        #: Code points, from the start of the word's own text.
        self.from_, self.to = chars[self.start] - base, chars[self.end] - base
        marks = np.r_[0, np.cumsum(_MAYBE[body])]
        self.marked = marks[self.end] > marks[self.start]

    def contexts(self, i: np.ndarray, j: np.ndarray, text: np.ndarray) -> np.ndarray:
        """What stands beside the words i to j of a text: hashes of (two words before; the words on both sides; one before; one after)."""
        low, high = self.first[text], self.first[text + 1]
        word = lambda k: np.where((k >= low) & (k < high), self.hash[np.clip(k, 0, max(0, len(self.hash) - 1))] if len(self.hash) else 0, np.uint64(7))
        before, earlier, after = word(i - 1), word(i - 2), word(j + 1)
        odd = np.uint64(0x9E3779B97F4A7C15)
        return np.stack([mix((earlier * odd + before) ^ np.uint64(11)), mix((before * odd + after) ^ np.uint64(13)), mix(before ^ np.uint64(17)), mix(after ^ np.uint64(19))], axis=1)


#: Columns of contexts() that are patterns whatever stands in their slot; all are patterns together with the shape of what stands there.
ANY_SHAPE = 2


def shape(word: str) -> str:
    """Runs of letters and of digits as one sign each, of both together as another."""
    runs = re.sub(r"[a0]{2,}", "x", "".join("a" if r[0].isalpha() else "0" if r[0].isdigit() else r for r in _RUNS.findall(word)))
    return re.sub(r"(.{1,3}?)\1+", r"\1", runs)


def is_secret(core: str) -> bool:
    return len(core) >= SECRET and core.isascii() and core.isalnum() and any(c.isdigit() for c in core) and any(c.isalpha() for c in core)


def patterns_of(context: np.ndarray, word: str) -> list[int]:
    own = np.uint64(int.from_bytes(hashlib.blake2b(shape(word).encode(), digest_size=8).digest(), "little"))
    return np.r_[context[:ANY_SHAPE], mix(context * np.uint64(31) + own)].view(np.int64).tolist()


def instance_of(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower().encode(), digest_size=8).digest(), "little", signed=True)


def candidates(words: Words, k: int, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool, bool, list[int]]]:
    """(start, end, instance, known, base, patterns) of what may be an identifier in text number k.

    Known are the base spans, and secrets (see SECRET); the others are words with a digit, @ or _,
    without the marks around them, that overlap no base span.
    """
    low, high = int(words.first[k]), int(words.first[k + 1])
    from_, to = words.from_[low:high], words.to[low:high]
    covered = sorted((a, b) for _, a, b in base)
    found, i, j = [(a, b, True, True) for a, b in covered], [], []
    ends = np.maximum.accumulate(np.array([b for _, b in covered], np.int64)) if covered else np.zeros(0, np.int64)
    begins = np.array([a for a, _ in covered], np.int64)
    for a, b in covered:
        i.append(int(np.searchsorted(to, a, "right")))
        j.append(int(np.searchsorted(from_, b, "left")) - 1)
    for w in np.flatnonzero(words.marked[low:high]).tolist():
        a, b = int(from_[w]), int(to[w])
        raw = text[a:b]
        core = _ENDS.sub("", raw)
        if any(c in "0123456789@_" for c in core):
            a += raw.index(core)
            b = a + len(core)
            before = int(np.searchsorted(begins, b, "left"))
            if not before or ends[before - 1] <= a:
                found.append((a, b, is_secret(core), False))
                i.append(w)
                j.append(w)
    if not found:
        return []
    at = np.array(i) + low, np.array(j) + low
    contexts = words.contexts(*at, np.full(len(found), k))
    return [(a, b, instance_of(text[a:b]), known, own, patterns_of(c, text[a:b])) for (a, b, known, own), c in zip(found, contexts, strict=True)]


_SPANS = "array<struct<kind:int,start:int,end:int>>"
_CANDIDATES = "array<struct<start:int,end:int,instance:long,known:boolean,base:boolean,patterns:array<long>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    seen = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("known", pa.bool_()), ("base", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))
    for whole in batches:
        body, offsets = utf8(whole.column(1))
        for a, b in slices(offsets, SCANNED):
            batch = whole.slice(a, b - a)
            mine, offs = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            marks = np.searchsorted(np.flatnonzero(_MAYBE[mine]), offs)
            spans, some = [[]] * len(batch), [[]] * len(batch)
            marked = np.flatnonzero(np.diff(marks)).tolist()
            words = Words(mine, offs) if marked else None
            for i in marked:
                text = batch.column(1)[i].as_py()
                base = base_spans(text)
                spans[i] = [{"kind": k, "start": x, "end": y} for k, x, y in base]
                some[i] = [dict(zip(("start", "end", "instance", "known", "base", "patterns"), c)) for c in candidates(words, i, text, base)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kinds), pa.array(some, seen)], ["k", "base", "candidates"])


def bootstrap(seen: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """The patterns that are trusted in the end, from (instance, known, pattern) rows.

    The graph has one link for each pattern and instance that met, however often. A known
    instance scores 1. Each round, a pattern's score is the sum of its instances' scores over
    their number plus SMOOTHING; patterns at or above ``confidence`` that have met ``support``
    instances which score as much raise the others: an instance's score is 1 - prod(1 - score)
    over its trusted patterns. Scores only rise, so trusted patterns stay trusted, and rounds go on
    until there are no more of them. Sums are combined before each shuffle, and the graph's side of
    each join can be split where one pattern or instance has very many links.
    """
    graph = saved(seen.groupBy("pattern", "instance").agg(F.max("known").alias("known")))
    known = saved(graph.groupBy("instance").agg(F.max(F.col("known").cast("double")).alias("was")))
    scores, n_trusted = known.withColumnRenamed("was", "score"), -1
    while True:
        trusted = saved(
            graph.join(scores, "instance")
            .groupBy("pattern")
            .agg((F.sum("score") / (F.count("*") + SMOOTHING)).alias("trust"), F.sum((F.col("score") >= confidence).cast("long")).alias("n"))
            .where((F.col("trust") >= confidence) & (F.col("n") >= support))
            .select("pattern", "trust")
        )
        if n_trusted == (n_trusted := trusted.count()):
            return trusted.select("pattern")
        raised = graph.join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("raised"))
        scores = known.join(raised, "instance", "left").select("instance", F.greatest("was", F.coalesce("raised", F.lit(0.0))).alias("score"))


def common_slots(texts: DataFrame, patterns: DataFrame, met: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """Those of ``patterns`` whose slots are mostly filled with other words than candidates, wherever they occur in the texts.

    ``met`` has (pattern, n): how often candidates fill each. Patterns are sent to all tasks in blocks of MOST_BROADCAST at most.
    """
    out = None
    blocks = 1 + patterns.count() // MOST_BROADCAST
    for block in range(blocks):
        some = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        wanted = np.sort(np.asarray(some.toArrow().column(0).combine_chunks()).view(np.uint64))
        sent = texts.sparkSession.sparkContext.broadcast(wanted)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            wanted, total = sent.value, np.zeros(len(sent.value), np.int64)
            maybe = np.zeros(1 << 20, bool)
            maybe[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            for batch in batches:
                body, offsets = utf8(batch.column(0))
                for a, b in slices(offsets, SCANNED):
                    words = Words(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    at = np.arange(len(words.start))
                    keys = words.contexts(at, at, np.repeat(np.arange(b - a), np.diff(words.first)))[:, :ANY_SHAPE].ravel()
                    keys = keys[maybe[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)]]
                    place = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                    total += np.bincount(place[wanted[place] == keys], minlength=len(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(wanted[total > 0].view(np.int64)), pa.array(total[total > 0])], ["pattern", "total"])

        if len(wanted):
            counted = texts.mapInArrow(count, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
            found = saved(counted.join(met, "pattern").where(F.col("n") < F.lit(confidence) * F.col("total")).select("pattern"))
            out = found if out is None else out.union(found)
    return out if out is not None else patterns.limit(0)


def find_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All spans of personal data in every whole text.

    One pass finds the base spans and the candidates with their contexts; nothing but these,
    and a digest of each text that has candidates, is kept. Contexts around seeds (base spans, and secrets: see SECRET)
    induce patterns, see bootstrap(); those whose slots hold plain words as well are left out by a second pass,
    and candidates beside a trusted pattern become spans of kind 'context', secrets among them.
    Texts that are equal have equal spans, so found spans are joined by the text's
    digest, and texts without candidates take no part in the join.
    Null texts are empty; texts of any length are looked at whole; repeated rows are each reported; a table
    without seeds gets no context spans, and an empty one no rows; columns may have any name.

    Returns row (a struct of df's columns without text_col), base and context (arrays of kind, start, end; code points).
    """
    others = [c for c in df.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = df.select(F.struct(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.unhex(F.md5(text.cast("binary"))).alias("digest")).alias("k"), text.alias("text"))
    scanned = saved(keyed.mapInArrow(_scan, f"k {keyed.schema['k'].dataType.simpleString()}, base {_SPANS}, candidates {_CANDIDATES}").select("k.row", "k.digest", "base", "candidates"))
    is_new = F.exists("candidates", lambda c: ~c["base"])
    exploded = scanned.where(F.size("candidates") > 0).select(F.explode("candidates").alias("c"))
    hopeful = bootstrap(exploded.select("c.instance", "c.known", F.explode("c.patterns").alias("pattern")))
    plain = exploded.select(F.explode(F.slice("c.patterns", 1, ANY_SHAPE)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    met = saved(plain.join(hopeful, "pattern"))
    wide = common_slots(df.select(text.alias("text")), met.select("pattern"), met)
    trusted = hopeful.join(wide, "pattern", "left_anti")
    places = scanned.where(is_new).groupBy("digest").agg(F.first("candidates").alias("candidates")).select("digest", F.explode("candidates").alias("c")).where("not c.base").select("digest", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    context = places.join(trusted, "pattern", "left_semi").select("digest", F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end").alias("s")).groupBy("digest").agg(F.array_sort(F.collect_set("s")).alias("context"))
    none = F.array().cast(_SPANS)
    with_new = scanned.where(is_new).join(context, "digest", "left").select("row", "base", F.coalesce("context", none).alias("context"), "digest")
    return scanned.where(~is_new).select("row", "base", none.alias("context"), "digest").unionByName(with_new)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    names = F.array(*map(F.lit, (*KINDS, "context")))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(F.col("row.doc_id").alias("doc_id"), *map(count, range(4)), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "context")).alias("spans"))


def mask_documents(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by the name of its kind; a character count is kept right.

    Spans that overlap are replaced together, under the first one's name. Texts without spans, null ones among them,
    stay as they are; repeated rows stay; texts of any length are masked whole; an empty table stays empty;
    columns may have any name.
    """
    found = find_personal_data(docs.select(text_col)).where((F.size("base") > 0) | (F.size("context") > 0))
    spans = found.select("digest", F.concat("base", "context").alias("spans")).groupBy("digest").agg(F.first("spans").alias("spans"))
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    joined = docs.select(row, digest.alias("digest")).join(spans, "digest", "left").select("row", "spans")
    labels = [MASK[k] for k in (*KINDS, "context")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col)
            hit = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
            changed = {}
            for i in hit.tolist():
                text, out, last = texts[i].as_py() or "", [], 0
                for s in sorted(batch.column(1)[i].as_py(), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= last:
                        out += [text[last : s["start"]], labels[s["kind"]]]
                    last = max(last, s["end"])
                changed[i] = "".join(out) + text[last:]
            if changed:
                new = pa.array([changed.get(i) for i in range(len(batch))], texts.type)
                texts = pc.if_else(new.is_valid(), new, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "masked"])

    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, masked string")
    masked = F.col("masked")
    columns = {text_col: masked} | ({count_col: F.char_length(masked).cast(docs.schema[count_col].dataType)} if count_col in docs.columns else {})
    return out.select(*(columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
