"""Quality classifier: an interpolated modified Kneser-Ney model of bytes, trained on trusted text."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.llm.common import batch_rows, compressed, open_folder, pack_batches, put, releasing, releasing_group, releasing_groups, saved, shared_folder, shuffle_partitions, slices, uncompressed, utf8

#: Bytes of an n-gram. Five bytes and their counts are told apart by 40 bits.
ORDER = 5
#: Text of a batch; n-grams of a shard of the model, by mean; text whose requests one task answers for one shard, if there were one.
BATCH_BYTES, SHARD_GRAMS, ANSWERED = 8 << 20, 1 << 16, 256 << 20
#: Bytes of a batch whose n-grams are widened at once, so that a batch takes about 16 times its text in memory.
BLOCK = 1 << 18
#: The quantile of trusted documents' log perplexities that is a language's threshold, and how many
#: trusted documents a language needs for a threshold of its own.
QUANTILE, LEAST_TRUSTED = 0.99, 20
#: Every so-manieth trusted document, by a hash of its id, sets thresholds and is not trained on.
FOLDS = 5
#: Bytes of median surprise that are added to a document, so that short ones are not judged on a few words.
PRIOR_BYTES = 64
#: Trusted ids up to this number are sent to all tasks; beyond it they are joined.
MOST_BROADCAST = 2_000_000
#: Language tables up to this number of rows are sent to all tasks; beyond it they are joined.
MOST_LANGUAGES = 100_000
#: Log probabilities are sent as multiples of this, in 16 bits: down to exp(-136), less than any byte has after
#: ORDER interpolations by counts of a hundred terabytes.
STEP = 1 / 480

_MASKS = [np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 1)]


def grams(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For every byte the number of the n-gram that ends with it; zero bytes stand before a text."""
    out = body.astype(np.uint64)
    sizes = np.diff(offsets)
    for k in range(1, ORDER):
        for a in range(k, len(body), BLOCK):
            out[a : a + BLOCK] |= body[a - k : min(a + BLOCK, len(body)) - k].astype(np.uint64) << np.uint64(8 * k)
    for k in range(min(ORDER - 1, int(sizes.max(initial=0)))):  # the first bytes of each text see no other text
        at = offsets[:-1][sizes > k] + k
        out[at] &= _MASKS[k + 1]
    return out


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last: an n-gram, its context and all that either backs off to meet in one shard."""
    pair = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards
    return pair[((codes >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]


def _packed_codes(sorted_codes: np.ndarray) -> bytes:
    """Ascending numbers as steps, the steps' low and high bytes apart: most high ones are zero."""
    steps = np.diff(sorted_codes, prepend=np.uint64(0))
    return compressed(steps.view(np.uint8).reshape(-1, 8).T)


def _unpacked_codes(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(uncompressed(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _sum_equal(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[head], np.add.reduceat(counts[order], head) if len(codes) else counts


def _counted(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of texts, ascending, and their counts."""
    codes = grams(body, offsets)
    codes.sort()
    head = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[head], np.diff(np.append(head, len(codes)))


def text_numbers(offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    """For the bytes from a to b the number of the text that each is in."""
    first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
    return np.repeat(np.arange(first, last, dtype=np.uint64), np.diff(np.clip(offsets[first : last + 1], a, b)))


def _by_shard(codes: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in codes), in the order of codes."""
    own = shard_of(codes, shards)
    order = np.argsort(own.astype(np.uint8 if shards <= 256 else np.uint16), kind="stable")
    cuts = np.searchsorted(own[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


class Shard:
    """One shard's n-grams of orders 3 to ORDER with what modified Kneser-Ney needs of them."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        #: By order: n-grams and counts. Below the highest order, a count is that of different bytes before the n-gram.
        self.levels: dict[int, tuple[np.ndarray, np.ndarray]] = {ORDER: (codes, counts)}
        for k in range(ORDER - 1, 1, -1):
            shorter = np.unique(codes) & _MASKS[k]
            codes, n = np.unique(shorter, return_counts=True)
            self.levels[k] = (codes, n.astype(np.int64))

    def statistics(self) -> list[tuple[int, int, int]]:
        """(order, count of counts 1 to 4, how many); and (2, bigram * 16 + 15, its count) for each bigram."""
        out = []
        for k in range(3, ORDER + 1):
            n = np.bincount(np.minimum(self.levels[k][1], 5), minlength=5)
            out += [(k, c, int(n[c])) for c in range(1, 5)]
        codes, n = self.levels[2]
        return out + [(2, int(c) * 16 + 15, int(m)) for c, m in zip(codes, n, strict=True)]


class Lower:
    """Probabilities of orders 1 and 2, at most 2^16 numbers, and every order's discounts."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        counts = np.zeros((256, 256), np.int64)
        of_counts = {k: np.zeros(5, np.int64) for k in range(1, ORDER + 1)}
        for order, key, n in rows:
            if order == 2:
                counts[key >> 12, (key >> 4) & 255] += n
            else:
                of_counts[order][key] += n
        single = (counts > 0).sum(axis=0)
        for order, table in ((2, counts), (1, single)):
            of_counts[order] = np.bincount(np.minimum(table[table > 0], 5), minlength=6)[:5]
        self.discounts = {k: discounts(v) for k, v in of_counts.items()}
        uniform = np.full((1, 256), 1 / 256)
        one = _interpolated(single[None, :], uniform, self.discounts[1])
        self.two = _interpolated(counts, np.broadcast_to(one, (256, 256)), self.discounts[2])


def discounts(n: np.ndarray) -> np.ndarray:
    """D(0), D(1), D(2), D(3 and more) of Chen and Goodman, from how many n-grams have count 1 to 4; kept within 0 and the count."""
    n1, n2, n3, n4 = (float(max(x, 0)) for x in n[1:5])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.1), c - 0.05) for x, c in zip(d, (1, 2, 3), strict=True))])


def _interpolated(counts: np.ndarray, lower: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Probabilities from a row of counts for each context and the lower order's probabilities."""
    total = counts.sum(axis=1, keepdims=True)
    cut = d[np.minimum(counts, 3)]
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (counts - cut + cut.sum(axis=1, keepdims=True) * lower) / total
    return np.where(total > 0, p, lower)


class Scorer:
    """Log probabilities of n-grams of one shard."""

    def __init__(self, shard: Shard, lower: Lower):
        self.lower, self.parts = lower, []
        for k in range(3, ORDER + 1):
            codes, counts = shard.levels[k]
            cut = lower.discounts[k][np.minimum(counts, 3)]
            contexts = codes >> np.uint64(8)
            head = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(codes) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, head) if len(codes) else counts
            freed = np.add.reduceat(cut, head) if len(codes) else cut
            self.parts.append((k, codes, counts - cut, contexts[head], total, freed))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        p = self.lower.two[((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64), (codes & np.uint64(255)).astype(np.int64)].copy()
        for k, known, left, contexts, total, freed in self.parts:
            if not len(known):
                continue
            mine = codes & _MASKS[k]
            at = np.minimum(np.searchsorted(contexts, mine >> np.uint64(8)), len(contexts) - 1)
            seen = contexts[at] == mine >> np.uint64(8)
            gram = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            own = np.where(known[gram] == mine, left[gram], 0.0)
            p = np.where(seen, (own + freed[at] * p) / total[at], p)
        return np.log(p)


class Model:
    """Where the shards' n-grams and counts are, one file each, how many there are, and the low orders."""

    def __init__(self, folder: str, shards: int, lower: Lower):
        self.folder, self.shards, self.lower = folder, shards, lower

    def scorer(self, shard: int) -> Scorer:
        store, path = open_folder(self.folder)
        name = f"{path}/{shard}.bin"
        if store.get_file_info(name).type != pafs.FileType.File:  # no n-gram of it was met
            return Scorer(Shard(np.zeros(0, np.uint64), np.zeros(0, np.int64)), self.lower)
        with store.open_input_file(name) as f:
            table = pa.ipc.open_stream(f).read_all()
        return Scorer(Shard(table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()), self.lower)


def train(texts: DataFrame) -> Model:
    """Count all n-grams of the column ``text`` and write the model's shards to the shared folder.

    Each task sums its n-grams; sums are combined before and after a shuffle by n-gram, so no
    task holds more than its share of the distinct ones. Shards grow in number with these. The driver
    sees their number, the counts of counts and at most 2^16 bigram counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            codes, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            held.clear()
            codes, n = _sum_equal(codes, n)
            for a in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(codes[a : a + (1 << 16)].view(np.int64)), pa.array(n[a : a + (1 << 16)])], ["code", "n"])

        for batch in batches:
            body, offsets = utf8(batch.column(0))
            for a, b in slices(offsets, BATCH_BYTES):
                held.append(_counted(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            if sum(len(c) for c, _ in held) > 4_000_000:
                yield from flush()
        if held:
            yield from flush()

    spark = texts.sparkSession
    counts = saved(texts.select("text").mapInArrow(releasing(count), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    shards = min(1 << 16, max(8, counts.count() // SHARD_GRAMS))
    folder = shared_folder(spark, "model")
    store, path = open_folder(folder)
    store.create_dir(path, recursive=True)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shard_of(np.asarray(batch.column(0)).view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["shard", "code", "n"])

    def write(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        table = table.select(["code", "n"]).sort_by("code")
        out = io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as w:
            w.write_table(table)
        put(folder, f"{number}.bin", np.frombuffer(out.getbuffer(), np.uint8))
        rows = Shard(table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()).statistics()
        return pa.table({x: pa.array(c, pa.int64()) for x, c in zip(("level", "key", "n"), zip(*rows))})

    rows = counts.mapInArrow(assign, "shard int, code long, n long").groupBy("shard").applyInArrow(releasing_group(write), "level long, key long, n long")
    return Model(folder, shards, Lower([tuple(r) for r in rows.groupBy("level", "key").agg(F.sum("n").alias("n")).collect()]))


def perplexities(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (a struct of df's columns without text_col), n_bytes and surprise (natural log, over all bytes of the whole text).

    Texts are packed into compressed batches, which are shuffled once and read twice. Each batch
    asks the model's shards for its distinct n-grams, sorted and stored as steps; a shard
    answers with their log probabilities; the batch adds them up for each text. Requests are dealt by
    shard and read one by one; the task that answers them reads the shard's file once, and holds one
    request and one shard. A shard that very many batches ask is read by several tasks, each for a fixed amount of requests.
    """
    kind = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns if c != text_col)).alias("row")).schema["row"].dataType.toNullable()
    packed = pack_batches(df, text_col, BATCH_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for number, blob in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                body, offsets = utf8(batch_rows(blob).column(1))
                codes = grams(body, offsets)
                codes.sort()
                codes = codes[np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])] if len(codes) else codes
                for s, at in _by_shard(codes, shards):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([number]), pa.array([_packed_codes(codes[at])])], ["shard", "batch", "codes"])

    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    spark, shards = df.sparkSession, model.shards
    salts = 1 + size // (ANSWERED * shards)
    asked = packed.mapInArrow(releasing(ask), "shard int, batch long, codes binary").withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, scorer = -1, None
        for rows in batches:
            for s, x, batch in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if s != number:
                    number, scorer = s, model.scorer(s)
                steps = np.rint(-scorer.log_probabilities(_unpacked_codes(x)) / STEP)
                yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([s], pa.int32()), pa.array([compressed(steps.astype(np.uint16))], pa.binary())], ["batch", "shard", "said"])

    dealt = asked.select("shard", "codes", "batch", "salt").repartition(max(shuffle_partitions(spark), min(shards * salts, 100_000)), "shard", "salt").sortWithinPartitions("shard")
    answers = dealt.select("shard", "codes", "batch").mapInArrow(releasing(answer), "batch long, shard int, said binary")

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({"row": pa.array([], row_type), "n_bytes": pa.array([], pa.int64()), "surprise": pa.array([], pa.float64())})
        rows = batch_rows(own.column("blob")[0].as_py())
        body, offsets = utf8(rows.column(1))
        sizes = np.diff(offsets)
        bits = max(1, int(len(rows)).bit_length())
        both = grams(body, offsets)
        both <<= np.uint64(bits)
        for a in range(0, len(both), BLOCK):
            both[a : a + BLOCK] |= text_numbers(offsets, a, min(a + BLOCK, len(both)))
        both.sort()
        new, found = np.ones(len(both), bool), [np.zeros(0, np.uint64)]
        for a in range(0, len(both), BLOCK):
            codes = both[max(a - 1, 0) : a + BLOCK] >> np.uint64(bits)  # with the one before
            np.not_equal(codes[1:], codes[:-1], out=new[max(a, 1) : a + BLOCK])
            found.append(codes[-len(new[a : a + BLOCK]) :][new[a : a + BLOCK]])
        distinct = np.concatenate(found)
        steps = np.zeros(len(distinct), np.float64)
        said = dict(zip(got.column("shard").to_pylist(), got.column("said").to_pylist(), strict=True))
        for s, at in _by_shard(distinct, shards):
            steps[at] = uncompressed(said[s], np.uint16)
        steps *= STEP
        surprise, which = np.zeros(len(rows)), -1
        for a in range(0, len(both), BLOCK):
            at = np.cumsum(new[a : a + BLOCK]) + which
            which = at[-1]
            surprise += np.bincount((both[a : a + BLOCK] & np.uint64((1 << bits) - 1)).astype(np.int64), weights=steps[at], minlength=len(rows))
        return pa.table({"row": rows.column(0).cast(row_type), "n_bytes": pa.array(sizes), "surprise": pa.array(surprise)})

    from pyspark.sql.pandas.types import to_arrow_type

    row_type = to_arrow_type(kind)
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(releasing_groups(score), f"row {kind.simpleString()}, n_bytes long, surprise double")


def judge(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each document's log perplexity, its language's threshold, and whether it is kept.

    Trusted are all texts whose id is labelled with quality 1 (and not 0 elsewhere). The model is
    trained on all of them but one fold, and scores all texts. A language's threshold is the
    QUANTILE of the log perplexities of that fold, which the model has not seen; languages with
    fewer than LEAST_TRUSTED documents in it use that of the whole fold. A text at its threshold is kept.
    A text's perplexity is mixed with PRIOR_BYTES bytes of its language's median, so that a few words are
    not judged alone: without it, short trusted texts set thresholds that let more bad texts pass.

    Null and empty texts have a null perplexity and are not kept; texts of any length are scored whole. Null ids are
    never trusted; a null language is one of its own. Where no document is trusted there is no threshold, and every
    text is kept. Repeated rows are each judged; an empty table gives no rows; columns may have any name.

    Returns row (a struct of df's columns without text_col), n_bytes, log_ppl, threshold, keep.
    """
    lang = F.coalesce(F.col(f"row.`{lang_col}`").cast("string"), F.lit(""))
    good = saved(labels.select(F.col("doc_id").alias("id"), "quality").where("id is not null and quality is not null").groupBy("id").agg(F.min("quality").alias("q")).where("q = 1").select("id"))
    small = good.count() <= MOST_BROADCAST
    good, held = good.where(F.pmod(F.xxhash64("id"), F.lit(FOLDS)) != 0), good.where(F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    scored = saved(perplexities(df, train(texts.join(F.broadcast(good) if small else good, "id", "left_semi").select("text")), text_col))
    scored = scored.withColumn("l", lang)
    mean = F.col("surprise") / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    trusted = saved(scored.select(F.col(f"row.`{id_col}`").alias("id"), "l", "n_bytes", "surprise", mean.alias("m")).where("m is not null").join(F.broadcast(held) if small else held, "id", "left_semi"))
    middle, mixed = F.percentile_approx("m", 0.5, 10_000), (F.col("surprise") + PRIOR_BYTES * F.col("median")) / (F.col("n_bytes") + PRIOR_BYTES)
    medians = trusted.groupBy("l").agg(middle.alias("median"), F.count("*").alias("n_trusted")).where(F.col("n_trusted") >= LEAST_TRUSTED).select("l", "median")
    medians, all_median = _sent(medians), F.lit(trusted.agg(middle).first()[0]).cast("double")
    edge = F.percentile_approx(mixed, QUANTILE, 10_000)
    per_lang = _sent(trusted.join(medians, "l").groupBy("l", "median").agg(edge.alias("edge")))
    of_all = F.lit(trusted.withColumn("median", all_median).agg(edge).first()[0]).cast("double")
    table = scored.join(per_lang, "l", "left").withColumn("median", F.coalesce("median", all_median))
    table = table.withColumn("log_ppl", F.when(F.col("n_bytes") > 0, F.coalesce(mixed, mean)))
    keep = F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= F.col("threshold"), F.lit(True))
    return table.select("row", "n_bytes", "log_ppl", F.coalesce("edge", of_all).alias("threshold")).withColumn("keep", keep)


def _sent(languages: DataFrame) -> DataFrame:
    """A table with a row for each language, sent to all tasks where it is as small as it usually is."""
    languages = saved(languages)
    return F.broadcast(languages) if languages.count() <= MOST_LANGUAGES else languages


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", "row.lang", "n_bytes", F.exp("log_ppl").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that judge() keeps, with all of their columns, of any names."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.col(f"`{lang_col}`").alias("lang"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"), key["digest"].alias("digest"))
    kept = judge(plain, labels, "id", "text", "lang").where("keep").select("row.id", "row.digest", "row.lang").distinct()
    same = rows["key.id"].eqNullSafe(kept["id"]) & (rows["key.digest"] == kept["digest"]) & rows["key.lang"].eqNullSafe(kept["lang"])
    return rows.join(kept, same, "left_semi").select("row.*")
