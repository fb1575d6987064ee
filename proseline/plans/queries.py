"""The driver queries of the text operators, and their SQL.

The tables hold clean prose, so most queries first put in what the operators are for (line ends,
odd blanks, citations, links) with expressions that the oracle repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.functions import patterns as P
from proseline.functions.cleaning import TextCleaner, apply_steps, normalize_whitespace, reduce_to_single_whitespace, strip_unwanted_chars
from proseline.functions.concat import TextConcatenator
from proseline.functions.html import clean_html
from proseline.functions.patterns import ORDER, Newlines, Separator
from proseline.functions.tokens import TokenCounter
from proseline.functions.urls import extract_urls
from proseline.operators.chunking import TextChunker, chunk_rows
from proseline.operators.sentences import HIDE, SENTENCE, SHOW, SHOW_TEXT, split_text_into_sentences
from proseline.operators.splitting import TextSplitter, clean_for, pieces, split_again, split_indices, split_part, split_rows, splits_to_text
from proseline.sources.balance import spread
from proseline.plans.statistics import balance, chunk_statistics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What is put into the texts: (found, put in its place).
MESS = [(". ", ".\r\n\t"), (", ", ",  "), (" de ", "\xa0de \n"), (" the ", " \\t the\\n "), (" en ", "\x0b\x0cen  \r"), (" of ", " of [12]　/")]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def _messy(text: Column) -> Column:
    for old, new in MESS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _sql_text(text: str) -> str:
    return "'" + "".join(f"' || chr({ord(c)}) || '" if ord(c) < 32 or ord(c) > 126 or c == "'" else c for c in text) + "'"


def _messy_sql(text: str) -> str:
    for old, new in MESS:
        text = f"replace({text}, {_sql_text(old)}, {_sql_text(new)})"
    return text


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _cleaning(name: str, make: Callable[[Column], Column], steps: list[tuple[str, str]]) -> None:
    sql = f"SELECT doc_id, {P.duckdb_sql(_messy_sql('text'), steps)} AS text FROM documents"
    query(name, sql)(lambda spark, sf: _table(spark, sf, "documents").select("doc_id", make(_messy(F.col("text"))).alias("text")))


def _steps(name: str, steps: list[tuple[str, str]]) -> None:
    _cleaning(name, lambda c: apply_steps(c, steps), steps)


_steps("c1_line_ends", P.normalize_steps()[:1])
_steps("c2_paragraph_ends", P.normalize_steps()[1:2])
_steps("c3_white_space", P.normalize_steps()[2:])
_steps("c10_collapse_and_trim", P.clean_steps(Newlines.KEEP)[-2:])
for _name, _cleaner in {
    "c4_clean_single_space": TextCleaner().reduce_newlines_to_single_space(),
    "c5_clean_single_newline": TextCleaner().reduce_newlines_to_single_newline(),
    "c6_clean_double_newline": TextCleaner().reduce_newlines_to_double_newline(),
    "c7_clean_keep_newlines": TextCleaner().do_not_reduce_newlines(),
    "c8_remove_non_basic_ascii": TextCleaner().remove_non_basic_ascii(),
    "c9_remove_citations": TextCleaner().remove_citations(),
    "c11_full_cleaner": TextCleaner().reduce_newlines_to_single_newline().remove_non_basic_ascii().remove_citations(),
}.items():
    _cleaning(_name, _cleaner.run, _cleaner.steps())
_cleaning("c12_normalize_whitespace", normalize_whitespace, P.normalize_steps())
_cleaning("c13_strip_unwanted_chars", strip_unwanted_chars, P.strip_steps())
_cleaning("c14_reduce_to_single_whitespace", reduce_to_single_whitespace, P.single_whitespace_steps())


@query("h1_clean_html")
def _html(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "pages").select("page_id", clean_html(F.col("html")).alias("text"))


@query("h1_clean_html_checks", "SELECT page_id, false AS has_tags, false AS has_script, false AS is_empty FROM pages")
def _html_checks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _html(spark, sf).select("page_id", text.rlike("</?[a-z]").alias("has_tags"), text.contains("track(").alias("has_script"), (text == "").alias("is_empty"))


@query("u1_extract_urls", "SELECT page_id, 1 AS n_urls, url AS urls FROM pages")
def _urls(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    text = F.concat(F.lit("see "), url, F.lit(", and ("), F.upper(F.regexp_extract(url, "^[a-z]+://[^/]*", 0)), F.regexp_replace(url, "^[a-z]+://[^/]*", ""), F.lit(")."))
    urls = extract_urls(text)
    return _table(spark, sf, "pages").select("page_id", F.size(urls).alias("n_urls"), F.array_join(urls, " ").alias("urls"))


def _concat(name: str, joiner: TextConcatenator) -> None:
    sql = f"SELECT conv_id, string_agg(text, {_sql_text(joiner.delimiter)} ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id"
    query(name, sql)(lambda spark, sf: _table(spark, sf, "conversations").groupBy("conv_id").agg(joiner.join_group(F.col("text"), F.col("turn")).alias("text")))


_concat("k1_concat_double_newline", TextConcatenator().concate_deol())
_concat("k2_concat_single_newline", TextConcatenator())
_concat("k3_concat_space", TextConcatenator().concate_space())
_concat("k4_concat_comma", TextConcatenator().concate_comma())
_concat("k5_concat_custom", TextConcatenator().concate_custom(" | "))

_CLEAN_LINES = P.duckdb_sql("text", P.clean_steps(Newlines.SINGLE))
_CLEAN_SPACE = P.duckdb_sql("text", P.clean_steps(Newlines.SPACE))
_TRIMMED = P.duckdb_sql("x", [(P.TRIM, "")])
_TALKS = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id)"
_CLEAN_TALKS = P.duckdb_sql("text", P.clean_steps(Newlines.DOUBLE))


def _talks(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["k1_concat_double_newline"](spark, sf)


def _split_sql(key: str, source: str, cleaned: str, pattern: str) -> str:
    return f"""
WITH s AS (SELECT {key}, string_split_regex({cleaned}, '{pattern}') AS parts FROM {source}),
u AS (SELECT {key}, list_filter(list_transform(parts, lambda x: {_TRIMMED}), lambda x: x <> '') AS parts FROM s)
SELECT {key}, unnest(range(0, len(parts)))::INTEGER AS split_idx, unnest(parts) AS text, length(unnest(parts))::INTEGER AS char_count FROM u WHERE len(parts) > 1
"""


@query("p1_split_paragraphs", _split_sql("conv_id", _TALKS, _CLEAN_TALKS, "\\n\\n+"))
def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(_talks(spark, sf), "text", TextSplitter(recursive=False), ["conv_id"]).drop("separator")


@query("p2_split_newlines", _split_sql("doc_id", "documents", _CLEAN_LINES, "\\n"))
def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(_table(spark, sf, "documents"), "text", TextSplitter(recursive=False).on_single_newline(), ["doc_id"]).drop("separator")


def _hidden_sql(text: str) -> str:
    """The substitutions that hide periods. Periods between single letters are found pair by pair, as the patterns here know no look-around."""
    for pattern, replacement in HIDE:
        if "(?<=" in pattern:
            text = f"regexp_replace({text}, '([A-Za-z])\\.([A-Za-z])\\.', '\\1&-&\\2&-&', 'g')"
            for _ in range(12):
                text = f"regexp_replace({text}, '([A-Za-z]&-&[A-Za-z])\\.', '\\1&-&', 'g')"
            continue
        to = re.sub(r"\$(\d)", r"\\\1", replacement)
        text = f"regexp_replace({text}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return text


def _shown_sql(text: str) -> str:
    for marker, shown in SHOW_TEXT:
        text = f"replace({text}, {_sql_text(marker)}, {_sql_text(shown)})"
    for pattern, replacement in SHOW:
        to = re.sub(r"\$(\d)", r"\\\1", replacement)
        text = f"regexp_replace({text}, {_sql_text(pattern)}, {_sql_text(to)}, 'g')"
    return text


def _sentences_sql(source: str, key: str) -> str:
    """CTEs up to t(key, t, parts): the rules' sentences of the column t of ``source``."""
    return f"""h AS (SELECT *, regexp_extract_all({_hidden_sql("t")}, {_sql_text(SENTENCE)}) AS raw FROM {source}),
f AS (SELECT *, [x FOR x, i IN raw IF NOT coalesce(raw[i + 1][1:1] IN ('.', '?', '!'), false)] AS kept FROM h),
s AS (SELECT * EXCLUDE (raw, kept), list_transform(kept, lambda x: {_shown_sql("x")}) AS parts FROM f)"""


_RULE_SQL = f"""
WITH c AS (SELECT doc_id, {_CLEAN_SPACE} AS t FROM documents), {_sentences_sql("c", "doc_id")},
n AS (SELECT doc_id, t, parts, list_sum(list_transform(parts, lambda x: strlen(x))) AS total FROM s),
b AS (SELECT doc_id, t, parts, list_transform(range(1, len(parts) + 1), lambda i: coalesce(list_sum(list_transform(parts[1 : i - 1], lambda x: strlen(x))), 0)) AS starts FROM n WHERE total = strlen(t)),
r AS (SELECT doc_id, CASE WHEN array_to_string(parts, '') = t THEN parts ELSE list_transform(range(1, len(parts) + 1), lambda i: decode(unhex(substr(hex(encode(t)), (2 * starts[i] + 1)::INTEGER, (2 * strlen(parts[i]))::INTEGER)))) END AS cut FROM b),
u AS (SELECT doc_id, list_filter(list_transform(cut, lambda x, i: CASE WHEN i = len(cut) THEN regexp_replace(x, '{P.LEADING_SPACE}', '') ELSE {_TRIMMED} END), lambda x: x <> '') AS parts FROM r)
SELECT doc_id, unnest(range(0, len(parts)))::INTEGER AS split_idx, unnest(parts) AS text, length(unnest(parts))::INTEGER AS char_count FROM u WHERE len(parts) > 1
"""


@query("p3_split_sentences_rule", _RULE_SQL)
def _rule(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(_table(spark, sf, "documents"), "text", TextSplitter(recursive=False).on_sentences_rule_based(), ["doc_id"]).drop("separator")


@query("p4_split_sentences_unicode")
def _unicode(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(_table(spark, sf, "documents"), "text", TextSplitter(recursive=False).on_sentences_unicode(), ["doc_id"]).drop("separator")


_A, _NA = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
_WORDS_SQL = f"""
WITH c AS (SELECT doc_id, {_CLEAN_SPACE} AS t FROM documents),
l AS (SELECT doc_id, t, regexp_extract(t, '([^{P.WHITE_SPACE_CLASS}]*{_A}{_NA}*)\\z', 1) AS fin FROM c),
h AS (SELECT doc_id, fin, list_filter(regexp_extract_all(left(t, length(t) - length(fin)), '[^{P.WHITE_SPACE_CLASS}]+'), lambda x: regexp_matches(x, '{_A}')) AS toks,
        regexp_matches(t, '^[^{P.WHITE_SPACE_CLASS}]*{_A}') AS opens FROM l WHERE fin <> ''),
w AS (SELECT doc_id, list_append(list_transform(toks, lambda x, i: CASE WHEN i = 1 AND opens THEN regexp_extract(x, '((?:[\\p{{L}}\\p{{M}}\\p{{N}}_]*[\\p{{L}}\\p{{M}}][.:])*[\\p{{L}}\\p{{M}}\\p{{N}}_]+{_NA}*)\\z', 1) ELSE x END), fin) AS parts FROM h)
SELECT doc_id, unnest(range(0, len(parts)))::INTEGER AS split_idx, unnest(parts) AS text, length(unnest(parts))::INTEGER AS char_count FROM w WHERE len(parts) > 1
"""


@query("p5_split_words", _WORDS_SQL)
def _words(spark: SparkSession, sf: str) -> DataFrame:
    return split_rows(_table(spark, sf, "documents"), "text", TextSplitter(recursive=False).on_words_unicode(), ["doc_id"]).drop("separator")


@query("p6_grapheme_counts", f"SELECT doc_id, length_grapheme({_CLEAN_SPACE})::INTEGER AS n_graphemes FROM documents")
def _graphemes(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.size(pieces(clean_for(F.col("text"), Separator.GRAPHEMES), Separator.GRAPHEMES)).alias("n_graphemes"))


@query("p9_recursive_separator")
def _recursive(spark: SparkSession, sf: str) -> DataFrame:
    found = TextSplitter().split(F.col("text"))
    return _table(spark, sf, "documents").select("doc_id", found.alias("s")).select("doc_id", F.col("s.separator").alias("separator"), F.size("s.texts").alias("n_splits"))


@query("p10_split_uncleaned", f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {_TRIMMED} <> ''))::INTEGER AS n_lines FROM documents")
def _uncleaned(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.size(pieces(F.col("text"), Separator.LINES)).alias("n_lines"))


@query("p13_split_again")
def _again(spark: SparkSession, sf: str) -> DataFrame:
    rows = split_rows(_table(spark, sf, "documents"), "text", TextSplitter(recursive=False).on_single_newline(), ["doc_id"])
    again = rows.select("doc_id", "split_idx", split_again(F.col("text"), Separator.LINES).alias("again"))
    return again.select("doc_id", "split_idx", F.col("again.separator").alias("separator"), F.coalesce(F.size("again.texts"), F.lit(0)).alias("n_splits"))


_LINES_SQL = f"list_filter(list_transform(string_split({_CLEAN_LINES}, chr(10)), lambda x: {_TRIMMED}), lambda x: x <> '')"


def _joined(with_separator: bool) -> Query:
    lines = lambda: pieces(clean_for(F.col("text"), Separator.LINES), Separator.LINES)
    return lambda spark, sf: _table(spark, sf, "documents").select("doc_id", splits_to_text(lines(), Separator.LINES, with_separator).alias("text"))


query("p14_join_splits", f"SELECT doc_id, array_to_string({_LINES_SQL}, ' ') AS text FROM documents")(_joined(False))
query("p14_join_splits_with_separator", f"SELECT doc_id, array_to_string(list_transform({_LINES_SQL}, lambda x: x || chr(10)), '') AS text FROM documents")(_joined(True))


@query("p16_separator_cleaning", " UNION ALL ".join(f"SELECT doc_id, '{s.value}' AS separator, {P.duckdb_sql(_messy_sql('text'), P.clean_steps(s.newlines))} AS text FROM documents" for s in (Separator.PARAGRAPHS, Separator.LINES, Separator.WORDS)))
def _separator_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*(F.struct(F.lit(s.value).alias("separator"), clean_for(_messy(F.col("text")), s).alias("text")) for s in (Separator.PARAGRAPHS, Separator.LINES, Separator.WORDS)))
    return _table(spark, sf, "documents").select("doc_id", F.inline(kinds))


_CATALOGUE = [("two_plus_newline", 1, "semantic", "single_newline", True), ("single_newline", 2, "semantic", "sentences_rule_based", True), ("sentences_rule_based", 3, "semantic", "sentences_unicode", True), ("sentences_unicode", 4, "semantic", "words_unicode", True), ("words_unicode", 5, "syntactic", "graphemes_unicode", True), ("graphemes_unicode", 6, "syntactic", None, False)]


@query("p18_separators", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}', {'NULL' if d is None else repr(d)}, {str(e).lower()})" for a, b, c, d, e in _CATALOGUE) + ") AS t(separator, ordinal, group_name, next_separator, in_chunking)")
def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(s.value, i + 1, s.group, s.next() and s.next().value, s in Separator.chunking_order()) for i, s in enumerate(ORDER)]
    return spark.createDataFrame(rows, "separator string, ordinal int, group_name string, next_separator string, in_chunking boolean")


_STRINGS_SQL = f"""
WITH c AS (SELECT doc_id, {_CLEAN_SPACE} AS t FROM documents), {_sentences_sql("c", "doc_id")},
u AS (SELECT doc_id, list_transform(parts, lambda x: {_TRIMMED}) AS parts FROM s)
SELECT doc_id, unnest(range(0, len(parts)))::INTEGER AS sentence_idx, unnest(parts) AS text FROM u
"""


@query("p19_sentences_as_strings", _STRINGS_SQL)
def _sentence_strings(spark: SparkSession, sf: str) -> DataFrame:
    out = split_text_into_sentences(clean_for(F.col("text"), Separator.SENTENCES_RULE), keep_separator=False)
    return _table(spark, sf, "documents").select("doc_id", F.posexplode_outer(out).alias("sentence_idx", "text")).where("sentence_idx is not null")


@query(
    "p20_line_offsets",
    f"""
WITH s AS (SELECT doc_id, {_LINES_SQL} AS parts FROM documents), u AS (SELECT doc_id, unnest(range(0, len(parts))) AS i, unnest(parts) AS p FROM s),
o AS (SELECT doc_id, i, p, sum(strlen(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id, i::INTEGER AS split_idx, (e - strlen(p) - 1)::INTEGER AS "start", (e - 1)::INTEGER AS "end" FROM o
""",
)
def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    found = split_indices(clean_for(F.col("text"), Separator.LINES), Separator.LINES)
    return _table(spark, sf, "documents").select("doc_id", F.posexplode_outer(found).alias("split_idx", "r")).where("split_idx is not null").select("doc_id", "split_idx", "r.start", "r.end")


@query(
    "p12_split_part",
    f"""
WITH d AS (SELECT doc_id, {_CLEAN_LINES} AS t FROM documents), h AS (SELECT doc_id, hex(encode(t)) AS b, strlen(t) AS n FROM d WHERE regexp_full_match(t, '[\\x00-\\x7F]*')),
s AS (SELECT doc_id, n // 4 AS o, string_split(decode(unhex(substr(b, (2 * (n // 4) + 1)::INTEGER, (2 * (n // 2))::INTEGER))), chr(10)) AS parts FROM h),
u AS (SELECT doc_id, o, parts, unnest(range(1, len(parts) + 1)) AS i FROM s),
p AS (SELECT doc_id, i, parts[i] AS x, o + coalesce(list_sum(list_transform(parts[1 : i - 1], lambda y: strlen(y) + 1)), 0) AS a, i = len(parts) AS fin FROM u),
r AS (SELECT doc_id, i, a + strlen(x) - strlen(regexp_replace(x, '{P.LEADING_SPACE}', '')) AS "start", CASE WHEN fin THEN a + strlen(x) ELSE a + strlen(regexp_replace(x, '{P.TRAILING_SPACE}', '')) END AS "end" FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS split_idx, "start"::INTEGER AS "start", "end"::INTEGER AS "end" FROM r WHERE "start" < "end"
""",
)
def _part(spark: SparkSession, sf: str) -> DataFrame:
    """The middle half of each ASCII text, split into lines that are placed in the whole text."""
    docs = _table(spark, sf, "documents").select("doc_id", clean_for(F.col("text"), Separator.LINES).alias("t")).where(F.char_length("t") == F.octet_length("t"))
    n = F.octet_length("t")
    found = split_part(F.col("t"), F.floor(n / 4).cast("int"), F.floor(n / 4).cast("int") + F.floor(n / 2).cast("int"), Separator.LINES)
    return docs.select("doc_id", F.posexplode_outer(found).alias("split_idx", "r")).where("split_idx is not null").select("doc_id", "split_idx", "r.start", "r.end")


@query("t1_token_count_whitespace", f"SELECT doc_id, len(regexp_extract_all(text, '[^{P.WHITE_SPACE_CLASS}]+'))::INTEGER AS n_tokens FROM documents")
def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", TokenCounter().count(F.col("text")).alias("n_tokens"))


@query("t1_token_count_bpe")
def _bpe(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", TokenCounter.default().count(F.col("text")).alias("n_tokens"))


CHUNKER = TextChunker(128, counter=TokenCounter())


def _chunks(spark: SparkSession, sf: str, chunker: TextChunker = CHUNKER) -> DataFrame:
    return chunk_rows(spark.read.parquet(f"{sf}/documents.parquet"), "text", chunker, ["doc_id", "lang"])


query("x3_chunk_documents")(lambda spark, sf: _chunks(spark, sf).drop("lang"))
query("x3_chunk_documents_bpe")(lambda spark, sf: _chunks(spark, sf, TextChunker(256)).drop("lang"))
query("x6_chunk_linear")(lambda spark, sf: _chunks(spark, sf, TextChunker(128, use_whole_pieces=False, counter=TokenCounter())).drop("lang"))
query("x7_chunk_overlap")(lambda spark, sf: _chunks(spark, sf, CHUNKER.with_overlap(0.166666)).drop("lang"))


def _tokens_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{P.WHITE_SPACE_CLASS}]+'))"


def _letters(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def _invariants(chunker: TextChunker) -> Query:
    """Per document: its rows by kind, chunks over the limit, gaps in the numbering, and counts that are not the text's own;
    and whether the chunks have all of its letters and numbers but for a word or two at the start, which splitting on words may lose."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        chunks = chunk_rows(docs.withColumn("letters", _letters(F.col("text"))), "text", chunker, ["doc_id", "letters"])
        lost = F.max("letters") - F.coalesce(F.sum(_letters(F.col("text"))), F.lit(0))
        by_doc = chunks.groupBy("doc_id").agg(
            F.sum((F.col("token_count") > chunker.max_tokens).cast("int")).alias("over_limit"),
            (F.max("chunk_idx") + 1 - F.count("*")).alias("gaps"),
            F.sum((F.col("token_count") != TokenCounter().count(F.col("text"))).cast("int")).alias("miscounted"),
            F.coalesce(lost <= 80, F.lit(False)).alias("whole"),
            F.count("chunk_idx").alias("n"),
            F.max("separator").alias("separator"),
        )
        kind = F.when(F.col("n") == 0, "none").when((F.col("n") == 1) & F.col("separator").isNull(), "one").otherwise("several")
        return by_doc.select("doc_id", *(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("over_limit", "gaps", "miscounted")), (F.col("whole") | (kind == "none")).alias("whole"), (kind == "one").alias("is_one"))

    return run


_KEPT = f"SELECT doc_id, 0 AS over_limit, 0 AS gaps, 0 AS miscounted, true AS whole, coalesce({_tokens_sql(_CLEAN_SPACE)} <= {CHUNKER.max_tokens}, false) AS is_one FROM documents"
query("x3_chunk_invariants", _KEPT)(_invariants(CHUNKER))
query("x7_overlap_invariants", _KEPT)(_invariants(CHUNKER.with_overlap(0.166666)))


@query(
    "x3_unsplit_documents",
    f"SELECT doc_id, 0 AS chunk_idx, text, t AS token_count, length(text)::INTEGER AS char_count FROM (SELECT *, {_tokens_sql('text')}::INTEGER AS t FROM documents) WHERE {_tokens_sql(_CLEAN_SPACE)} <= {CHUNKER.max_tokens}",
)
def _unsplit(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).where("separator is null and chunk_idx is not null").select("doc_id", "chunk_idx", "text", "token_count", "char_count")


def _found(chunker: TextChunker) -> Query:
    """How many documents have rows, and whether nearly all have chunks."""
    return lambda spark, sf: _chunks(spark, sf, chunker).groupBy("doc_id").agg(F.count("chunk_idx").alias("n")).agg(F.count("*").alias("documents"), (F.sum((F.col("n") > 0).cast("int")) >= 0.97 * F.count("*")).alias("nearly_all"))


_ALL = "SELECT count(DISTINCT doc_id) AS documents, true AS nearly_all FROM documents"
query("x3_documents_found", _ALL)(_found(CHUNKER))
query("x3_documents_found_bpe", _ALL)(_found(TextChunker(256)))
query("x7_documents_found", _ALL)(_found(CHUNKER.with_overlap(0.166666)))
query("x6_documents_found", _ALL)(_found(TextChunker(128, use_whole_pieces=False, counter=TokenCounter())))

_NATIVE = f"SELECT lang, length(p)::BIGINT AS c, len(regexp_extract_all(p, '[^{P.WHITE_SPACE_CLASS}]+'))::BIGINT AS t FROM (SELECT lang, unnest({_LINES_SQL}) AS p FROM documents)"


@query(
    "x12_statistics_of_lines",
    f"""SELECT lang, count(*) AS chunk_count, CAST(sum(t) AS BIGINT) // count(*) AS avg_token_size, max(t) AS largest_token_size, min(t) AS smallest_token_size, CAST(sum(t) AS BIGINT) AS all_chunks_token_count,
CAST(sum(c) AS BIGINT) // count(*) AS avg_char_size, max(c) AS largest_char_size, min(c) AS smallest_char_size, CAST(sum(c) AS BIGINT) AS all_chunks_char_count FROM ({_NATIVE}) GROUP BY lang""",
)
def _statistics_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _table(spark, sf, "documents").select("lang", F.explode_outer(pieces(clean_for(F.col("text"), Separator.LINES), Separator.LINES)).alias("text")).where("text is not null")
    return chunk_statistics(lines.select("lang", TokenCounter().count(F.col("text")).alias("token_count"), F.char_length("text").alias("char_count")), ["lang"])


@query("x12_chunk_statistics")
def _statistics(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_statistics(_chunks(spark, sf), ["lang"])


@query("x13_balance")
def _balance(spark: SparkSession, sf: str) -> DataFrame:
    return balance(_chunks(spark, sf), ["doc_id"])


@query("w1_html_to_chunks")
def _html_to_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(_html(spark, sf), "text", TextChunker(64, counter=TokenCounter()), ["page_id"])
