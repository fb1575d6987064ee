"""Splitting as column expressions: paragraphs, lines, sentences, words, graphemes.

Splits are arrays of texts; null means that a text has fewer than two. Only Unicode sentences,
and byte offsets, need Python.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseline.functions.cleaning import TextCleaner, trim, trim_start
from proseline.functions.columns import let
from proseline.functions.patterns import ORDER, Separator
from proseline.functions.patterns import WHITE_SPACE_CLASS as WS
from proseline.operators import segments
from proseline.operators.sentences import raw_sentences

ALNUM = r"[\p{L}\p{N}]"
_JAVA_HAN = r"\p{IsHan}\p{IsHiragana}"
WORD = segments.WORD.replace(r"\p{Han}\p{Hiragana}", _JAVA_HAN)


def _ends_trimmed(pieces: Column) -> Column:
    """Both ends trimmed, but for the end of the last piece, which ends the text; empty pieces are dropped."""
    return let(pieces, lambda ps: F.filter(F.transform(ps, lambda p, i: F.when(i == F.size(ps) - 1, trim_start(p)).otherwise(trim(p))), lambda p: p != ""))


def _unicode_sentences(text: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [t[a:b] for a, b in segments.ranges(t, Separator.SENTENCES_UNICODE)] for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)


def _from_last_word(token: Column) -> Column:
    """What a text's first token, with nothing before it, keeps: its last word and the rest."""
    word = F.try_element_at(F.filter(F.regexp_extract_all(token, F.lit(f"({WORD})"), F.lit(1)), lambda w: w.rlike(ALNUM)), F.lit(-1))
    return let(word, lambda w: F.coalesce(F.concat(w, F.call_function("substring_index", token, w, F.lit(-1))), token))


def _words(text: Column) -> Column:
    """The text is cut at its white space once; the last token with a letter or number goes on to the end of the text."""

    def marked(x: Column) -> Column:
        tokens = F.filter(F.transform(x["parts"], lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: p["t"].rlike(ALNUM))
        return F.struct(x["text"].alias("text"), x["parts"].alias("parts"), tokens.alias("tokens"))

    def join(x: Column) -> Column:
        tokens, n = x["tokens"], F.size(x["tokens"])
        last = F.element_at(tokens, -1)["i"]
        # The parts from the last token on, and the white space between them.
        size = F.aggregate(F.slice(x["parts"], last + 1, F.size(x["parts"]) - last), F.lit(-1), lambda n, p: n + F.char_length(p) + 1)
        tail = F.substring(x["text"], F.char_length(x["text"]) - size + 1, size)
        # The first token of a text has nothing before it.
        token = lambda t, i: F.when((t["i"] == 0) & (i == 0), _from_last_word(t["t"])).otherwise(t["t"])
        whole = F.concat(F.transform(F.slice(tokens, 1, n - 1), token), F.array(F.when(last == 0, _from_last_word(tail)).otherwise(tail)))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(whole)

    parts = let(text, lambda t: F.struct(t.alias("text"), F.split(t, f"[{WS}]", -1).alias("parts")))
    return F.when(text.isNotNull(), let(let(parts, marked), join))


def pieces(text: Column, separator: Separator) -> Column:
    """All pieces of a text by one separator, without cleaning it, be there two or not; null stays null."""
    separator = Separator(separator)
    if separator is Separator.PARAGRAPHS:
        return _ends_trimmed(F.split(text, r"\n{2,}", -1))
    if separator is Separator.LINES:
        return _ends_trimmed(F.split(text, r"\n", -1))
    if separator is Separator.SENTENCES_RULE:
        return _ends_trimmed(raw_sentences(text))
    if separator is Separator.SENTENCES_UNICODE:
        return _unicode_sentences(text)
    if separator is Separator.WORDS:
        return _words(text)
    return F.regexp_extract_all(text, F.lit(r"(\X)"), F.lit(1))


def clean_for(text: Column, separator: Separator) -> Column:
    """The text cleaned as splitting on a separator needs it."""
    return TextCleaner(Separator(separator).newlines).run(text)


@dataclass(frozen=True)
class TextSplitter:
    """Splits on a separator; recursive: on the first of it and the finer ones that gives two pieces or more."""

    separator: Separator = Separator.PARAGRAPHS
    recursive: bool = True
    clean_text: bool = True

    def on_separator(self, separator: Separator | str) -> TextSplitter:
        return replace(self, separator=Separator(separator))

    def on_two_plus_newline(self) -> TextSplitter:
        return self.on_separator(Separator.PARAGRAPHS)

    def on_single_newline(self) -> TextSplitter:
        return self.on_separator(Separator.LINES)

    def on_sentences_rule_based(self) -> TextSplitter:
        return self.on_separator(Separator.SENTENCES_RULE)

    def on_sentences_unicode(self) -> TextSplitter:
        return self.on_separator(Separator.SENTENCES_UNICODE)

    def on_words_unicode(self) -> TextSplitter:
        return self.on_separator(Separator.WORDS)

    def on_graphemes_unicode(self) -> TextSplitter:
        return self.on_separator(Separator.GRAPHEMES)

    def with_recursion(self, recursive: bool) -> TextSplitter:
        return replace(self, recursive=recursive)

    def with_cleaning(self, clean_text: bool) -> TextSplitter:
        return replace(self, clean_text=clean_text)

    def _separators(self) -> list[Separator]:
        return ORDER[ORDER.index(self.separator) :] if self.recursive else [self.separator]

    def split_text(self, text: Column) -> Column:
        """The pieces; null where there are fewer than two."""
        return self.split(text)["texts"]

    def split(self, text: Column) -> Column:
        """A struct of the separator that was used and the texts; null where there are fewer than two.

        Where Unicode sentences are among the choices, the choice is made in one Python call, as
        a call inside a condition would be made for every row in any case.
        """
        cleaned = clean_for(text, self.separator) if self.clean_text else text
        if Separator.SENTENCES_UNICODE in self._separators()[1:]:
            return _split_udf(self.separator.value)(cleaned)
        if self.separator is Separator.SENTENCES_UNICODE:
            return _if_several(pieces(cleaned, self.separator), self.separator)
        return let(cleaned, lambda t: F.coalesce(*(_if_several(pieces(t, s), s) for s in self._separators())))


def _if_several(texts: Column, separator: Separator) -> Column:
    return let(texts, lambda x: F.when(F.size(x) > 1, F.struct(F.lit(separator.value).alias("separator"), x.alias("texts"))))


def _split_udf(first: str):  # noqa: ANN202
    @F.arrow_udf("struct<separator:string,texts:array<string>>")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            found = None if t is None else segments.split_recursively(t, Separator(first))
            out.append(found and {"separator": found[0].value, "texts": [t[a:b] for a, b in found[1]]})
        return pa.array(out, pa.struct([("separator", pa.string()), ("texts", pa.list_(pa.string()))]))

    return run


def split_again(text: Column, separator: Separator) -> Column:
    """A piece split on by the separators finer than its own: a struct of the separator used and the texts, or null.

    For a column of pieces, one a row, as split_rows() gives them: an array has to be exploded first.
    """
    finer = Separator(separator).next()
    if finer is None:
        return F.lit(None).cast("struct<separator:string,texts:array<string>>")
    return _split_udf(finer.value)(text)


def split_indices(text: Column, separator: Separator) -> Column:
    """The pieces' (start, end) in UTF-8 bytes."""
    name = Separator(separator).value

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array) -> pa.Array:
        out = [None if t is None else [{"start": a, "end": b} for a, b in segments.byte_ranges(t, Separator(name))] for t in texts.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return run(text)


def split_part(text: Column, start: Column, end: Column, separator: Separator) -> Column:
    """The pieces of a part of a text, from byte start to byte end, as (start, end) in bytes of the whole text.

    The part is split as if it were a text; null if an argument is null, or an end is inside a character or beyond the text.
    """
    name = Separator(separator).value
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one(t: str | None, a: int | None, b: int | None) -> list[dict] | None:
        data = None if t is None else t.encode()
        if data is None or a is None or b is None or not 0 <= a <= b <= len(data) or any(x < len(data) and data[x] & 0xC0 == 0x80 for x in (a, b)):
            return None
        return [{"start": a + x, "end": a + y} for x, y in segments.byte_ranges(data[a:b].decode(), Separator(name))]

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([one(*x) for x in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True)], kind)

    return run(text, start.cast("int"), end.cast("int"))


def splits_to_text(texts: Column, separator: Separator, with_separator: bool = False) -> Column:
    """The pieces joined again: by blanks, by nothing for graphemes, or each paragraph or line with its newlines."""
    separator = Separator(separator)
    if separator is Separator.GRAPHEMES:
        return F.array_join(texts, "")
    if with_separator and separator in (Separator.PARAGRAPHS, Separator.LINES):
        newlines = "\n\n" if separator is Separator.PARAGRAPHS else "\n"
        return F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit(newlines))), "")
    return F.array_join(texts, " ")


def split_rows(df: DataFrame, text_col: str, splitter: TextSplitter, keep: list[str]) -> DataFrame:
    """One row for each split: the kept columns, separator, split_idx, text and char_count. Texts that do not split give none.

    Only the kept columns and the splits pass the generator; the whole text does not.
    """
    found = df.select(*keep, splitter.split(F.col(text_col)).alias("__split"))
    rows = found.select(*keep, F.col("__split.separator").alias("separator"), F.posexplode_outer("__split.texts").alias("split_idx", "text"))
    # Not posexplode(): the filter that Spark infers for it would split every text a second time.
    return rows.where("split_idx is not null").withColumn("char_count", F.char_length("text"))
