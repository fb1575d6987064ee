"""Rule-based sentences as column expressions.

Periods that end no sentence are hidden behind markers, sentences are cut at the enders that are
left, and the markers are taken back. Where that changes a text's length in bytes, its pieces
cannot be placed, and the text has no sentences.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseline.functions.cleaning import trim
from proseline.functions.columns import let
from proseline.functions.patterns import WHITE_SPACE_CLASS as WS

# The substitutions that hide periods, in their order, and those that take them back.
HIDE = [
    (r"(et al\.)\.", "$1&;&"),
    (r"\.{3}", "&&&."),
    (r"([0-9]+)\.([0-9]+)", "$1&@&$2"),
    (rf"[{WS}]\.([0-9]+)", " &#&$1"),
    (r"(?<=[A-Za-z])\.(?=[A-Za-z]\.)|(?<=[A-Za-z]\.[A-Za-z])\.", "&-&"),
    (r"([A-Z])\.", "$1&_&"),
    (rf"([^.?!]\.|!|\?)([^{WS}\"'])", "$1 $2"),
    (rf"([.?!])[{WS}]?\)", "&==&$1"),
    (rf"'([.?!])[{WS}]?\"", "&^&$1"),
    (rf"([.?!])[{WS}]?\"", "&=&$1"),
    (rf"([.?!])[{WS}]?'\"", "&,&$1"),
    (rf"([.?!])[{WS}]?'", "&##&$1"),
]
SHOW_TEXT = [("&;&", "."), ("&&&", ".."), ("&@&", "."), ("&#&", "."), ("&-&", "."), ("&_&", "."), ("&*&", ".")]
SHOW = [(r"&==&([.!?])", "$1)"), (r"&\^&([.!?])", "'$1\""), (r"&\*\*&([.!?])", "'$1\""), (r"&=&([.!?])", '$1"'), (r"&,&([.!?])", '$1"'), (r"&##&([.!?])", "$1'"), (r"&\$&([.!?])", '$1"')]

#: A sentence: up to an ender and what follows it before the next letter or number; or the rest.
SENTENCE = r"([^.?!]*[.?!][^\p{L}\p{N}.?!]*|[^.?!]+\z)"


def _replace(column: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        column = F.regexp_replace(column, F.lit(pattern), F.lit(replacement))
    return column


def _show(sentence: Column) -> Column:
    for marker, text in SHOW_TEXT:
        sentence = F.replace(sentence, F.lit(marker), F.lit(text))
    return _replace(sentence, SHOW)


def split_text_into_sentences(text: Column, keep_separator: bool = True) -> Column:
    """The sentences as they come out of the rules: lengths may differ from the text's. Without separators, both ends are trimmed.

    A sentence that another ender follows before any letter or number is lost: the next piece starts with that ender.
    """
    found = F.regexp_extract_all(_replace(text, HIDE), F.lit(SENTENCE), F.lit(1))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.coalesce(F.substring(F.try_element_at(ps, i + 2), 1, 1).isin(".", "?", "!"), F.lit(False)))
    return F.transform(let(found, last), lambda s: _show(s) if keep_separator else trim(_show(s)))


def sentence_ranges(text: Column) -> Column:
    """(start, end) in bytes of each sentence before trimming; an empty array where the pieces do not fit the text.

    They do not fit where their lengths do not add up to the text's, or a cut is inside a character.
    """
    sizes = F.transform(split_text_into_sentences(text), F.octet_length)
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(n + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def placed(x: Column) -> Column:
        ranges = F.transform(x["ends"], lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.element_at(x["ends"], i)).alias("start"), e.alias("end")))
        next_byte = lambda e: F.hex(F.substring(x["data"], e + 1, F.lit(1)))
        fits = F.coalesce(F.try_element_at(x["ends"], F.lit(-1)), F.lit(0)) == F.octet_length(x["data"])
        return F.when(fits & ~F.exists(x["ends"], lambda e: next_byte(e).rlike("^[89AB]")), ranges).otherwise(none)

    return F.when(text.isNotNull(), let(F.struct(ends.alias("ends"), text.cast("binary").alias("data")), placed))


def raw_sentences(text: Column) -> Column:
    """The text's own bytes in each of sentence_ranges(), untrimmed.

    Sentences that make up the text as they are need no offsets; these are worked out for the
    few texts that only their lengths fit.
    """

    def own(x: Column) -> Column:
        data = x["text"].cast("binary")
        cut = lambda r: F.substring(data, r["start"] + 1, r["end"] - r["start"]).cast("string")
        size = F.aggregate(x["pieces"], F.lit(0), lambda n, p: n + F.octet_length(p))
        same, fits = F.array_join(x["pieces"], "") == x["text"], size == F.octet_length(x["text"])
        return F.when(same, x["pieces"]).when(fits, F.transform(sentence_ranges(x["text"]), cut)).when(size >= 0, F.array().cast("array<string>"))

    return let(let(text, lambda t: F.struct(t.alias("text"), split_text_into_sentences(t).alias("pieces"))), own)
