"""Text cleaning as column expressions; null stays null."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from proseline.functions import patterns as P
from proseline.functions.patterns import Newlines


def apply_steps(column: Column, steps: Iterable[tuple[str, str]]) -> Column:
    for pattern, replacement in steps:
        # As a pattern, a trim reads each run of white space once for every character in it.
        column = trim(column) if pattern == P.TRIM else F.regexp_replace(column, F.lit(pattern), F.lit(replacement))
    return column


@dataclass(frozen=True)
class TextCleaner:
    """Cleans text in a fixed order: line ends, paragraph ends, white space, newlines, unwanted
    characters, citations, runs of blanks, and both ends."""

    newlines: Newlines = Newlines.DOUBLE
    basic_ascii: bool = False
    citations: bool = False

    def do_not_reduce_newlines(self) -> TextCleaner:
        return replace(self, newlines=Newlines.KEEP)

    def reduce_newlines_to_single_space(self) -> TextCleaner:
        return replace(self, newlines=Newlines.SPACE)

    def reduce_newlines_to_single_newline(self) -> TextCleaner:
        return replace(self, newlines=Newlines.SINGLE)

    def reduce_newlines_to_double_newline(self) -> TextCleaner:
        return replace(self, newlines=Newlines.DOUBLE)

    def remove_non_basic_ascii(self) -> TextCleaner:
        return replace(self, basic_ascii=True)

    def remove_citations(self) -> TextCleaner:
        return replace(self, citations=True)

    def steps(self) -> list[tuple[str, str]]:
        return P.clean_steps(self.newlines, self.basic_ascii, self.citations)

    def run(self, column: Column) -> Column:
        return apply_steps(column, self.steps())

    def run_text(self, text: str) -> str:
        """The same for one string, for use inside a task."""
        return run_steps(text, tuple(self.steps()))


@cache
def _compiled(steps: tuple[tuple[str, str], ...]) -> list:
    return [(None if p == P.TRIM else P.python_pattern(p), r) for p, r in steps]


def run_steps(text: str, steps: tuple[tuple[str, str], ...]) -> str:
    for pattern, replacement in _compiled(steps):
        text = text.strip(P.WHITE_SPACE_CHARS) if pattern is None else pattern.sub(replacement, text)
    return text


def normalize_whitespace(column: Column) -> Column:
    """One kind of line end and blank; nothing is collapsed or trimmed."""
    return apply_steps(column, P.normalize_steps())


def strip_unwanted_chars(column: Column) -> Column:
    return apply_steps(column, P.strip_steps())


def reduce_to_single_whitespace(column: Column) -> Column:
    return apply_steps(column, P.single_whitespace_steps())


def trim(column: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(column, F.lit(P.WHITE_SPACE_CHARS))


def trim_start(column: Column) -> Column:
    return F.ltrim(column, F.lit(P.WHITE_SPACE_CHARS))
