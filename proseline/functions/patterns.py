"""Patterns and vocabularies, one copy for Spark (Java), DuckDB (RE2) and Python.

All patterns avoid classes whose meaning differs between the engines: white space is spelt out,
and code points beyond ASCII are written as \\x{...}.
"""

from __future__ import annotations

import re
from enum import Enum

# Line ends, paragraph ends, white space and removable characters of the cleaner.
END_OF_LINE = r"(\\r\\n|\r\n)|(\\r|\r)|(\\v|\x0B)|(\\f|\f)|\\n|\x{2028}"
END_OF_PARAGRAPH = r"\x{2029}"
WHITE_SPACE = r"\\s|(\\t|\t)|[\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
NEWLINES = r"\n+"
TWO_PLUS_NEWLINES = r"\n{2,}"
SPACES = r" +"
WHITE_SPACE_CLASS = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNWANTED_CHARS = r"[^a-zA-Z0-9.,?!:;'\"\-()\[\]{}$&@#%^*" + WHITE_SPACE_CLASS + "]+"
CITATIONS = r"\[\p{Nd}{1,3}\]"
LEADING_SPACE = f"^[{WHITE_SPACE_CLASS}]+"
TRAILING_SPACE = rf"[{WHITE_SPACE_CLASS}]+\z"
TRIM = f"{LEADING_SPACE}|{TRAILING_SPACE}"

#: The characters of Unicode's White_Space, for str.strip().
WHITE_SPACE_CHARS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class Newlines(str, Enum):
    """What the cleaner makes of runs of newlines."""

    SPACE = "space"
    SINGLE = "single"
    DOUBLE = "double"
    KEEP = "keep"


class Separator(str, Enum):
    """What a text is split on, from coarse to fine."""

    PARAGRAPHS = "two_plus_newline"
    LINES = "single_newline"
    SENTENCES_RULE = "sentences_rule_based"
    SENTENCES_UNICODE = "sentences_unicode"
    WORDS = "words_unicode"
    GRAPHEMES = "graphemes_unicode"

    def next(self) -> Separator | None:
        """The next finer separator; None after the last."""
        at = ORDER.index(self) + 1
        return ORDER[at] if at < len(ORDER) else None

    @property
    def group(self) -> str:
        return "semantic" if self in ORDER[:4] else "syntactic"

    @property
    def newlines(self) -> Newlines:
        """How a text is cleaned before it is split on this separator."""
        return {Separator.PARAGRAPHS: Newlines.DOUBLE, Separator.LINES: Newlines.SINGLE}.get(self, Newlines.SPACE)

    @staticmethod
    def chunking_order() -> list[Separator]:
        """The separators that a chunker starts from."""
        return ORDER[:5]


ORDER = list(Separator)


def group_members(group: str) -> list[Separator]:
    return [s for s in ORDER if s.group == group]


def python_pattern(pattern: str) -> re.Pattern:
    """A shared pattern for Python's engine."""
    spelt = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", pattern)
    return re.compile(spelt.replace(r"\p{Nd}", r"\d").replace(r"\z", r"\Z"))


def clean_steps(newlines: Newlines = Newlines.DOUBLE, basic_ascii: bool = False, citations: bool = False) -> list[tuple[str, str]]:
    """The cleaner as (pattern, replacement) steps, in their fixed order."""
    newlines = Newlines(newlines)
    steps = [*normalize_steps()]
    if newlines is not Newlines.KEEP:
        steps.append({Newlines.SPACE: (NEWLINES, " "), Newlines.SINGLE: (NEWLINES, "\n"), Newlines.DOUBLE: (TWO_PLUS_NEWLINES, "\n\n")}[newlines])
    if basic_ascii:
        steps.append((UNWANTED_CHARS, ""))
    if citations:
        steps.append((CITATIONS, ""))
    return [*steps, (SPACES, " "), (TRIM, "")]


def normalize_steps() -> list[tuple[str, str]]:
    return [(END_OF_LINE, "\n"), (END_OF_PARAGRAPH, "\n\n"), (WHITE_SPACE, " ")]


def strip_steps() -> list[tuple[str, str]]:
    return [(UNWANTED_CHARS, ""), (TRIM, "")]


def single_whitespace_steps() -> list[tuple[str, str]]:
    return [(SPACES, " "), (NEWLINES, "\n"), (TRIM, "")]


def duckdb_sql(column: str, steps: list[tuple[str, str]]) -> str:
    """The steps as a DuckDB expression, for oracles."""
    for pattern, replacement in steps:
        to = replacement.replace("\n", "' || chr(10) || '")
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{to}', 'g')"
    return column


def spark_sql(column: str, steps: list[tuple[str, str]]) -> str:
    """The steps as a Spark SQL expression, for functions made by CREATE FUNCTION."""
    for pattern, replacement in steps:
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        to = replacement.replace("\n", "\\n")
        column = f"regexp_replace({column}, '{quoted}', '{to}')"
    return column
