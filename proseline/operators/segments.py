"""Splitting inside a task: ranges of one string, for what column expressions cannot say.

Everything here works on Python strings and code point offsets. The chunker needs it, as it
splits pieces of pieces while it packs them; so do Unicode sentences and byte offsets.
"""

from __future__ import annotations

import re

import regex

from proseline.functions.cleaning import run_steps
from proseline.functions.patterns import WHITE_SPACE_CHARS, Separator, clean_steps, python_pattern
from proseline.operators import sentences as S

Range = tuple[int, int]

# Unicode's sentence classes (UAX #29), by a letter each.
SENTENCE_CLASSES = {"CR": "r", "LF": "n", "Sep": "p", "Extend": "x", "Format": "x", "Sp": "s", "Lower": "l", "Upper": "u", "OLetter": "o", "Numeric": "d", "ATerm": "a", "STerm": "t", "SContinue": "c", "Close": "k"}
_CLASS_PATTERNS = [(regex.compile(rf"\p{{Sentence_Break={name}}}"), letter) for name, letter in SENTENCE_CLASSES.items()]


class _SentenceClasses(dict):
    """For str.translate: each character's class, looked up once."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = found = next((letter for pattern, letter in _CLASS_PATTERNS if pattern.match(char)), "z")
        return found


_CLASSES = _SentenceClasses()
_STOP = re.compile(r"(?:rn|[rnp])|(?P<term>[at])x*+(?P<rest>(?:kx*+)*+(?:sx*+)*+)(?P<par>rn|[rnp])?")
_LOWER_FOLLOWS = re.compile(r"[^oulrnpat]*l")


def unicode_sentence_ranges(text: str) -> list[Range]:
    """Sentences by UAX #29, each up to the start of the next."""
    classes = text.translate(_CLASSES)
    out, last = [], 0
    for m in _STOP.finditer(classes):
        end = m.end()
        if m["term"] and not m["par"] and end < len(classes):
            following = classes[end]
            if following in "cat":  # SB8a
                continue
            if m["term"] == "a":
                if not m["rest"]:
                    if following == "d":  # SB6
                        continue
                    before = classes[: m.start()].rstrip("x")[-1:]
                    if following == "u" and before in ("u", "l"):  # SB7
                        continue
                if _LOWER_FOLLOWS.match(classes, end):  # SB8
                    continue
        out.append((last, end))
        last = end
    if last < len(text):
        out.append((last, len(text)))
    return out


_HIDE = [(python_pattern(p.replace(r"\p{L}", "").replace(r"\p{N}", "")), re.sub(r"\$(\d)", r"\\g<\1>", r)) for p, r in S.HIDE]
_SHOW = [(re.compile(p), re.sub(r"\$(\d)", r"\\g<\1>", r)) for p, r in S.SHOW]
_SENTENCE = regex.compile(S.SENTENCE.replace(r"\z", r"\Z"))


def rule_sentences(text: str) -> list[str]:
    """As split_text_into_sentences() of the column expressions."""
    for pattern, replacement in _HIDE:
        text = pattern.sub(replacement, text)
    out = []
    found = _SENTENCE.findall(text)
    for s, following in zip(found, [*found[1:], ""]):
        if following[:1] in (".", "?", "!"):
            continue
        for marker, shown in S.SHOW_TEXT:
            s = s.replace(marker, shown)
        for pattern, replacement in _SHOW:
            s = pattern.sub(replacement, s)
        out.append(s)
    return out


def rule_sentence_ranges(text: str) -> list[Range]:
    """Empty if the sentences' lengths in bytes do not fit the text."""
    sizes = [len(s.encode()) for s in rule_sentences(text)]
    data = text.encode()
    if sum(sizes) != len(data):
        return []
    if text.isascii():
        ends = sizes
        for i in range(1, len(ends)):
            ends[i] += ends[i - 1]
        return list(zip([0, *ends], ends))
    out, at, chars = [], 0, 0
    for n in sizes:
        if at + n < len(data) and data[at + n] & 0xC0 == 0x80:
            return []
        size = len(data[at : at + n].decode(errors="replace"))
        out.append((chars, chars + size))
        at, chars = at + n, chars + size
    return out


#: A word of UAX #29 with a letter or number in it, near enough: joined by marks within, and ideographs alone.
WORD = r"[\p{Han}\p{Hiragana}]|(?:(?![\p{Han}\p{Hiragana}])[\p{L}\p{M}\p{N}_])+(?:(?:(?<=[\p{L}\p{M}])[:·.'’‘․](?=\p{L})|(?<=\p{N})[.,;'’‘](?=\p{N}))(?:(?![\p{Han}\p{Hiragana}])[\p{L}\p{M}\p{N}_])+)*"
_WORD = regex.compile(WORD)
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_GRAPHEME = regex.compile(r"\X")
_SPACE = re.compile(f"[{re.escape(WHITE_SPACE_CHARS)}]")
_NEWLINE = {Separator.PARAGRAPHS: re.compile(r"\n{2,}"), Separator.LINES: re.compile(r"\n")}


def word_ranges(text: str) -> list[Range]:
    """Tokens between white space that hold a word.

    A range runs from a word to the next, and is kept where white space ends it; so the first
    token of a text starts with its last word, and the last range goes on to the end of the text.
    """
    starts = [m.start() for m in _WORD.finditer(text) if _ALNUM.search(m[0])]
    spaces = [m.start() for m in _SPACE.finditer(text)]
    out: list[Range] = []
    k = 0
    for i, start in enumerate(starts):
        while k < len(spaces) and spaces[k] < start:
            k += 1
        begin = spaces[k - 1] + 1 if k else start
        stop = starts[i + 1] if i + 1 < len(starts) else len(text)
        end = len(text) if stop == len(text) else spaces[k] if k < len(spaces) and spaces[k] < stop else begin
        if begin < end:
            out.append((begin, end))
    return out


def _trimmed(text: str, ranges: list[Range]) -> list[Range]:
    """Without white space at both ends, but for what ends the text; empty ranges are dropped."""
    out = []
    for a, b in ranges:
        piece = text[a:b]
        start = b - len(piece.lstrip(WHITE_SPACE_CHARS))
        end = b if b == len(text) else a + len(piece.rstrip(WHITE_SPACE_CHARS))
        if start < end:
            out.append((start, end))
    return out


def ranges(text: str, separator: Separator) -> list[Range]:
    """The text's pieces by one separator, as code point ranges."""
    if separator is Separator.GRAPHEMES:
        return [m.span() for m in _GRAPHEME.finditer(text)]
    if separator is Separator.WORDS:
        return word_ranges(text)
    if separator is Separator.SENTENCES_RULE:
        return _trimmed(text, rule_sentence_ranges(text))
    if separator is Separator.SENTENCES_UNICODE:
        return _trimmed(text, unicode_sentence_ranges(text))
    found, last = [], 0
    for m in _NEWLINE[separator].finditer(text):
        found.append((last, m.start()))
        last = m.end()
    return _trimmed(text, [*found, (last, len(text))])


def byte_ranges(text: str, separator: Separator) -> list[Range]:
    """The same in UTF-8 bytes."""
    found = ranges(text, separator)
    if text.isascii():
        return found
    out, at, byte = [], 0, 0
    for a, b in found:
        byte += len(text[at:a].encode())
        end = byte + len(text[a:b].encode())
        out.append((byte, end))
        at, byte = b, end
    return out


def split_recursively(text: str, separator: Separator | None) -> tuple[Separator, list[Range]] | None:
    """The first of the separators from ``separator`` on that gives two pieces or more; None if none does."""
    while separator is not None:
        found = ranges(text, separator)
        if len(found) > 1:
            return separator, found
        separator = separator.next()
    return None


def clean_for(text: str, separator: Separator) -> str:
    return run_steps(text, tuple(clean_steps(separator.newlines)))
