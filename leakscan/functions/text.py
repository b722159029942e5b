"""Text normalisation, tokens and n-grams without leaving the JVM."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscan.functions.detect import text_or_empty

# Fixed value: a token is a run of two or more word characters. Nothing follows the run, so none of it is given back.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}+"


# First syllable of the Hangul block, and the jamo its syllables are made of.
HANGUL_FIRST = 0xAC00
HANGUL_LAST = 0xD7A3
LEADS = "".join(map(chr, range(0x1100, 0x1113)))
VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
TAILS = "".join(map(chr, range(0x11A8, 0x11C3)))


@dataclass(frozen=True)
class AccentTables:
    """What compatibility decomposition without combining marks does to single characters.

    ``source`` and ``target`` are arguments of ``translate``: characters with one base character map to it, combining
    marks stand past the end of the target and vanish. ``wide`` holds the characters that expand to several of which one
    at least can be part of a word, ``expanded`` their expansions, and ``wide_pattern`` finds one. ``rare_pattern`` finds a
    character that is neither Latin-1 nor Cyrillic, or is one of them: most text has none.
    """

    source: str
    target: str
    wide: str
    expanded: tuple[str, ...]
    wide_pattern: str
    rare_pattern: str


@lru_cache(maxsize=1)
def accent_tables() -> AccentTables:
    """Built from the Unicode database; Hangul syllables are left to arithmetic."""
    source, target, marks, wide, expanded = [], [], [], [], []
    for char in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.combining(char):
            marks.append(char)
            continue
        if not unicodedata.decomposition(char) or HANGUL_FIRST <= ord(char) <= HANGUL_LAST:
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
        elif not base:
            marks.append(char)
        elif any(c.isalnum() for c in base) and base != char:
            wide.append(char)
            expanded.append(base)
    codes = list(map(ord, wide))
    return AccentTables(
        "".join(source + marks), "".join(target), "".join(wide), tuple(expanded), _wide_pattern(codes), _rare_pattern(set(codes))
    )


# Fixed value: Cyrillic and its supplement.
CYRILLIC = (0x400, 0x52F)


def _rare_pattern(codes: set[int]) -> str:
    """Any character but those of Latin-1 and Cyrillic that are none of the codes.

    The JVM looks up Latin-1 characters that are listed singly in one table. With one range beside them it tries a text in a
    tight loop; with two it takes some ten times as long.
    """
    if codes & {*range(CYRILLIC[0], CYRILLIC[1] + 1)}:
        raise ValueError("a Cyrillic character expands to several")
    listed = "".join(f"\\x{{{c:X}}}" for c in range(0x100) if c not in codes)
    return f"[^{listed}\\x{{{CYRILLIC[0]:X}}}-\\x{{{CYRILLIC[1]:X}}}]"


def _wide_pattern(codes: list[int]) -> str:
    """Any of the codes or a Hangul syllable. A class of long code-free stretches in front rejects most text quickly."""
    known = sorted([(c, c) for c in codes] + [(HANGUL_FIRST, HANGUL_LAST)])
    ranges: list[list[int]] = []
    for low, high in known:
        if ranges and low == ranges[-1][1] + 1:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    ends = [-1] + [high for _, high in ranges]
    quiet = [(end + 1, low - 1) for end, (low, _) in zip(ends, ranges) if low - end > 100]
    text = lambda parts: "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in parts)
    return f"(?=[^{text(quiet)}])[{text(ranges)}]"


def _expand(char: Column, tables: AccentTables) -> Column:
    """The characters one character decomposes to."""
    at = F.ascii(char) - HANGUL_FIRST
    pick = lambda letters, i: F.substring(F.lit(letters), i + 1, 1)
    tail = F.pmod(at, F.lit(28))
    syllable = F.concat(
        pick(LEADS, F.floor(at / 588).cast("int")),
        pick(VOWELS, F.floor(F.pmod(at, F.lit(588)) / 28).cast("int")),
        F.when(tail > 0, pick(TAILS, tail - 1)).otherwise(""),
    )
    # One literal cut into an array: cheaper to plan than a thousand literals.
    parts = F.split(F.lit("|".join(tables.expanded)), "[|]")
    other = F.coalesce(F.get(parts, F.instr(F.lit(tables.wide), char) - 1), char)
    return (
        F.when(char < chr(0x80), char)
        .when(char.between(chr(HANGUL_FIRST), chr(HANGUL_LAST)), syllable)
        .otherwise(other)
    )


def normalise(col: Column) -> Column:
    """Lower case without accents (``Ё`` → ``е``, ``é`` → ``e``, ``ﬁ`` → ``fi``); null becomes empty.

    Text with as many bytes as characters is ASCII and has nothing to strip. Characters that expand to several are rare,
    so text is taken apart only where it holds one.
    """
    tables = accent_tables()
    lowered = F.lower(text_or_empty(col))
    stripped = F.translate(lowered, tables.source, tables.target)
    chars = F.transform(F.split(stripped, ""), lambda c: _expand(c, tables))
    return (
        F.when(F.octet_length(lowered) == F.length(lowered), lowered)
        .when(~F.rlike(lowered, F.lit(tables.rare_pattern)), stripped)
        .when(F.rlike(lowered, F.lit(tables.wide_pattern)), F.array_join(chars, ""))
        .otherwise(stripped)
    )


def tokens(normalised: Column) -> Column:
    """Words of at least two word characters."""
    return F.regexp_extract_all(normalised, F.lit(TOKEN_PATTERN), F.lit(0))


def join_words(words: Column) -> Column:
    """Tokens as one string. They hold no spaces, so ``split_words`` gives them back."""
    return F.array_join(words, " ")


def split_words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """Arrays of ``low``- to ``high``-word terms, shorter terms first. Pass an existing column: it is used often."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, F.lit(1), count)
        for shift in range(1, n):
            grams = F.zip_with(grams, F.slice(words, F.lit(shift + 1), count), lambda a, b: F.concat(a, F.lit(" "), b))
        parts.append(grams)
    return F.concat(*parts)
