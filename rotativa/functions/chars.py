"""Character classes and the few string primitives everything else is built on.

All classes are written for Java regular expressions; the space, word and emoji classes read the same in RE2.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inside of a [...] class. A bare \w is ASCII in Java, and (?U)\w misses superscripts and adds combining marks.
WORD = r"\p{L}\p{N}_"

# Inside of a [...] class: every Unicode space, U+001C-001F included, U+200B not.
SPACE = (
    r"\x09-\x0d\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same as whole classes. A wide range goes first, so that a letter is turned down by one or two tests instead of
# by all eleven; on long texts that makes the difference of a factor of five.
SPACE_CHAR = rf"[\x09-\x20\x85-\x{{3000}}&&[{SPACE}]]"
NON_SPACE_CHAR = rf"[^\x09-\x20\x85-\x{{3000}}&&[{SPACE}]]"
SPACE_BUT_BLANK_CHAR = rf"[\x09-\x1f\x85-\x{{3000}}&&[{SPACE}]]"

# The same characters as one string, for trim().
SPACE_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Single code points with the Unicode Emoji property, without ASCII and the regional indicators.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A
1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD
1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8
1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5
1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89 1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""

EMOJI = "".join(
    "-".join(rf"\x{{{end}}}" for end in item.split("-")) for item in EMOJI_RANGES.split()
)


@cache
def digit_class() -> str:
    """Inside of a [...] class: decimal digits plus the other characters with a digit value (superscripts, circled)."""
    others = [
        cp for cp in range(0x80, 0x110000)
        if unicodedata.digit(chr(cp), None) is not None and unicodedata.category(chr(cp)) != "Nd"
    ]
    parts, start = [], None
    for here, after in zip(others, [*others[1:], -1]):
        start = here if start is None else start
        if after != here + 1:
            parts.append(rf"\x{{{start:x}}}-\x{{{here:x}}}")
            start = None
    return r"\p{Nd}" + "".join(parts)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Drop Unicode spaces at both ends; only the ends are looked at, unlike with a regular expression."""
    return F.trim(c, F.lit(SPACE_CHARS))


def count_char(c: Column, *chars: str) -> Column:
    """Occurrences of the given single characters, by length difference."""
    rest = c
    for ch in chars:
        rest = F.replace(rest, F.lit(ch), F.lit(""))
    return F.length(c) - F.length(rest)


def count_inside(c: Column, inner_class: str) -> Column:
    """Characters of a class, as the length of what is left. Cheaper than counting matches: no array is built."""
    return F.length(F.regexp_replace(c, f"[^{inner_class}]+", ""))


def word_skeleton(c: Column) -> Column:
    """Each word becomes one ``w``.

    The text shrinks to a third, while punctuation, runs of dots and sentence ends in it stay what they were. Only
    ``_`` and numbers, which are parts of words, have to be counted in the text itself.
    """
    return F.regexp_replace(c, f"[{WORD}]+", "w")


def drop_spaces(c: Column) -> Column:
    """Blanks go by a plain search, so that the regular expression has little left to do."""
    return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), f"{SPACE_CHAR}+", "")


def marked_only(c: Column) -> Column:
    """Upper case and numbers, the few characters of a text that are looked at once more."""
    return F.regexp_replace(c, r"[^\p{IsUppercase}\p{N}]+", "")


def numbers_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\P{N}+", "")


def count_digits(numbers: Column) -> Column:
    """Characters with a digit value among the number characters."""
    return count_inside(numbers, digit_class())


def count_upper(c: Column) -> Column:
    return count_inside(c, r"\p{IsUppercase}")


def count_letters(text: Column, skeleton: Column, numbers: Column) -> Column:
    """What words are made of, less numbers and ``_``."""
    in_words = F.length(text) - F.length(skeleton) + count_char(skeleton, "w")
    return in_words - F.length(numbers) - count_char(text, "_")


def count_punctuation(text: Column, dense_skeleton: Column) -> Column:
    """Neither letter nor number nor space; takes the skeleton without spaces."""
    return F.length(F.replace(dense_skeleton, F.lit("w"), F.lit(""))) + count_char(text, "_")


def count_quotes(skeleton: Column) -> Column:
    return count_char(skeleton, '"', "“", "”", "'")


def count_emoji(text: Column, dense_skeleton: Column) -> Column:
    """Single-code-point emoji. U+2139 is a letter and so missing from the skeleton: counted in the text."""
    beyond_latin = F.regexp_replace(dense_skeleton, r"[\x00-\xa8]+", "")
    return count_inside(beyond_latin, EMOJI) + count_char(text, "ℹ")
