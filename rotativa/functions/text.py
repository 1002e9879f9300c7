"""Text preparation for a sub-word tokenizer: casing, accents and punctuation stay as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import NON_SPACE_CHAR, SPACE_BUT_BLANK_CHAR, SPACE_CHAR, WORD, strip, text_or_empty

# What is masked and by which marker. The long s counts as an s where case is ignored.
CONTROLS = r"[\x00-\x1f\x7f-\x{feff}&&[\x00-\x1f\x7f-\x9f\x{200b}\x{200c}\x{200d}\x{feff}]]"
URL = rf"(?i)(?:http[sſ]?://{NON_SPACE_CHAR}+|www\.{NON_SPACE_CHAR}+)"
EMAIL = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?=[.\-]))[{WORD}.\-]++@[{WORD}.\-]+\.[{WORD}]+"
URL_MARK = "<URL>"
EMAIL_MARK = "<EMAIL>"


def join_headline_body(headline: Column, body: Column) -> Column:
    return strip(F.concat(text_or_empty(headline), F.lit("\n\n"), text_or_empty(body)))


def strip_controls(c: Column) -> Column:
    """Control and zero-width characters become one blank each."""
    return F.regexp_replace(c, CONTROLS, " ")


def mask_urls(c: Column) -> Column:
    """Case is ignored, and a link ends at the next space only. Texts without a link skip the regular expression."""
    possible = F.contains(c, F.lit("://")) | F.contains(F.lower(c), F.lit("www."))
    return F.when(possible, F.regexp_replace(c, URL, URL_MARK)).otherwise(c)


def mask_emails(c: Column) -> Column:
    """An address starts at a word character; texts without ``@`` skip the regular expression."""
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, EMAIL_MARK)).otherwise(c)


def squeeze_spaces(c: Column) -> Column:
    """Runs of spaces become one blank. Single blanks are left alone rather than replaced by themselves."""
    return F.trim(F.regexp_replace(c, f" {SPACE_CHAR}+|{SPACE_BUT_BLANK_CHAR}{SPACE_CHAR}*", " "))


def clean_text(c: Column, urls: bool = True, emails: bool = True) -> Column:
    out = strip_controls(text_or_empty(c))
    if urls:
        out = mask_urls(out)
    if emails:
        out = mask_emails(out)
    return squeeze_spaces(out)


def normalize_text(c: Column) -> Column:
    return strip(text_or_empty(c))
