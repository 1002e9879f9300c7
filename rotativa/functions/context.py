"""Where an article comes from: link, author, date, and hashed embeddings of short strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import SPACE_CHAR, strip, text_or_empty

# Schemes whose last path segment may carry ;parameters (RFC 1808).
SCHEMES_WITH_PARAMS = (
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips", "mms", "sftp",
    "tel",
)

# Names an author path segment or query key goes by.
AUTHOR_WORDS = "author|autor"

SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
IPV6_HOST = r"^[^\[\]]*\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\[\]]*)?\][^\[\]]*$"

# The date forms after ISO, in the order they are tried; an ambiguous one is day first.
DATE_FORMS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
)
ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(Z|[+\-]\d{2}(?::?\d{2})?)?)?$"
)
WEEK = r"^(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)(?=[T ]|$)"
LAST_SECOND = 253402300799  # of the year 9999

SECONDS_PER_DAY = 86400.0
AGE_CAP_DAYS = 3650.0
MISSING_AGE = -1.0


def str_field(c: Column) -> Column:
    return strip(text_or_empty(c))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def url_parts(link: Column) -> Column:
    """Scheme, host part, path and query of a link as a struct.

    Line breaks and tabs inside are ignored, as is anything up to a blank at the start. The host part is all that
    stands between ``//`` and the path: user, host and port as written. ``broken`` marks one with wrong brackets.
    """
    clean = F.regexp_replace(F.regexp_replace(text_or_empty(link), r"[\t\r\n]+", ""), r"^[\x00-\x20]+", "")

    def split(url: Column) -> Column:
        rest = F.regexp_replace(url, SCHEME, "")
        netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
        return F.struct(
            F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
            netloc.alias("netloc"),
            F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
            F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            (netloc.rlike(r"[\[\]]") & ~netloc.rlike(IPV6_HOST)).alias("broken"),
        )

    return bind(clean, split)


def path_without_params(parts: Column) -> Column:
    path = parts["path"]
    return F.when(parts["scheme"].isin(*SCHEMES_WITH_PARAMS), F.regexp_replace(path, ";[^/]*$", "")).otherwise(path)


def domain_of(parts: Column) -> Column:
    first = F.split_part(path_without_params(parts), F.lit("/"), F.lit(1))
    named = (
        F.when(parts["broken"], F.lit(""))
        .when(parts["netloc"] != "", parts["netloc"])
        .when(F.contains(first, F.lit(".")), first)
        .otherwise("")
    )
    return F.regexp_replace(strip(F.lower(named)), r"^www\.", "")


def url_domain(link: Column) -> Column:
    """Lower-cased host part without one leading ``www.``; a link without scheme gives its first path segment."""
    return bind(url_parts(link), domain_of)


def clean_author(c: Column) -> Column:
    """Hyphens and underscores part the names; fewer than two characters are no name."""
    name = strip(F.regexp_replace(F.translate(c, "-_", "  "), f"{SPACE_CHAR}+", " "))
    return bind(name, lambda n: F.when(F.length(n) < 2, F.lit("")).otherwise(n))


def author_of(parts: Column) -> Column:
    path = F.trim(path_without_params(parts), F.lit("/"))
    in_path = F.regexp_extract(path, f"(?i)(?:^|/)(?:{AUTHOR_WORDS})/([^/]+)", 1)
    in_query = F.regexp_extract(parts["query"], f"(?i)(?:^|&)(?:{AUTHOR_WORDS})=([^&]+)", 1)
    return clean_author(F.when(parts["broken"], F.lit("")).when(in_path != "", in_path).otherwise(in_query))


def url_author(link: Column) -> Column:
    """From an author path segment, else from an author query key. A path hit decides, even if it cleans to nothing."""
    return bind(url_parts(link), author_of)


def author(parts: Column, column: Column | None = None) -> Column:
    """A given author wins over what the parts of a link say."""
    if column is None:
        return author_of(parts)
    given = str_field(column)
    return F.when(given != "", given).otherwise(author_of(parts))


def _epoch(s: Column) -> Column:
    seconds = F.when(F.length(s) == 13, F.substring(s, 1, 10)).otherwise(s).cast("long")
    return F.when(seconds <= LAST_SECOND, F.timestamp_seconds(seconds))


def extended(s: Column) -> Column:
    """Compact ISO date-times and week dates in the extended form, anything else as it is."""
    dated = F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})(?=[T ])", "$1-$2-$3")
    timed = F.regexp_replace(dated, r"^(.{10}[T ]\d{2})(\d{2})(\d{2})(?=[.,Z+\-]|$)", "$1:$2:$3")
    timed = F.regexp_replace(timed, r"^(.{10}[T ]\d{2})(\d{2})(?=[.,Z+\-]|$)", "$1:$2")

    def number(*groups: int) -> Column:
        return F.concat(*[F.regexp_extract(s, WEEK, i) for i in groups]).try_cast("int")

    week = number(2, 4)
    monday = F.date_trunc("week", F.concat(F.regexp_extract(s, WEEK, 1), F.lit("-01-04")).try_cast("date")).cast("date")
    day = F.date_add(monday, (week - 1) * 7 + F.coalesce(number(3, 5), F.lit(1)) - 1)
    of_week = F.when((week > 0) & (F.weekofyear(day) == week), F.concat(
        F.date_format(day, "yyyy-MM-dd"), F.regexp_replace(s, WEEK, "")
    ))
    return F.when(s.rlike(WEEK), of_week).otherwise(timed)


def _iso(s: Column) -> Column:
    def part(i: int, default: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(s, ISO, i), F.lit("")), F.lit(default))

    offset = F.regexp_replace(part(6, "Z"), r"^([+\-]\d{2})$", "$1:00")
    zone = F.regexp_replace(offset, r"^([+\-]\d{2})(\d{2})$", "$1:$2")
    return F.concat(
        part(1, ""), F.lit("T"), part(2, "00"), F.lit(":"), part(3, "00"), F.lit(":"), part(4, "00"),
        F.lit("."), part(5, "0"), zone,
    ).try_cast("timestamp")


def parse_date(c: Column) -> Column:
    """Epoch digits, ISO 8601, then the fixed date forms; a time without zone is UTC; null if nothing fits."""

    def parse(s: Column) -> Column:
        # The zone is spelled out, so that the session's own time zone does not matter.
        in_utc = F.concat(s, F.lit("Z"))
        forms = [F.when(s.rlike(shape), F.try_to_timestamp(in_utc, F.lit(f"{form}X"))) for shape, form in DATE_FORMS]
        return F.when(s.rlike(r"^\d{10,13}$"), _epoch(s)).otherwise(
            F.coalesce(bind(extended(s), lambda e: F.when(e.rlike(ISO), _iso(e))), *forms)
        )

    return bind(str_field(c), parse)


def age_days(
    date: Column, as_of: Column, cap: float | None = AGE_CAP_DAYS, missing: float = MISSING_AGE
) -> Column:
    """Days from the date to ``as_of``, negative for a date after it."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(parse_date(date))
    days = micros / F.lit(1e6) / F.lit(SECONDS_PER_DAY)

    def clipped(d: Column) -> Column:
        # least() and greatest() skip nulls, which would turn a date that cannot be read into a very old one.
        return F.when(d.isNotNull(), F.greatest(F.least(d, F.lit(float(cap))), F.lit(-float(cap))))

    known = days if cap is None else bind(days, clipped)
    return F.coalesce(known, F.lit(float(missing)))


def hash_key(value: Column, field: str, j: int) -> Column:
    return F.concat(F.lit(f"{field}|{j}|"), strip(F.lower(str_field(value))))


def hash_index(key: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hash_sign(key: Column, signed: bool = True) -> Column:
    if not signed:
        return F.lit(1.0)
    odd = F.substring(F.md5(key), 9, 1).isin(*"13579bdf")
    return F.when(odd, F.lit(-1.0)).otherwise(F.lit(1.0))
