"""Personal data by anchor expansion: Aho-Corasick finds anchors, small parsers expand and check around each.

One automaton walks each whole text once and reports at-signs, plus signs before a digit, dots between digits, digit
pairs, schemes, and cues of accounts and street addresses. A parser per kind of anchor expands it to the left and right
and validates what it finds: label structure of mail domains, octets, Luhn and mod-97 check digits, numbers of digits.
Parsers go on where their last find ended, so each kind's finds are leftmost and do not overlap, and time stays in
proportion to the text.

Work is local to a row. Positions are code points, the end exclusive. Null text counts as empty: no spans. Other
columns are left alone; a column of the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, with_workers

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url_user", "iban", "account", "street")
RESULT = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
]))

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER_HOST = re.compile(r"://([^\s/@:]+:[^\s/@]+)@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|nummer|num|número|numéro|n°))?[ .:#]{0,3}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
LETTERS = re.compile(r"[^\W\d_]*")
HOUSE_AFTER = re.compile(r" ?([0-9]{1,4}[a-z]?)(?![0-9\w])")
HOUSE_BEFORE = re.compile(r"(?<![0-9])[0-9]{1,5}[a-z]?,? (?:[^\W\d_]+ ){0,3}$")
NAME_HOUSE = re.compile(r"(?:[^\W\d_]+[ ,]+){1,4}[0-9]{1,4}(?![0-9])")
STREET_NAME = re.compile(r"[^\W\d_]+(?:[ '-][^\W\d_]+){0,4}")
HOUSE_RUE = re.compile(r"(?<![0-9])[0-9]{1,4}(?: bis| ter)?,? $")

# Cues, each with the way to read what stands around it.
CUES = {
    "iban": ("IBAN", "Iban", "iban"),
    "account": (
        "account", "Account", "ACCOUNT", "acct", "Acct", "Konto", "konto", "compte", "Compte", "cuenta", "Cuenta",
        "SSN", "ssn", "passport", "Passport",
    ),
    "house_before": (" Street", " Avenue", " Road", " Lane", " Boulevard", " St.", " Ave.", " Rd."),
    "house_after": ("straße", "strasse", "Straße", "Strasse", "platz", "gasse"),
    "rue": ("rue ", "avenue ", "boulevard ", "Rue "),
    "calle": ("calle ", "Calle ", "avenida ", "Avenida ", "plaza ", "Plaza "),
}


def anchors() -> Iterator[tuple[str, str]]:
    yield "@", "email"
    yield "://", "url_user"
    for a in DIGITS:
        yield f"+{a}", "phone"
        for b in DIGITS:
            yield f"{a}.{b}", "ip"
            for between in ("", " ", "-"):
                yield f"{a}{between}{b}", "card"
    for kind, words in CUES.items():
        for word in words:
            yield word, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """The automaton and the parsers; one per worker."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for word, kind in anchors():
            self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.parsers = {kind: getattr(self, f"_{kind}") for kind in {k for _, k in anchors()}}

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All finds, by kind as listed and then start."""
        found: dict[str, list[tuple[int, int]]] = {}
        self.run = (0, 0)  # of letters around the last street ending
        done = dict.fromkeys(self.parsers, 0)  # where the next find of a kind may begin
        for last, (kind, width) in self.automaton.iter(text):
            start = last + 1 - width
            if kind == "card" and start < done["card"]:
                continue
            hit, done[kind] = self.parsers[kind](text, start, last + 1, done[kind])
            if hit:
                found.setdefault(hit[0], []).append(hit[1:])
        return [(kind, *s) for kind in KINDS for s in sorted(set(found.get(kind, ())))]

    # Each parser gets the anchor's place and where its kind may begin; it returns the find and the new such place.

    @staticmethod
    def _email(text, at, after, free):
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, after) if start < at else None
        return (("email", start, domain.end()), domain.end()) if domain else (None, free)

    @staticmethod
    def _ip(text, at, after, free):
        start = at
        if start < free:
            return None, free
        while start > free and text[start - 1] in DIGITS:
            start -= 1
        m = DOTTED.match(text, start)
        if not m:
            return None, free
        valid = all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))
        return ("ip", start, m.end()) if valid else None, m.end()

    @staticmethod
    def _card(text, at, after, free):
        m = DIGIT_CHAIN.match(text, at)
        digits = m[0].replace(" ", "").replace("-", "")
        return ("card", at, m.end()) if 16 <= len(digits) <= 19 and luhn(digits) else None, m.end()

    @staticmethod
    def _phone(text, at, after, free):
        m = PHONE.match(text, at)
        if not m:
            return None, free
        return ("phone", at, m.end()) if 8 <= sum(c in DIGITS for c in m[0]) <= 15 else None, m.end()

    @staticmethod
    def _url_user(text, at, after, free):
        m = USER_HOST.match(text, at) if at >= free else None
        return (("url_user", m.start(1), m.end(1)), m.end()) if m else (None, free)

    @staticmethod
    def _iban(text, at, after, free):
        m = IBAN.match(text, after) if after >= free else None
        if m and mod_97(m[1].replace(" ", "")):
            return ("iban", m.start(1), m.end(1)), m.end()
        return None, free

    @staticmethod
    def _account(text, at, after, free):
        m = ACCOUNT.match(text, after) if after >= free else None
        return (("account", m.start(1), m.end(1)), m.end()) if m else (None, free)

    @staticmethod
    def _house_before(text, at, after, free):
        left = at
        for _ in range(4):  # three words and a number, however long
            left = text.rfind(" ", free, left)
            if left < 0:
                left = free
                break
        m = HOUSE_BEFORE.search(text, left, at + 1)
        return (("street", m.start(), after), after) if m else (None, free)

    def _house_after(self, text, at, after, free):
        if not self.run[0] <= at < self.run[1]:  # a run with many endings is walked once
            start = at
            while start > self.run[1] and text[start - 1].isalpha():
                start -= 1
            self.run = start, LETTERS.match(text, after).end()
        m = HOUSE_AFTER.match(text, self.run[1])
        return (("street", max(free, self.run[0]), m.end(1)), m.end(1)) if m else (None, free)

    @staticmethod
    def _rue(text, at, after, free):
        left = max(free, at - 12)
        m = HOUSE_RUE.search(text[left:at])
        name = STREET_NAME.match(text, after) if m else None
        return (("street", left + m.start(), name.end()), name.end()) if name else (None, free)

    @staticmethod
    def _calle(text, at, after, free):
        m = NAME_HOUSE.match(text, after) if at >= free else None
        return (("street", at, m.end()), m.end()) if m else (None, free)


def finder() -> Finder:
    return kept_by_worker("personal", Finder, Finder)


def find(df: DataFrame, text: str = "text", result: str = "personal") -> DataFrame:
    """Adds ``result``: array of (kind, start, end), by kind as in ``KINDS`` and then start."""
    with_workers(df.sparkSession)

    @F.arrow_udf(RESULT)
    def spans(texts: pa.Array) -> pa.Array:
        own = finder()
        rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in own.spans(t.as_py() or "")] for t in texts]
        shape = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return pa.array(rows, pa.list_(shape))

    return df.withColumn(result, spans.asNondeterministic()(F.col(text)))


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
