"""Secret scan: entropy of sliding windows over candidate strings, beside three fixed kinds, as column expressions.

Candidates are runs of one character class (hexadecimal, base64) of at least one window. A window of fixed width slides
over each; its character counts change by one in and one out per step, and the Shannon entropy follows from the sum of
``c log2 c`` over the counts, kept in whole millionths so that no rounding gathers. Windows at or above the bits of
their class become spans, touching windows one span. An allow list of shapes (identifiers, words, digits, examples) and
of words before the candidate (digests, commits) suppresses candidates; the fixed kinds are never suppressed.

Everything stays in the row: no Python, no shuffle. Time grows in proportion to the text, whatever the candidates, as
nothing is appended to a long array or looked for in one: positions, reaches and windows come from block-wise scans; only
the spans found are sorted. Positions are code points, the end exclusive. Null text counts as empty: no spans. Other columns are left alone; a column of the result's name is
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, whole_text
from .common import scan as running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
ACCESS = "AKIA[A-Z0-9]{12,}"  # a whole run of 16 or more
HEX = "[0-9a-f]{32,}"  # a whole run of 32 or more
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

SLOT_0, SLOTS = ord("+"), ord("z") - ord("+") + 1  # a count for every character a candidate can have
SPAN = "array<struct<start:int,end:int,kind:string>>"
COUNT_BITS, PACKED = 5, 12  # counts up to the window, twelve to a long
BLOCK = 4096  # characters of a candidate walked at once
PIECE, LEAST_SPAN = 1024, 8


@dataclass(frozen=True)
class CharacterClass:
    kind: str
    characters: str  # inside a regular-expression class
    bits: float  # entropy of a window from which it counts


@dataclass(frozen=True)
class EntropyConfig:
    window: int = 20
    classes: Sequence[CharacterClass] = (
        CharacterClass("entropy_hex", "0-9A-Fa-f", 3.0),
        CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", 3.75),
    )
    #: Whole candidates that are no secrets: no digit at all, no letter at all, UUIDs, alphabets, marked examples.
    allowed: str = (
        r"^[^0-9]*$|^[^A-Za-z]*$|^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
        r"|(?i:0123456789abcdef|abcdefghijklmnop|example)"
    )
    #: What stands right before a candidate that is no secret.
    allowed_before: str = r"(?i:sha(?:1|256|384|512)[-:=]\x20?|md5[:=]\x20?|commit\x20|checksum[:=]?\x20)$"


def located(text: Column, pattern: str) -> Column:
    """All matches as (start, end, hit, before): the pieces between matches add up to the positions."""
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )
    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>")

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda p: F.length(p["piece"]) + F.coalesce(F.length(p["hit"]), F.lit(0)))
        spans = F.zip_with(found, scan_sums(lengths), lambda p, end: F.struct(
            (end - F.length(p["hit"])).alias("start"), end.alias("end"), p["hit"].alias("hit"), F.right(p["piece"], F.lit(16)).alias("before")
        ))
        return F.filter(spans, lambda s: s["hit"].isNotNull())  # the last piece has no match behind it

    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(none)


def scan_sums(lengths: Column) -> Column:
    return running(lengths, lambda a, b: a + b)


def spans_of(found: Column, kind: str) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def assignments(text: Column) -> Column:
    whole = F.filter(located(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    return spans_of(whole, "assign")


def entropy_windows(hit: Column, window: int, bits: float) -> Column:
    """Spans inside one candidate: the union of its windows of at least ``bits``.

    Counts are packed, twelve characters to a number, so that a step changes two numbers of seven. The candidate is
    walked block by block; a block's spans are set aside, and only the last one stays open for the next.
    """
    millionths = [0] + [round(c * math.log2(c) * 1e6) for c in range(1, window + 1)]
    weight = F.array(*[F.lit(x) for x in millionths])
    most = math.floor((math.log2(window) - bits) * window * 1e6)
    none = F.array().cast("array<struct<start:int,end:int>>")

    def count_of(counts: Column, code: Column) -> Column:
        packed = F.get(counts, F.floor(code / PACKED).cast("int"))
        return F.call_function("shiftrightunsigned", packed, code % PACKED * COUNT_BITS).bitwiseAND((1 << COUNT_BITS) - 1).cast("int")

    def step(state: Column, x: Column) -> Column:
        counts, same = state["counts"], x["into"] == x["out"]
        less, more = count_of(counts, x["out"]), count_of(counts, x["into"])
        left = F.when(same | (x["out"] < 0), 0).otherwise(F.get(weight, less - 1) - F.get(weight, less))
        came = F.when(same, 0).otherwise(F.get(weight, more + 1) - F.get(weight, more))
        one = F.lit(1).cast("long")

        def changed(n: Column, at: Column) -> Column:
            def share(code: Column) -> Column:
                return F.when(F.floor(code / PACKED) == at, F.call_function("shiftleft", one, code % PACKED * COUNT_BITS)).otherwise(0)

            return n + share(x["into"]) - F.when(x["out"] < 0, 0).otherwise(share(x["out"]))

        moved = F.when(same, counts).otherwise(F.transform(counts, changed))
        total = state["total"] + left + came
        start, end = x["i"] - (window - 1), x["i"] + 1
        counted = (start >= 0) & (total <= most)
        closes = counted & (state["end"] >= 0) & (state["end"] < start)
        open_ = F.struct(state["start"].alias("start"), state["end"].alias("end"))
        return F.struct(
            moved.alias("counts"), total.cast("int").alias("total"),
            F.when(counted & (closes | (state["end"] < 0)), start).otherwise(state["start"]).alias("start"),
            F.when(counted, end).otherwise(state["end"]).alias("end"),
            F.when(closes, F.concat(state["spans"], F.array(open_))).otherwise(state["spans"]).alias("spans"),
        )

    def carried(state: Column, spans: Column, name: str) -> Column:
        return F.struct(*[state[c].alias(c) for c in ("counts", "total", "start", "end")], spans.alias(name))

    def walk(state: Column, block: Column) -> Column:
        walked = F.aggregate(block, carried(state, none, "spans"), step)
        return let(walked, lambda now: carried(now, F.concat(state["found"], F.array(now["spans"])), "found"))

    def finished(state: Column) -> Column:
        last = F.struct(state["start"].alias("start"), state["end"].alias("end"))
        return F.concat(F.flatten(state["found"]), F.when(state["end"] < 0, none).otherwise(F.array(last)))

    def windows(codes: Column) -> Column:
        steps = F.transform(codes, lambda c, i: F.struct(
            c.alias("into"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("out"), i.alias("i"),
        ))
        first = F.struct(
            F.array_repeat(F.lit(0).cast("long"), -(-SLOTS // PACKED)).alias("counts"), F.lit(0).alias("total"), F.lit(-1).alias("start"),
            F.lit(-1).alias("end"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("found"),
        )
        return let(steps, lambda all_: F.aggregate(blocks_of(all_, BLOCK), first, walk, finished))

    return let(F.transform(F.split(hit, ""), lambda c: F.ascii(c) - SLOT_0), windows)


def blocks_of(values: Column, size: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / size).cast("int")), lambda b: F.slice(values, b * size + 1, F.lit(size))
    )


def entropy_spans(text: Column, cls: CharacterClass, config: EntropyConfig) -> Column:
    candidates = F.filter(located(text, f"[{cls.characters}]{{{config.window},}}"), lambda s: ~(
        s["hit"].rlike(config.allowed) | s["before"].rlike(config.allowed_before)
    ))
    return F.flatten(F.transform(candidates, lambda c: F.transform(
        entropy_windows(c["hit"], config.window, cls.bits),
        lambda w: F.struct(
            (c["start"] + w["start"]).alias("start"), (c["start"] + w["end"]).alias("end"), F.lit(cls.kind).alias("kind")
        ),
    )))


def in_order(spans: Column, kinds: Sequence[str] = KINDS) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def scan(df: DataFrame, text: str = "text", result: str = "secrets", config: EntropyConfig = EntropyConfig()) -> DataFrame:
    """Adds ``result``: struct of ``base`` and ``spans``, arrays of (start, end, kind) by start and kind.

    ``spans`` holds the base spans and the entropy spans that no base span covers.
    """
    whole = whole_text(text)
    base = F.concat(
        assignments(whole), spans_of(located(whole, ACCESS), "access"), spans_of(located(whole, HEX), "hex")
    )
    windows = F.concat(*[entropy_spans(whole, cls, config) for cls in config.classes])
    found = df.withColumn(result, F.struct(base.alias("base"), windows.alias("windows")))
    more = uncovered(F.col(result)["windows"], F.col(result)["base"])
    return found.withColumn(result, F.struct(
        in_order(F.col(result)["base"]).alias("base"), in_order(F.concat(F.col(result)["base"], more)).alias("spans")
    ))


def uncovered(windows: Column, base: Column) -> Column:
    """The windows that lie in no base span: none that starts before or with them ends as late as they do.

    Both are sorted together by start, base spans first, and the furthest end so far is carried along.
    """
    def marked(spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")
        ))

    def apart(sorted_: Column) -> Column:
        reach = running(F.transform(sorted_, lambda s: F.when(s["rank"] == 0, s["end"]).otherwise(-1)), lambda a, b: F.greatest(a, b))
        paired = F.zip_with(sorted_, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
        left = F.filter(paired, lambda p: (p["s"]["rank"] == 1) & (p["reach"] < p["s"]["end"]))
        return F.transform(left, lambda p: F.struct(p["s"]["start"].alias("start"), p["s"]["end"].alias("end"), p["s"]["kind"].alias("kind")))

    return F.when((F.size(windows) == 0) | (F.size(base) == 0), windows).otherwise(
        let(F.sort_array(F.concat(marked(base, 0), marked(windows, 1))), apart)
    )


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, in order of start, replaced by one mark; overlapping spans share one.

    Spans have at least ``LEAST_SPAN`` characters. The text is cut into pieces first, since finding a character of a long
    string means to count from its start; each piece looks at the few spans that can lie in it.
    """
    def disjoint(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def grouped(reach: Column) -> Column:
            before = F.transform(sorted_, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(reach, i - 1), F.lit(-1)).alias("reach")))
            return let(F.filter(before, lambda s: s["start"] >= s["reach"]), lambda opens: F.transform(opens, lambda s, i: F.struct(
                s["start"].alias("start"), F.coalesce(F.get(opens, i + 1)["reach"], F.element_at(reach, -1)).alias("end")
            )))

        return let(ends, grouped)

    def pieced(whole: Column) -> Column:
        none = F.array().cast("array<string>")

        def piece(state: Column, chunk: Column) -> Column:
            limit = state["at"] + F.length(chunk)

            def cut(inner: Column, s: Column) -> Column:
                begin = F.greatest(s["start"] - state["at"], F.lit(0))
                gap = F.substring(chunk, inner["at"] + 1, begin - inner["at"])
                parts = F.when(s["start"] < state["at"], F.array(gap)).otherwise(F.array(gap, F.lit(mark)))
                return F.when(s["start"] >= limit, inner).otherwise(F.struct(
                    (F.least(s["end"], limit) - state["at"]).alias("at"), (inner["next"] + (s["end"] <= limit).cast("int")).alias("next"),
                    F.concat(inner["parts"], parts).alias("parts"),
                ))

            near = F.slice(whole, state["next"] + 1, F.lit(PIECE // LEAST_SPAN + 2))
            first = F.struct(F.lit(0).alias("at"), state["next"].alias("next"), none.alias("parts"))
            return let(F.aggregate(near, first, cut), lambda done: F.struct(
                limit.alias("at"), done["next"].alias("next"), F.concat(state["out"], F.array(F.concat(
                    F.array_join(done["parts"], ""), F.substring(chunk, done["at"] + 1, F.length(chunk))
                ))).alias("out"),
            ))

        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("next"), none.alias("out"))
        return F.aggregate(chunks, first, piece, lambda state: F.array_join(state["out"], ""))

    return F.when(F.size(spans) > 0, let(let(spans, disjoint), pieced)).otherwise(text)
