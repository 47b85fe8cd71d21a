"""The row-key rule language, compiled on the driver.

A rule is a list of segments divided by `#`, each `name,index,reverse,length[,LEFT|RIGHT[,fill]]`. The name says what the segment
is: `long(...)` and `short(...)` encode a number (with `hash` inside, nested as often as wanted), the random and fill names give
digits or padding, and every other name is a label for the column at `index`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRule, SchemaMismatch
from ..functions import keycodes as K
from ..functions.text import may_be_key, text_of

#: Fixed values of the rule language.
RANDOM_EXACT, RANDOM_ANY_CASE = ("$RND$", "RND$", "$RND"), ("RANDOM", "RANDOM_COL")
FILL_ANY_CASE = ("FILL", "FILL_COL")

_NUMBER = re.compile(r"-?[0-9]+\Z")
_CALL = re.compile(r"(?P<outer>[^(]*)\((?P<inner>.*)\)\Z", re.S)


@dataclass(frozen=True)
class Segment:
    name: str
    kind: str  # column, random, fill, long, short
    index: int
    reverse: bool
    length: int
    right: bool = False
    fill: str = "0"
    hashes: int = 0

    @property
    def reads_column(self) -> bool:
        return self.kind in ("column", "long", "short")


def _hashes(inner: str, name: str) -> int:
    """How many hash() are nested in `inner`."""
    n = 0
    while inner:
        head, bracket, rest = inner.partition("(")
        if head.lower() != "hash":
            raise InvalidRule(f"unknown transform in {name!r}")
        n += 1
        if not bracket:
            return n
        if not rest.endswith(")"):
            raise InvalidRule(f"unbalanced brackets in {name!r}")
        inner = rest[:-1]
    return n


def _kind(name: str) -> tuple[str, int]:
    if "(" in name:
        call = _CALL.match(name)
        if not call:
            raise InvalidRule(f"unbalanced brackets in {name!r}")
        if call["outer"].lower() not in ("long", "short"):
            raise InvalidRule(f"unknown encoding in {name!r}")
        return call["outer"].lower(), _hashes(call["inner"], name)
    if name in RANDOM_EXACT or name.upper() in RANDOM_ANY_CASE:
        return "random", 0
    return ("fill" if name.upper() in FILL_ANY_CASE else "column"), 0


def _natural(text: str, what: str) -> int:
    if not _NUMBER.match(text) or not 0 <= int(text) < 2**31:
        raise InvalidRule(f"{what} must be an integer of 0 or more, not {text!r}")
    return int(text)


def _choice(text: str, values: dict[str, bool], what: str) -> bool:
    if text.upper() not in values:
        raise InvalidRule(f"{what} must be one of {', '.join(values)}, not {text!r}")
    return values[text.upper()]


def parse(rule: str) -> list[Segment]:
    segments = []
    for part in filter(None, rule.split("#")):
        fields = part.split(",")
        if len(fields) < 4:
            raise InvalidRule(f"a segment needs four fields: {part!r}")
        kind, hashes = _kind(fields[0])
        segments.append(Segment(
            fields[0], kind, _natural(fields[1], "the index"), _choice(fields[2], {"TRUE": True, "FALSE": False}, "the reverse flag"), _natural(fields[3], "the length"),
            _choice(fields[4], {"LEFT": False, "RIGHT": True}, "the padding side") if len(fields) > 4 else False,
            fields[5][0] if len(fields) > 5 and fields[5] else "0", hashes,
        ))
    if not segments:
        raise InvalidRule("the rule has no segment")
    return segments


def check(segments: list[Segment], columns: list[tuple[str, T.DataType]]) -> None:
    """Every index must name a visible column of a type that has a key text."""
    for s in (s for s in segments if s.reads_column):
        if s.index >= len(columns):
            raise SchemaMismatch(f"segment {s.name!r} needs column {s.index} of {len(columns)}")
        if not may_be_key(columns[s.index][1]):
            raise SchemaMismatch(f"column {columns[s.index][0]!r} has a type that no key can hold")


def referenced(segments: list[Segment]) -> list[int]:
    return sorted({s.index for s in segments if s.reads_column})


def skips_null(segments: list[Segment], columns: list[tuple[str, T.DataType]]) -> bool:
    """Whether a null in the first segment makes the key empty: a number, left-padded with zeros and not reversed."""
    s = segments[0]
    return s.kind == "column" and not s.reverse and not s.right and s.fill == "0" and s.length > 0 and not isinstance(columns[s.index][1], T.StringType)


def expression(segments: list[Segment], columns: list[tuple[str, T.DataType]], seed: int | None = None, null_keys: str = "skip") -> Column:
    """The row key. `null_keys`: `skip` (a null in a leading zero-padded number gives an empty key) or `pad`."""
    check(segments, columns)
    parts = []
    for k, s in enumerate(segments):
        if s.kind == "random":
            parts.append(K.random_digits(s.length, None if seed is None else seed + 1000 * k))
            continue
        if s.kind == "fill":
            text = F.lit("")
        else:
            name, kind = columns[s.index]
            text = F.coalesce(text_of(F.col(f"`{name}`"), kind), F.lit(""))
        if s.kind in ("long", "short"):
            number = K.parsed(text, f"{s.kind}()")
            for _ in range(s.hashes):
                number = K.hashed(number)
            text = K.long_code(number) if s.kind == "long" else K.short_code(number, text)
        text = K.pad(text, s.length, s.fill, s.right)
        parts.append(K.reverse(text) if s.reverse else text)
    key = F.concat(*parts)
    if null_keys == "skip" and skips_null(segments, columns):
        key = F.when(F.col(f"`{columns[segments[0].index][0]}`").isNull(), F.lit("")).otherwise(key)
    return key
