"""What a single line says: its marker, and where a number stands in legal numbering.

Plain functions over strings, for the pass over a document's lines; ``functions.markers`` and
``functions.sequence`` state the same as column expressions for use in queries.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

from ..functions import patterns as P

QUOTES = "“\"‘'"
_LINE = {kind: re.compile(p, re.I) for kind, p in P.LINE.items()}
_BARE = ("clause", "point")


def _tried() -> dict[str, tuple[str, ...]]:
    """Kinds by the first character of a line, in the order in which they are tried.

    A keyword's first letter leads to its kinds, any letter of a list to points, a digit to clauses.
    """
    heads: dict[str, list[str]] = {}
    for kind, word in P.KEYWORDS.items():
        for letter in {part[0].lower() for part in word[3:-1].split("|")}:
            heads.setdefault(letter, []).append(kind)
    for letter in "abcdefghijklmnopqrstuvwxyzđ":
        kinds = heads.setdefault(letter, [])
        kinds += [] if "point" in kinds else ["point"]
    heads |= {letter.upper(): kinds for letter, kinds in heads.items()}
    return {**{k: tuple(v) for k, v in heads.items()}, **dict.fromkeys("0123456789", ("clause",))}


_TRIED = _tried()
#: a bare enumerator is over within its first few characters
_ENUMERATED = re.compile(r"[^\W_]\w*\s*[.)]")


class Marker(NamedTuple):
    kind: str
    number: str  # in canonical form
    raw_number: str
    marker: str
    rest: str
    quoted: bool  # opens with a quotation mark


def canonical(kind: str, number: str) -> str:
    if kind in ("article", "clause", "point"):
        return number.lower()
    if len(number) == 1 or not number.lower().strip("ivxlcdm"):
        return number.upper() if number.isalpha() else number
    return number.lower() if re.match(r"(?:thứ|thu)\s", number, re.I) else number


def read_marker(line: str) -> Marker | None:
    """The line's marker, or None for a line of text."""
    probe = line.strip()
    if quoted := probe[:1] in QUOTES and probe != "":
        probe = probe[1:].strip()
    if not probe:
        return None
    kinds = _TRIED.get(probe[0])
    if kinds is None:
        if probe[0].isascii():
            return None
        kinds = tuple(_LINE)
    elif kinds[0] in _BARE and kinds[-1] == kinds[0] and not _ENUMERATED.match(probe):
        return None
    for kind in kinds:
        if m := _LINE[kind].match(probe):
            raw = (m[2] or "").strip().rstrip(".:)")
            return Marker(kind, canonical(kind, raw), raw, m[1].strip(), m[3].strip(), quoted)
    return None


def unmarked(text: str) -> str:
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@functools.lru_cache(4096)
def slug(value: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "-", unmarked(value).replace("đ", "dd").replace("Đ", "DD")).strip("-") or "x"


# -- numbering ----------------------------------------------------------------------------------

Value = tuple[int, int] | None
_RANK = {letter: i for i, letter in enumerate(P.POINT_ORDER, 1)}
_ROMAN = re.compile("M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})")
_WORTH = dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000)))


def roman(numeral: str) -> int | None:
    """1 to 3999 for canonical numerals, else None."""
    numeral = numeral.strip().upper()
    if not numeral or not _ROMAN.fullmatch(numeral):
        return None
    worth = [_WORTH[c] for c in numeral]
    return sum(-a if a < b else a for a, b in zip(worth, [*worth[1:], 0]))


@functools.lru_cache(65536)
def value(number: str, kind: str) -> Value:
    """(base, suffix) of a number, or None where legal numbering doesn't know it."""
    number = number.strip().rstrip(".:)")
    low = number.lower()
    if not number:
        return None
    if kind == "point":
        m = re.fullmatch(r"([a-zđ])(\d*)", low)
        return (_RANK[m[1]], int(m[2] or 0)) if m and m[1] in _RANK else None
    if kind in ("article", "clause"):
        m = re.fullmatch(r"(\d{1,4})([a-zđ]?)", low)
        return (int(m[1]), _RANK[m[2]] if m[2] else 0) if m and (not m[2] or m[2] in _RANK) else None
    folded = re.sub(r"^thu\s+", "", unmarked(low).replace("đ", "d")).strip()
    found = int(folded) if folded.isdecimal() else roman(number) or P.ORDINAL_WORDS.get(folded) or (_RANK.get(low) if len(low) == 1 else None)
    return None if found is None else (found, 0)


def transition(before: Value, now: Value) -> str:
    """How numbering moves from one known number to the next."""
    if before is None or now is None:
        return "unknown"
    step, inner = now[0] - before[0], now[1] - before[1]
    if step == 0:
        return "same" if inner == 0 else "backward" if inner < 0 else "suffix_next" if inner == 1 else "jump"
    return "next" if (step, now[1]) == (1, 0) else "backward" if step < 0 else "jump"


def follows(before: Value, now: Value, first: bool) -> bool:
    """Whether a list may go on with ``now``; ``first``: whether it may begin there."""
    if first:
        return now == (1, 0)
    return transition(before, now) in ("next", "suffix_next")
