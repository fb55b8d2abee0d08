"""Normalising, the annex cut and references over plain strings, for the one pass that reads a document.

``functions.text``, ``operators.prepare`` and ``functions.references`` state the same as column expressions; tests hold
both forms against each other.  Classes are spelt out where Python and Java differ on them.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
import unicodedata
from json.encoder import encode_basestring
from typing import NamedTuple

from ..functions import patterns as P
from ..functions.text import composed
from . import lines as L

#: white space, and all else, as Java's Unicode classes have them
_S, _NOT_S = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
_ZS = r"[ \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]"
#: texts of these characters only have the same words in Python and Java
_EXOTIC = re.compile(r"[^\n -\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u1e00-\u1eff\u2010-\u2027\u20ab]")


@functools.cache
def _word_class() -> str:
    """Characters of words by Java's (?U): letters, letter numbers, marks, digits, connectors, joiners."""
    kinds, spans, since = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Me", "Mc", "Nd", "Pc"}, [], None
    for i in range(sys.maxunicode + 2):
        c = chr(i) if i <= sys.maxunicode else ""
        inside = bool(c) and (unicodedata.category(c) in kinds or 0x24B6 <= i <= 0x24E9 or i in (0x200C, 0x200D) or 0x1F130 <= i <= 0x1F149 or 0x1F150 <= i <= 0x1F169 or 0x1F170 <= i <= 0x1F189)
        if inside and since is None:
            since = i
        elif not inside and since is not None:
            spans.append((since, i - 1))
            since = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@functools.cache
def _exact(pattern: str, flags: int) -> re.Pattern:
    """``pattern`` with Java's boundaries and white space."""
    w = _word_class()
    edge = f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))"
    return re.compile(pattern.replace(r"[^\s", r"[^\0").replace(r"\s", _S).replace(r"[^\0", r"[^\s").replace(r"\b", edge), flags)


@functools.cache
def _plain(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


def _compiled(pattern: str, text: str, flags: int = re.I) -> re.Pattern:
    return (_exact if _EXOTIC.search(text) else _plain)(pattern, flags)


# -- normalising --------------------------------------------------------------------------------

_GONE = {0xFEFF: None, 0x200B: None}
_UNEVEN = re.compile(
    r"[\ufeff\u200b\r\t\f\x0b#\x85\u2028\u2029\x1c-\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]|  | \n|\n |\n\n\n|[Bb][Áá][Oo]\s*/|[ \n](?:"
    + "|".join(f"[{b[0].upper()}{b[0]}]" for _, b in P.SPLIT_CUES) + ")"
)
_HASHES = re.compile(rf"^{_S}{{0,3}}#{{1,6}}{_S}+", re.M)
_GAZETTE = re.compile(rf"^{_S}*CÔNG{_S}+BÁO{_S}*/{_S}*Số[^\n]*$", re.M | re.I)
_LEAD, _TAIL = re.compile(r"(^|\n)[^\S\n]+"), re.compile(r"[^\S\n]+(\n|\Z)")


def _cues() -> list[tuple[str, int, str]]:
    out = []
    for a, b in P.SPLIT_CUES:
        out += [(rf"\b{a.upper()}\s+{b.upper()}\b", 0, (a + b).upper()), (rf"\b{a[0].upper()}(?i:{a[1:]})\s+(?i:{b})\b", 0, a[0].upper() + a[1:] + b), (rf"\b{a}\s+{b}\b", re.I, a + b)]
    return out


_CUES = _cues()


def normalize_composed(text: str) -> str:
    if not text or not (_UNEVEN.search(text) or text[0].isspace() or text[-1].isspace()):
        return text
    c = re.sub(_ZS, " ", text.translate(_GONE))
    c = c.replace("\r\n", "\n").replace("\r", "\n")
    for pattern, flags, to in _CUES:
        c = _compiled(pattern, c, flags).sub(to, c)
    c = _GAZETTE.sub("", _HASHES.sub("", c))
    c = _TAIL.sub(r"\1", _LEAD.sub(r"\1", re.sub("[\t\f\x0b ]+", " ", c)))
    return re.sub("\n{3,}", "\n\n", c).strip()


def normalized(text: str) -> str:
    return normalize_composed(composed(text))


# -- the annex cut ------------------------------------------------------------------------------

_BREAK = r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_LINE_BREAK = re.compile(_BREAK)
_NEAR = re.compile("[Pp][Hh][ỤụUu]")
_WORDS = re.compile(rf"({_NOT_S}+(?:{_S}+{_NOT_S}+)?)")


def _opens_annex(text: str) -> bool:
    if not _NEAR.search(text):
        return False
    word = P.KEYWORDS["annex"].replace(r"\s", _S)
    return bool(_plain(rf"(?:\A|{_BREAK}){_S}*[“\"‘']?{_S}*{word}", re.I).search(text))


def annex_number(line: str) -> str | None:
    """Number of a line that starts the annex tail ('' if it has none); None for any other line."""
    own = line.strip()
    if own[:1] in L.QUOTES:  # also an empty line
        return None
    m = _compiled(P.LINE["annex"], own).match(own)
    if not m:
        return None
    rest, words = m[3].strip(), _WORDS.match(own)[1]
    capitals = words.upper() == words and any(unicodedata.category(c)[0] == "L" for c in words)
    heading = not rest or rest[0] == "(" or capitals and len(rest) <= P.HEADING_CHARS and not _compiled(P.ANNEX_REFERENCE, rest).match(rest)
    return L.canonical("annex", (m[2] or "").strip().rstrip(".:)")) if heading else None


def cut_annex(text: str) -> tuple[str, str, int, str, str] | None:
    """(main, annex, line, heading, number), or None for a text without an annex."""
    if not _opens_annex(text):
        return None
    ls = _LINE_BREAK.split(text)
    nos = list(map(annex_number, ls))
    at = next((i for i, n in enumerate(nos) if n is not None), None)
    if at is None:
        return None
    near = next((n for n in nos[at : at + P.ANNEX_NEAR + 1] if n), "")
    return "\n".join(ls[:at]).strip(), "\n".join(ls[at:]).strip(), at + 1, ls[at].strip(), nos[at] or near


class Prepared(NamedTuple):
    source_content_sha256: str
    raw_character_count: int
    normalized_characters: int
    annex: str | None
    annex_line: int | None
    annex_heading: str | None
    annex_number: str | None
    main_characters: int
    body: str


def prepare_text(content: str) -> Prepared:
    """Normalised once for its size, once before the annex cut and once before lines are told; a pass that changes nothing isn't repeated."""
    sha = hashlib.sha256(content.encode()).hexdigest()
    once = normalized(content)
    text = once if once == content else normalized(once)
    cut = cut_annex(text)
    main, annex, line, heading, number = cut or (text, None, None, None, None)
    settled = text == once and cut is None
    body = main if settled else normalized(main)
    return Prepared(sha, len(content), len(text), annex, line, heading, number, len(main), body)


# -- references ---------------------------------------------------------------------------------

_NAMES = ("point", "clause", "article")
_CITES, _CLAUSES = re.compile("(?:điề|die)u", re.I), re.compile("kho[ảa]n", re.I)


def references(text: str) -> list[tuple[int, int, str, str | None, str | None, str]]:
    """(start, end, text, point, clause, article) by start; the longest pattern first, what it took is blanked for the next."""
    if not _CITES.search(text):
        return []
    compiled = _exact if _EXOTIC.search(text) else _plain
    found, masked = [], text.replace("\x01", "\x03").replace("\x02", "\x03")
    for k in range(0 if _CLAUSES.search(text) else 2, 3):
        hits = list(compiled(P.REFERENCES[k], re.I).finditer(masked))
        for m in hits:
            a, b = m.span()
            parts = dict(zip(_NAMES[k:], (g.lower() for g in m.groups())))
            found.append((a, b, text[a:b], parts.get("point"), parts.get("clause"), parts["article"]))
        if hits and k < 2:
            out, at = [], 0
            for m in hits:
                out += [masked[at : m.start()], "\x02" * (m.end() - m.start())]
                at = m.end()
            masked = "".join([*out, masked[at:]])
    return sorted(found, key=lambda r: r[0])


# -- JSON as Spark writes it --------------------------------------------------------------------

_ESCAPED = re.compile(r'["\\\x00-\x1f]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(s: str) -> str:
    out = encode_basestring(s)
    # a control character without a short form is written in capitals
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", s) + '"' if "\\u00" in out else out


def node_text(title: str, normalized_text: str) -> str:
    """What references are sought in: title and content."""
    return f"{title} {normalized_text}" if title and normalized_text else title or normalized_text


def nested_json(nodes: list, refs: list[list[tuple]]) -> str:
    """The tree of a document's nodes (rows of ``structure.NODE`` in pre-order), each with its references."""
    out, last = ["["], len(nodes) - 1
    for i, n in enumerate(nodes):
        _, _, path, _, kind, level, depth, number, title, raw, flat, marker, raw_number, line_no, source, embedded, score, reasons = n
        shown = ",".join(
            f'{{"text":{quoted(t)},"target":{{{",".join(f"{chr(34)}{k}{chr(34)}:{quoted(v)}" for k, v in zip(_NAMES, target) if v is not None)}}},"start":{a},"end":{b}}}' for a, b, t, *target in refs[i]
        )
        of = "" if level is None else f'"marker":{quoted(marker)},"raw_number":{quoted(raw_number)},"line_no":{line_no},"source":{quoted(source)},"embedded":{"true" if embedded else "false"},"context_score":{score!r},"context_reasons":[{",".join(map(quoted, reasons))}]'
        comma = "," if i and depth <= nodes[i - 1][6] else ""
        closed = max(0, depth - (nodes[i + 1][6] if i < last else 0) + 1)
        out.append(
            f'{comma}{{"element_id":{quoted(path)},"element_type":"{kind}","number":{quoted(number)},"title":{quoted(title)},"content":{{"raw_text":{quoted(raw)},"normalized_text":{quoted(flat)},"provisions":[]}},"cross_references":[{shown}],"metadata":{{{of}}},"children":[{"]}" * closed}'
        )
    return "".join([*out, "]"])
