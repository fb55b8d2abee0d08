"""The pass over each document's lines: markers, quotes, decisions, the tree, its content and what is said of it.

A document is one row, so nothing is shuffled: an Arrow function reads bodies and returns, per document, arrays of
lines, nodes and diagnostics.  All state is local to a row.  What is needed of the lines before is carried along (open
quotes, the scope, the last accepted numbers, the active branch), what is needed of those after is one backward scan.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..functions import patterns as P
from . import lines as L
from . import normal as N
from .recover import SEEN, SEEN_CHARS, Quotes, logical_lines

# Decision codes, scores and reasons; texts of diagnostics.
ACCEPTED = {
    "clause": {True: (0.98, "explicit_clause_keyword"), False: (0.93, "valid_bare_clause_sequence")},
    "point": {True: (0.99, "explicit_point_keyword"), False: (0.96, "canonical_point_parenthesis")},
    "major": (0.98, "explicit_major_keyword"),
    "dotted": (0.88, "ambiguous_dot_resolved_by_sequence"),
}
REJECTED = {
    "structural_reference_kept_as_text": (0.05, "reference_lexical_cue"),
    "clause_without_article": (0.05, "no_article_scope"),
    "invalid_clause_number": (0.0, None),
    "implausible_clause_number": (0.05, "clause_number_gt_300"),
    "numeric_data_not_clause": (0.02, "numeric_payload_shape"),
    "noninitial_bare_clause": (0.20, "bare_clause_does_not_start_at_1"),
    "nonsequential_bare_clause": (0.20, "clause_sequence:{}"),
    "point_without_article": (0.05, "no_article_scope"),
    "ambiguous_dotted_point": (0.35, "isolated_bare_letter_dot"),
    "ambiguous_point_marker": (0.30, "weak_point_delimiter"),
}
MESSAGES = {
    "embedded_quoted_marker": "Kept quoted {} marker as content: {}",
    "annex_reference_kept_as_text": "Kept in-body annex reference as content: {}",
    "rejected": "Rejected ambiguous marker and kept it as text: {}",
    "major": "{} numbering in scope {} moves from {} to {} ({}).",
    "point": "Point numbering moves from {} to {} ({}).",
    "duplicate_element_id": "Duplicate element_id: {}",
    "article_number_reversal": "Article numbering in primary body moves backward from {} to {}; source may be reordered, quoted, or OCR-corrupted.",
    "empty_input": "Input contains no parseable text.",
    "annex_tail_extracted": "No primary-body markers were parsed because the document begins with an annex block.",
    "no_structural_markers": "No legal structural markers were recognized; text was preserved as preamble content.",
}
TITLES = {"clause": "Khoản {}", "point": "Điểm {}", "preamble": "Preamble"}
# End of the fixed values.

_LEVEL = {kind: i for i, kind in enumerate(P.LEVELS)}
_ARTICLE, _CLAUSE, _POINT = 5, 6, 7
_QUOTE = re.compile("[“”‘’\"']")
_BARS, _NUMBER, _MONEY = re.compile(P.BARS), re.compile(P.NUMERIC_START), re.compile(P.MONEY, re.I)
_GOES_ON, _CUE = re.compile(P.CITATION_GOES_ON, re.I), re.compile(P.REFERENCE_REST, re.I)
_OVER = ("same", "jump", "backward")


def collapsed(text: str) -> str:
    return " ".join(text.split())


@functools.lru_cache(SEEN)
def heading_like(line: str) -> bool:
    v = line.strip().strip("_-")
    letters = sum(map(str.isalpha, v))
    if not letters or len(v) > P.HEADING_CHARS:
        return False
    part, whole = P.HEADING_CAPITALS
    return whole * sum(map(str.isupper, v)) >= part * letters or len(v.split()) <= P.HEADING_WORDS and not re.search(r"[.!?;:]\n?\Z", v)


@functools.lru_cache(SEEN)
def cited(m: L.Marker) -> bool:
    """A heading's keyword at the start of a line that goes on as a citation."""
    if m.kind in ("clause", "point", "annex") or not m.rest:
        return False
    return bool(_GOES_ON.match(m.rest)) or m.marker[-1:] not in (".", ":") and bool(_CUE.match(m.rest))


def _explicit(m: L.Marker) -> bool:
    """Whether a clause or point is named by its keyword."""
    return m.marker[0].isalpha() and m.marker[1:2].isalpha()


@functools.lru_cache(SEEN)
def _payload(m: L.Marker) -> bool:
    """A bare clause number that begins a date, an amount or a table row."""
    leading_zero = len(m.number) > 1 and m.number[0] == "0"
    return leading_zero or bool(m.rest and (_BARS.match(m.rest) or _NUMBER.match(m.rest) or _MONEY.match(m.rest)))


class Numbers:
    """Scope and last accepted numbers, and the decisions that depend on them."""

    def __init__(self) -> None:
        self.in_article = False
        # a number that was accepted is held in a tuple of its own, as legal numbering may not know its value
        self.clause: tuple[L.Value] | None = None
        self.point: tuple[L.Value] | None = None

    def judge(self, m: L.Marker, following: L.Marker | None) -> tuple[bool, str | None, float, list[str]]:
        """(accepted, code of a rejection, score, reasons)"""
        if cited(m):
            return self._no("structural_reference_kept_as_text")
        if m.kind == "clause":
            return self._clause(m)
        if m.kind == "point":
            return self._point(m, following)
        return True, None, ACCEPTED["major"][0], [ACCEPTED["major"][1]]

    def _no(self, code: str, *of: str) -> tuple[bool, str | None, float, list[str]]:
        score, reason = REJECTED[code]
        return False, code, score, [reason.format(*of)] if reason else []

    def _yes(self, score: float, *reasons: str) -> tuple[bool, str | None, float, list[str]]:
        return True, None, score, [*reasons]

    def _clause(self, m: L.Marker) -> tuple[bool, str | None, float, list[str]]:
        explicit, now = _explicit(m), L.value(m.number, "clause")
        base = re.match(r"\d+", m.number)
        if not self.in_article:
            return self._no("clause_without_article")
        if base is None:
            return self._no("invalid_clause_number")
        if int(base[0]) > P.LAST_CLAUSE:
            return self._no("implausible_clause_number")
        if not explicit:
            if _payload(m):
                return self._no("numeric_data_not_clause")
            if self.clause is None and now != (1, 0):
                return self._no("noninitial_bare_clause")
            moved = "first" if self.clause is None else L.transition(self.clause[0], now)
            if moved not in ("first", "next", "suffix_next"):
                return self._no("nonsequential_bare_clause", moved)
        return self._yes(*ACCEPTED["clause"][explicit])

    def _point(self, m: L.Marker, following: L.Marker | None) -> tuple[bool, str | None, float, list[str]]:
        if not self.in_article:
            return self._no("point_without_article")
        if _explicit(m) or m.marker[-1] == ")":
            return self._yes(*ACCEPTED["point"][_explicit(m)])
        if m.marker[-1] != ".":
            return self._no("ambiguous_point_marker")
        now = L.value(m.number, "point")
        after = L.transition(now, L.value(following.number, "point")) if following and following.kind == "point" else ""
        before = L.transition(self.point[0], now) if self.point else ""
        for word, moved in (("continues", before), ("starts", after)):
            if moved in ("next", "suffix_next"):
                return self._yes(ACCEPTED["dotted"][0], f"{word}_point_sequence:{moved}", ACCEPTED["dotted"][1])
        return self._no("ambiguous_dotted_point")

    def enter(self, m: L.Marker) -> None:
        """Take in an accepted node."""
        if m.kind == "point":
            self.point = (L.value(m.number, "point"),)
        else:
            self.point = None
            self.clause = (L.value(m.number, "clause"),) if m.kind == "clause" else None
            self.in_article = m.kind == "article" or self.in_article and m.kind == "clause"


class Branch:
    """The active path of the tree: by level the node that is open, ids given below it and the last numbers there."""

    def __init__(self) -> None:
        self.open: list[tuple[int, int, str]] = []  # (level, node, id)
        self.given: dict[tuple[int, str], int] = {}
        self.last: dict[tuple[int, str], str] = {}

    def add(self, seq: int, m: L.Marker) -> tuple[int, int, str | None, str, int, str | None]:
        """(level, parent's number, its id, id, depth, the number before of the same kind in the same place)"""
        level = _LEVEL[m.kind]
        while self.open and self.open[-1][0] >= level:
            self.open.pop()
        _, parent, parent_id = self.open[-1] if self.open else (-1, 0, None)
        base = f"{m.kind}-{L.slug(m.number or 'x')}"
        n = self.given[parent, base] = self.given.get((parent, base), 0) + 1
        own = base if n == 1 else f"{base}-{n}"
        path, depth = f"{parent_id}/{own}" if parent_id else own, len(self.open)
        before = None
        if level != _CLAUSE:
            # points count within the last node above them, whatever its kind
            before = self.last.get((parent, m.kind))
            self.last[parent, m.kind] = m.number
        self.open.append((level, seq, path))
        return level, parent, parent_id, path, depth, before


LINE = "line_no int, text string, source string, kind string, number string, raw_number string, marker string, rest string, inside_quote boolean, accepted boolean, code string, score double, reasons array<string>, next_marker string"
NODE = (
    "node_seq int, parent_seq int, element_id string, parent_id string, element_type string, level int, depth int, number string, title string, raw_text string, normalized_text string, "
    "marker string, raw_number string, line_no int, source string, embedded boolean, context_score double, context_reasons array<string>"
)
DIAGNOSTIC = "diag_seq int, code string, message string, severity string, line_no int, evidence_score double, reasons array<string>"


def _marker(text: str) -> tuple[L.Marker | None, bool]:
    """The line's marker, and whether quotation marks are in it."""
    return L.read_marker(text), bool(_QUOTE.search(text))


_known_marker = functools.lru_cache(SEEN)(_marker)


def read_lines(body: str) -> tuple[list[tuple[str, str, L.Marker | None, bool]], bool, int, int]:
    """(text, source, marker, inside quotes) of every logical line; flat layout, boundaries made, lines cut."""
    parts, flat, made, cut = logical_lines(body)
    quotes, out = Quotes(), []
    for text, source in parts:
        m, marked = (_known_marker if len(text) <= SEEN_CHARS else _marker)(text)
        out.append((text, source, m, m is not None and (m.quoted or bool(quotes))))
        if marked:
            for q in _QUOTE.finditer(text):
                quotes.read(text, q.start())
    return out, flat, made, cut


def parse_body(body: str, empty: bool, has_annex: bool, keep_lines: bool = True) -> dict[str, Any]:
    """Rows of ``LINE`` (if asked for), ``NODE`` and ``DIAGNOSTIC``, and what layout recovery counted."""
    rows, flat, made, cut = read_lines(body)
    following, ahead = None, [None] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        ahead[i] = following
        following = rows[i][2] or following
    numbers, branch = Numbers(), Branch()
    lines: list[tuple] = []
    nodes: list[list] = [[0, 0, "preamble", None, "preamble", None, 0, "", TITLES["preamble"], [], None, None, None, None, None, False, None, None]]
    said: list[tuple] = []
    untitled = False
    for seq, (text, source, m, quoted) in enumerate(rows, 1):
        accepted, code, score, reasons = (False, None, None, []) if m is None or quoted else numbers.judge(m, ahead[seq - 1])
        if keep_lines:
            n = ahead[seq - 1]
            lines.append((seq, text, source, m and m.kind, m and m.number, m and m.raw_number, m and m.marker, m and m.rest, quoted, accepted, code, score, reasons, n and f"{n.kind} {n.number}"))
        if m is None:
            if untitled and heading_like(text):
                nodes[-1][8] = text.strip()
            else:
                nodes[-1][9].append(text.strip())
            untitled = False
            continue
        if accepted and m.kind in _LEVEL:
            numbers.enter(m)
            level, parent, parent_id, path, depth, before = branch.add(seq, m)
            minor = level >= _CLAUSE
            title = TITLES[m.kind].format(m.number) if minor else m.rest
            content = [m.rest] if minor and m.rest else []
            nodes.append([seq, parent, path, parent_id, m.kind, level, depth, m.number, title, content, None, m.marker, m.raw_number or m.number, seq, source, False, score, reasons])
            untitled = not minor and not m.rest
            if before is not None and (moved := L.transition(L.value(before, m.kind), L.value(m.number, m.kind))) in _OVER:
                place = (before, m.number, moved)
                message = MESSAGES["point"].format(*place) if level == _POINT else MESSAGES["major"].format(m.kind, parent_id or "__root__", *place)
                said.append((f"{m.kind}_sequence_{moved}", message, "info" if level == _POINT or moved == "jump" else "warning", seq, None, None))
            continue
        nodes[-1][9].append(text.strip())
        if quoted:
            said.append(("embedded_quoted_marker", MESSAGES["embedded_quoted_marker"].format(m.kind, m.marker), "info", seq, None, None))
        elif accepted:
            said.append(("annex_reference_kept_as_text", MESSAGES["annex_reference_kept_as_text"].format(m.marker), "info", seq, None, None))
        else:
            severity = "warning" if source != "line" or code == "invalid_clause_number" else "info"
            said.append((code, MESSAGES["rejected"].format(m.marker), severity, seq, score, reasons))
    for node in nodes:
        node[9] = "\n".join(filter(None, node[9]))
        node[10] = collapsed(node[9]) if node[9] else ""
    bare = len(nodes) == 1
    nodes = nodes if nodes[0][9] else nodes[1:]
    said += _checked(nodes)
    if empty or bare:
        code, severity = ("empty_input", "error") if empty else ("annex_tail_extracted", "info") if has_annex else ("no_structural_markers", "warning")
        said.append((code, MESSAGES[code], severity, None, None, None))
    return {"lines": lines, "nodes": nodes, "diagnostics": [(i, *d) for i, d in enumerate(said, 1)], "flat": flat, "made": made, "cut": cut, "n": len(rows)}


def _checked(nodes: list[list]) -> Iterator[tuple]:
    """Ids given twice, then articles whose number falls behind the one before by more than one."""
    seen: dict[str, int] = {}
    for node in nodes:
        seen[node[2]] = seen.get(node[2], 0) + 1
    for path, n in seen.items():
        if n > 1:
            yield "duplicate_element_id", MESSAGES["duplicate_element_id"].format(path), "error", None, None, None
    last = None
    for node in nodes:
        if node[4] == "article" and (m := re.search(r"\d+", node[7])):
            now = int(m[0])
            if last is not None and now + 1 < last:
                yield "article_number_reversal", MESSAGES["article_number_reversal"].format(last, node[7]), "warning", None, None, None
            last = now


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
#: a row per reference, and what statistics need of a document
REFERENCE = "node_seq int, source_element_id string, ref_no int, text string, point string, clause string, article string, start int, end int"
COUNTS = "flattened boolean, made int, cut int, logical_line_count int, node_count int, embedded int, errors int, warnings int, infos int, nothing boolean, reference_count int"
PREPARED = "source_content_sha256 string, raw_character_count int, normalized_characters int, annex string, annex_line int, annex_heading string, annex_number string, main_characters int, body string"
TABLES = {"lines": "place int, " + LINE, "nodes": "place int, " + NODE, "diagnostics": "place int, " + DIAGNOSTIC, "references": REFERENCE}


def _fields(schema: str) -> dict[str, str]:
    return dict(f.rsplit(" ", 1) for f in schema.split(", "))


def _cited_in(nodes: list[list]) -> list[list[tuple]]:
    return [N.references(N.node_text(n[8], n[10])) for n in nodes]


def _rows(table: str, prepared: N.Prepared, lines: bool) -> tuple[dict[str, Any], list]:
    """A parsed document, and its rows of ``table`` without their place."""
    got = parse_body(prepared.body, prepared.normalized_characters == 0, prepared.annex is not None, lines)
    if table == "references":
        return got, [(n[0], n[2], i, t, *target, a, b) for n, found in zip(got["nodes"], _cited_in(got["nodes"])) for i, (a, b, t, *target) in enumerate(found, 1)]
    return got, got[table]


def _columns(rows: list[list], schema: str, names: list[str]) -> list[pa.Array]:
    """The columns named, of the rows of several documents."""
    fields = _fields(schema)
    at = {n: i for i, n in enumerate(n for n in fields if n != "place")}
    return [pa.array([i for doc in rows for i in range(1, len(doc) + 1)] if n == "place" else [r[at[n]] for doc in rows for r in doc], _ARROW[fields[n]]) for n in names]


def _nested(rows: list[list], schema: str, names: list[str]) -> pa.ListArray:
    """An array of structs per document, built by column."""
    structs = pa.StructArray.from_arrays(_columns(rows, schema, names), names=names)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(list(map(len, rows)))]), pa.int32()), structs)


#: characters of texts that are parsed before a batch is returned: a batch holds several times as much
LOT = 1 << 19


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[N.Prepared]]]:
    """Slices of batches with their texts prepared; only a slice's texts are Python's at a time."""
    gc.disable()  # nothing here is cyclic, and its many small tuples would be walked through again and again
    try:
        for whole in batches:
            texts = whole.column("content")
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(whole) else np.zeros(0)
            at = 0
            while at < len(whole):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + LOT, "right")))
                yield whole.slice(at, to - at), [N.prepare_text(v or "") for v in texts.slice(at, to - at).to_pylist()]
                at = to
    finally:
        gc.enable()


def _shape(docs: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Documents for the pass (kept columns and ``content``), the kept columns' names and their fields."""
    conf = docs.sparkSession.conf
    conf.set(BATCH, str(min(ROWS, int(conf.get(BATCH, "10000")) or ROWS)))  # decides memory, not results
    kept = [f for f in docs.schema.fields if f.name != "content"]
    docs = docs.select(*[f"`{f.name}`" for f in kept], docs["content"].cast("string").alias("content"))
    return docs, [f.name for f in kept], [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: rows in an Arrow batch that holds whole texts
ROWS = 500


def prepared(docs: DataFrame) -> DataFrame:
    """The kept columns and those of ``PREPARED``, a row per document."""
    docs, kept, fields = _shape(docs)
    types = _fields(PREPARED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _lots(batches):
            columns = [pa.array(c, _ARROW[t]) for c, t in zip(zip(*texts), types.values())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], names=[*kept, *types])

    return docs.mapInArrow(run, ", ".join([*fields, PREPARED]))


def table_rows(docs: DataFrame, table: str, names: list[str]) -> DataFrame:
    """The kept columns and those named of ``table`` (lines, nodes, diagnostics, references), a row per row of it."""
    docs, kept, fields = _shape(docs)
    schema = TABLES[table]
    types = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _lots(batches):
            rows = [_rows(table, p, table == "lines")[1] for p in texts]
            of = pa.array(np.repeat(np.arange(len(rows)), list(map(len, rows))))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in kept), *_columns(rows, schema, names)], names=[*kept, *names])

    return docs.mapInArrow(run, ", ".join([*fields, *(f"`{n}` {types[n]}" for n in names)]))


def _counted(got: dict[str, Any], refs: list[list[tuple]]) -> tuple:
    said = got["diagnostics"]
    codes, severities = [d[1] for d in said], [d[3] for d in said]
    return got["flat"], got["made"], got["cut"], got["n"], len(got["nodes"]), codes.count("embedded_quoted_marker"), *map(severities.count, ("error", "warning", "info")), "empty_input" in codes, sum(map(len, refs))


def summaries(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: the kept columns, ``PREPARED`` without body, ``COUNTS``, ``element_counts``.

    ``more`` may name ``diagnostics`` and ``references`` (arrays) and ``structure`` (the nodes nested as JSON).
    """
    docs, kept, fields = _shape(docs)
    types, counts = _fields(PREPARED), _fields(COUNTS)
    types.pop("body")
    arrays = {n: [f for f in _fields(TABLES[n]) if f != "place"] for n in ("diagnostics", "references") if n in more}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _lots(batches):
            parsed = [parse_body(p.body, p.normalized_characters == 0, p.annex is not None, False) for p in texts]
            refs = [_cited_in(g["nodes"]) for g in parsed]
            columns = [pa.array(c, _ARROW[t]) for c, t in zip(zip(*texts), types.values())]
            columns += [pa.array(c, _ARROW[t]) for c, t in zip(zip(*map(_counted, parsed, refs)), counts.values())]
            kinds = [[n[4] for n in g["nodes"]] for g in parsed]
            columns.append(pa.array([[(k, ks.count(k)) for k in sorted(set(ks))] for ks in kinds], pa.map_(pa.string(), pa.int32())))
            if "diagnostics" in arrays:
                columns.append(_nested([g["diagnostics"] for g in parsed], DIAGNOSTIC, arrays["diagnostics"]))
            if "references" in arrays:
                found = [[(n[0], n[2], i, t, *target, a, z) for n, of in zip(g["nodes"], r) for i, (a, z, t, *target) in enumerate(of, 1)] for g, r in zip(parsed, refs)]
                columns.append(_nested(found, REFERENCE, arrays["references"]))
            if "structure" in more:
                columns.append(pa.array([N.nested_json(g["nodes"], r) for g, r in zip(parsed, refs)], pa.string()))
            names = [*kept, *types, *counts, "element_counts", *arrays, *(["structure"] if "structure" in more else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], names=names)

    fields += [f"{n} {t}" for n, t in (types | counts).items()] + ["element_counts map<string,int>"]
    for n, names in arrays.items():
        of = _fields(TABLES[n])
        fields.append(f"{n} array<struct<{','.join(f'`{f}`:{of[f]}' for f in names)}>>")
    return docs.mapInArrow(run, ", ".join(fields + (["structure string"] if "structure" in more else [])))
