"""Recognising and judging marker lines, in column algebra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .sequence import sequence_value
from .text import fold_ascii, let, strip

MAJOR = ("part", "chapter", "section", "subsection", "division", "article")
_OPEN = "^[“\"‘']"


def canonical_number(kind: Column, number: Column) -> Column:
    def of(v: Column) -> Column:
        heading = F.when(v.rlike("(?iu)^([ivxlcdm]+|[a-zđ])$"), F.upper(v)).when(v.rlike(r"(?iuU)^(thứ|thu)\s+"), F.lower(v)).otherwise(v)
        return F.when(kind.isin("article", "clause", "point"), F.lower(v)).otherwise(heading)

    return let(F.regexp_replace(strip(F.coalesce(number, F.lit(""))), "[.:)]+$", ""), of)


def probe(line: Column) -> Column:
    """The line without what stands before its marker: spaces and one opening quote."""
    return strip(F.regexp_replace(strip(line), _OPEN, ""))


def line_kind(line: Column) -> Column:
    """Element type of a marker line, or null."""

    def tried(p: Column, kinds: list[str]) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for kind in kinds:
            out = out.when(p.rlike(P.JAVA + P.LINE[kind]), F.lit(kind))
        return out

    def of(p: Column) -> Column:
        # every other kind begins with a letter, and all but points with a keyword's two
        first, second = F.substring(p, 1, 1), F.substring(p, 2, 1)
        return F.when(first.between("0", "9"), tried(p, ["clause"])).when(first.between("a", "z") & second.isin(")", "."), tried(p, ["point"])).otherwise(tried(p, [*P.LINE]))

    return let(probe(line), of)


def marker_groups(kind: Column, line: Column) -> Column:
    """``struct<marker, number, rest>`` of a line whose ``line_kind`` is known."""

    def of(p: Column) -> Column:
        out = F.when(F.lit(False), F.array(F.lit("")))
        for name, pattern in P.LINE.items():
            out = out.when(kind == name, F.array(*[F.regexp_extract(p, P.JAVA + pattern, k) for k in (1, 2, 3)]))
        return out

    return let(let(probe(line), of), lambda g: F.struct(strip(g[0]).alias("marker"), F.regexp_replace(strip(g[1]), "[.:)]+$", "").alias("number"), strip(g[2]).alias("rest")))


def own_quote(line: Column) -> Column:
    return strip(line).rlike(_OPEN)


def explicit_keyword(kind: Column, marker: Column) -> Column:
    folded = fold_ascii(marker)
    return F.when(kind == "clause", folded.startswith("khoan ")).when(kind == "point", folded.startswith("diem ")).otherwise(True)


def delimiter(marker: Column) -> Column:
    return F.regexp_extract(marker, r"([.):\-])$", 1)


def numeric_payload(kind: Column, number: Column, marker: Column, rest: Column) -> Column:
    """A bare clause number that begins a date, an amount or a table row."""
    bare = (kind == "clause") & ~explicit_keyword(kind, marker)
    return bare & (number.rlike("^0.") | rest.rlike("^" + P.BARS) | rest.rlike("(?U)" + P.NUMERIC_START) | rest.rlike(P.JAVA + P.MONEY))


def structural_reference(kind: Column, marker: Column, rest: Column) -> Column:
    """A heading keyword at a line's start that goes on as a citation."""
    cited = rest.rlike(P.JAVA + P.CITATION_GOES_ON) | (~delimiter(marker).isin(".", ":") & rest.rlike(P.JAVA + P.REFERENCE_REST))
    return kind.isin(*MAJOR) & cited


def annex_heading(kind: Column, line: Column, rest: Column) -> Column:
    """A line that starts the annex tail."""
    words = F.regexp_extract(strip(line), r"(?U)^(\S+(?:\s+\S+)?)", 1)
    capitals = (F.upper(words) == words) & words.rlike(r"\p{L}")
    heading = (rest == "") | rest.startswith("(") | (~rest.rlike(P.JAVA + P.ANNEX_REFERENCE) & capitals & (F.length(rest) <= P.HEADING_CHARS))
    return (kind == "annex") & ~strip(line).rlike(_OPEN) & heading


def clause_value(number: Column) -> Column:
    return sequence_value(number, F.lit("clause"))


def quote_marks(line: Column) -> dict[str, Column]:
    """Per line: sum and least prefix sum of both curly kinds, and counts of straight marks that toggle."""

    def walk(opens: str, closes: str) -> Column:
        marks = F.split(F.regexp_replace(line, f"[^{opens}{closes}]", ""), "")
        steps = F.transform(F.filter(marks, lambda m: m != ""), lambda m: F.when(m == opens, 1).otherwise(-1))
        zero = F.struct(F.lit(0).alias("s"), F.lit(0).alias("low"))
        return F.aggregate(steps, zero, lambda a, d: F.struct((a["s"] + d).alias("s"), F.least(a["low"], a["s"] + d).alias("low")))

    word = r"[\p{L}\p{N}]"
    return {"curly": walk("“", "”"), "single_curly": walk("‘", "’"), "double": F.regexp_count(line, F.lit('"')), "single": F.regexp_count(line, F.lit(rf"(?<!{word})'|'(?!{word})"))}
