"""Cross-references as masked passes: the longest pattern first, what it took is blanked for the next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import let

_CUT, _BLANK = "\x01", "\x02"
TYPE = "array<struct<start:int,end:int,text:string,point:string,clause:string,article:string>>"


def _pass(text: Column, masked: Column, k: int) -> Column:
    """``struct<found, masked>``: matches of pattern k, and the text with them blanked."""
    pattern, names = P.REFERENCES[k], ("point", "clause", "article")[k:]

    def of(pieces: Column) -> Column:
        at = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))

        def match(x: Column, i: Column) -> Column:
            start = at(i)
            shown = F.substr(text, start + 1, F.length(x))
            part = lambda n: (F.lower(F.regexp_extract(x, f"(?iuU)^{pattern}", names.index(n) + 1)) if n in names else F.lit(None).cast("string")).alias(n)
            return F.when(i % 2 == 1, F.struct(start.alias("start"), (start + F.length(x)).alias("end"), shown.alias("text"), part("point"), part("clause"), part("article")))

        blanked = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.repeat(F.lit(_BLANK), F.length(x))).otherwise(x))
        return F.struct(F.filter(F.transform(pieces, match), lambda m: m.isNotNull()).alias("found"), F.array_join(blanked, "").alias("masked"))

    return let(F.split(F.regexp_replace(masked, f"(?iuU)({pattern})", f"{_CUT}$1{_CUT}"), _CUT), of)


def cross_references(text: Column) -> Column:
    """``array<struct<start, end, text, point, clause, article>>`` by start; offsets in code points."""

    def of(t: Column) -> Column:
        third = lambda a, b: let(_pass(t, b["masked"], 2), lambda c: F.array_sort(F.concat(a["found"], b["found"], c["found"])))
        return let(_pass(t, F.translate(t, _CUT + _BLANK, "\x03\x03"), 0), lambda a: let(_pass(t, a["masked"], 1), lambda b: third(a, b)))

    none = F.array().cast(TYPE)
    return F.when(text.rlike(r"(?iuU)\b(?:Điều|Dieu)\s"), let(text, of)).otherwise(none)
