"""The annex cut as column expressions; ``normal`` states the same over plain strings, for the pass over documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import patterns as P
from ..functions import text as T


def annex_number(line: Column) -> Column:
    """Number of a line that starts the annex tail ('' if it has none); null for any other line."""
    pattern = P.JAVA + P.LINE["annex"]

    def of(p: Column) -> Column:
        heading = M.annex_heading(F.lit("annex"), line, T.strip(F.regexp_extract(p, pattern, 3)))
        return F.when(p.rlike(pattern) & heading, M.canonical_number(F.lit("annex"), F.regexp_extract(p, pattern, 2)))

    return T.let(M.probe(line), of)


def split_annex(text: Column) -> Column:
    """``struct<main, annex, line, heading, number>``; without an annex all but ``main`` are null.

    The first line that starts an annex cuts.  A heading without a number takes that of the first
    numbered one in the next three lines.  Only texts with an annex's keyword at a line's start are split into lines.
    """
    whole = F.struct(text.alias("main"), *[F.lit(None).cast(t).alias(n) for n, t in (("annex", "string"), ("line", "int"), ("heading", "string"), ("number", "string"))])

    def of(x: Column) -> Column:
        ls, nos = x["lines"], x["nos"]
        at = F.coalesce(F.array_position(F.transform(nos, lambda n: n.isNotNull()), F.lit(True)), F.lit(0)).cast("int")

        def cut(a: Column) -> Column:
            near = F.get(F.filter(F.slice(nos, a, F.lit(P.ANNEX_NEAR + 1)), lambda n: n.isNotNull() & (n != "")), F.lit(0))
            own = F.get(nos, a - 1)
            joined = lambda part: T.strip(F.array_join(part, "\n"))
            return F.struct(
                joined(F.slice(ls, F.lit(1), a - 1)).alias("main"), joined(F.slice(ls, a, F.size(ls))).alias("annex"), a.alias("line"),
                T.strip(F.get(ls, a - 1)).alias("heading"), F.coalesce(F.when(own != "", own), near, F.lit("")).alias("number"),
            )

        return F.when(at > 0, T.let(at, cut)).otherwise(whole)

    numbered = lambda ls: F.struct(ls.alias("lines"), F.transform(ls, annex_number).alias("nos"))
    keyword = P.KEYWORDS["annex"]
    return F.when(text.rlike(rf"(?iuU)(?:^|[\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029])\s*[“\"‘']?\s*{keyword}"), T.let(T.let(T.lines(text), numbered), of)).otherwise(whole)
