"""Legal numbering as ordinals ``struct<base, suffix>`` and the transitions between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import fold_ascii, let, strip


def point_rank(letter: Column) -> Column:
    """1 for a, 5 for đ, ...; 0 for a letter that legal lists don't use."""
    return F.coalesce(F.instr(F.lit(P.POINT_ORDER), letter), F.lit(0)) * F.when(F.length(letter) > 0, 1).otherwise(0)


# Digits of each decimal place as one, five and ten.
_PLACES = [("M{0,3}", 1000, "M??"), ("CM|CD|D?C{0,3}", 100, "CDM"), ("XC|XL|L?X{0,3}", 10, "XLC"), ("IX|IV|V?I{0,3}", 1, "IVX")]
# End of the fixed values.


def roman(value: Column) -> Column:
    """1 to 3999 for canonical Roman numerals, else null."""
    pattern = "^" + "".join(f"({form})" for form, _, _ in _PLACES) + "$"

    def digit(v: Column, k: int) -> Column:
        one, five, ten = _PLACES[k][2]
        return let(F.regexp_extract(v, pattern, k + 1), lambda g: F.when(g == one + ten, 9).when(g == one + five, 4).otherwise(F.length(g) + F.when(g.startswith(five), 4).otherwise(0)))

    return let(F.upper(strip(value)), lambda v: F.when((v != "") & v.rlike(pattern), sum((digit(v, k) * unit for k, (_, unit, _) in enumerate(_PLACES)), F.lit(0))))


def _value(base: Column, suffix: Column) -> Column:
    return F.struct(base.cast("int").alias("base"), suffix.cast("int").alias("suffix"))


def sequence_value(number: Column, kind: Column) -> Column:
    def point(low: Column) -> Column:
        letter, digits = (F.regexp_extract(low, r"^([a-zđ])(\d*)$", k) for k in (1, 2))
        return let(point_rank(letter), lambda rank: F.when(rank > 0, _value(rank, F.coalesce(F.when(digits != "", digits.try_cast("int")), F.lit(0)))))

    def plain(low: Column) -> Column:
        base, tail = (F.regexp_extract(low, r"^(\d{1,4})([a-zđ]?)$", k) for k in (1, 2))
        return let(point_rank(tail), lambda rank: F.when((base != "") & ((tail == "") | (rank > 0)), _value(base.try_cast("int"), rank)))

    def major(raw: Column) -> Column:
        def named(folded: Column) -> Column:
            words = F.create_map(*[F.lit(x) for pair in P.ORDINAL_WORDS.items() for x in pair])
            return F.coalesce(F.when(folded.rlike(r"^\d+$"), folded.try_cast("int")), roman(raw), F.try_element_at(words, folded), F.when((F.length(raw) == 1) & (point_rank(F.lower(raw)) > 0), point_rank(F.lower(raw))))

        n = let(strip(F.regexp_replace(fold_ascii(strip(raw)), r"(?U)^thu\s+", "")), named)
        return let(n, lambda x: F.when(x.isNotNull(), _value(x, F.lit(0))))

    def of(raw: Column) -> Column:
        return F.when(raw == "", F.lit(None)).when(kind == "point", point(F.lower(raw))).when(kind.isin("article", "clause"), plain(F.lower(raw))).otherwise(major(raw))

    return let(F.regexp_replace(strip(F.coalesce(number, F.lit(""))), "[.:)]+$", ""), of)


def compared(before: Column, now: Column, first: Column) -> Column:
    """Transition between two values; ``first``: there is nothing before."""

    def of(x: Column) -> Column:
        b, s, pb, ps = x["now"]["base"], x["now"]["suffix"], x["before"]["base"], x["before"]["suffix"]
        same_base = F.when(s == ps, "same").when((s == ps + 1) & (s > 0), "suffix_next").when(s < ps, "backward").otherwise("jump")
        other = F.when((b == pb + 1) & (s == 0), "next").when(b < pb, "backward").otherwise("jump")
        return F.when(x["now"].isNull(), "unknown").when(x["first"], "first").when(x["before"].isNull(), "unknown").when(b == pb, same_base).otherwise(other)

    return let(F.struct(before.alias("before"), now.alias("now"), first.alias("first")), of)


def transition(before: Column, now: Column, kind: Column) -> Column:
    return compared(sequence_value(before, kind), sequence_value(now, kind), before.isNull())


def starts_sequence(number: Column, kind: Column) -> Column:
    return let(sequence_value(number, kind), lambda v: F.coalesce((v["base"] == 1) & (v["suffix"] == 0), F.lit(False)))


def clause_follows(before: Column, now: Column) -> Column:
    """Whether a list of clauses may go on with ``now``: 1, 2, 2a, 2b, 3; a null before lets it begin with 1."""

    def of(x: Column) -> Column:
        goes_on = compared(x["before"], x["now"], F.lit(False)).isin("next", "suffix_next")
        starts = (x["now"]["base"] == 1) & (x["now"]["suffix"] == 0)
        # a letter that lists don't use still lets the next number follow
        plain = F.regexp_extract(F.coalesce(before, F.lit("")), r"^(\d{1,3})[a-zđ]?$", 1).try_cast("int")
        after_unknown = x["before"].isNull() & (x["now"]["base"] == plain + 1) & (x["now"]["suffix"] == 0)
        ok = F.when(before.isNull(), starts).otherwise(goes_on | F.coalesce(after_unknown, F.lit(False)))
        return F.coalesce(ok & (x["now"]["base"] <= P.LAST_CLAUSE), F.lit(False))

    return let(F.struct(sequence_value(before, F.lit("clause")).alias("before"), sequence_value(now, F.lit("clause")).alias("now")), of)
