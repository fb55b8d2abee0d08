"""Order MinHash fingerprints.  DataFrame functions only.

A text's k-mers are runs of ``K`` words (a shorter text is one k-mer), numbered by occurrence, so the
nth copy of a k-mer is an element of its own.  A hash deals the (k-mer, occurrence) pairs into
``BINS`` bins; the two minimal pairs of each bin are kept *in text order* and hashed together.  Two
texts agree in a bin only if the same pairs are minimal and stand in the same order, which makes
the fingerprint sensitive to edit distance and not to content alone.  Likeness is the share of
bins that agree among those either text fills (1 if neither fills any).

One pair is a long: 33 bits of hash (bin first) above 30 bits of position, so sorting longs
orders pairs by bin and hash; a 31-bit string length keeps positions below 2^30.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

K = 2
BIN_BITS = 6
_POS = 30
_MASK = (1 << _POS) - 1
_BIN = 33 + _POS - BIN_BITS
#: rows that are put in order by one task, about
ROWS_A_BUCKET = 2048
#: buckets by bounds in the plan; where more are needed each is cut into as many again by bounds in a table
MAX_BUCKETS = 4096
#: buckets whose heads are broadcast; more are joined
MAX_HEADS = 1 << 20


def _pair(h: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, 31), _POS).bitwiseOR(pos)


def _hash(x: Column) -> Column:
    return F.shiftrightunsigned(x, _POS)


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``, a sorted array of longs (bin above 40 bits of hash), for the text column named.

    Each step is a projection of its own, so that arrays are computed once and the sorts run
    in generated code.
    """
    keep, w, s, starts, pairs, best = [F.col(c) for c in df.columns], "_omh_w", "_omh_s", "_omh_at", "_omh_p", "_omh_b"
    n = F.size(w)
    df = df.select(*keep, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D\x20]+"), "").alias(w))
    grams = F.transform(F.slice(w, F.lit(1), F.greatest(n - K + 1, F.least(n, F.lit(1)))), lambda x, i: _pair(F.xxhash64(x, *(F.get(w, i + j) for j in range(1, K))), i.cast("long")))
    df = df.select(*keep, grams.alias(s))
    df = df.select(*keep, F.sort_array(s).alias(s))
    first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (_hash(F.get(s, i)) != _hash(F.get(s, i - 1))))
    df = df.select(*keep, F.col(s), F.when(F.size(s) > 0, first).otherwise(F.array().cast("array<int>")).alias(starts))

    def later(at: Column, i: Column) -> Column:
        """The second and later occurrences of the k-mer whose run starts there."""
        end = F.coalesce(F.get(starts, i + 1), F.size(s))
        again = F.transform(F.sequence(at + 1, end - 1), lambda j: _pair(F.xxhash64(_hash(F.get(s, at)), j - at), F.get(s, j).bitwiseAND(F.lit(_MASK))))
        return F.when(end > at + 1, again).otherwise(F.array().cast("array<bigint>"))

    df = df.select(*keep, F.concat(F.transform(starts, lambda at: F.get(s, at)), F.flatten(F.transform(starts, later))).alias(pairs))
    df = df.select(*keep, F.sort_array(F.filter(pairs, lambda x: x.isNotNull())).alias(pairs))
    bin_of = lambda x: F.shiftrightunsigned(x, _BIN)
    df = df.select(*keep, F.filter(pairs, lambda x, i: (i < 2) | (bin_of(x) != bin_of(F.get(pairs, i - 2)))).alias(best))

    def signed(x: Column, i: Column) -> Column:
        y = F.get(best, i + 1)
        same = F.coalesce(bin_of(x) == bin_of(y), F.lit(False))
        before = x.bitwiseAND(F.lit(_MASK)) < y.bitwiseAND(F.lit(_MASK))
        h = F.when(~same, F.xxhash64(_hash(x))).when(before, F.xxhash64(_hash(x), _hash(y))).otherwise(F.xxhash64(_hash(y), _hash(x)))
        new = (i == 0) | (bin_of(x) != bin_of(F.get(best, i - 1)))
        return F.when(new, F.shiftleft(bin_of(x), 40).bitwiseOR(F.shiftrightunsigned(h, 24)))

    return df.select(*keep, F.filter(F.transform(best, signed), lambda x: x.isNotNull()).alias(out))


def rendered(fp: Column) -> Column:
    """Twelve hex digits for each filled bin."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda x: F.transform(x, lambda v: F.shiftrightunsigned(v, 40))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _below(bounds: Column, most: int) -> Column:
    """How many of up to ``most`` sorted bounds aren't above ``k``, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= F.col("k")), at + step).otherwise(at))


def with_next(docs: DataFrame, extra: list[str]) -> DataFrame:
    """Adds ``next_<c>`` for ``t`` and ``extra`` columns: those of the next row in descending (k, t).

    ``k`` is a long without nulls.  Rows are dealt into buckets of about ``ROWS_A_BUCKET`` between quantiles of k, so the
    order is global without one task seeing all rows.  A bucket's last row needs the head of the bucket below: that head is
    dealt to both.  Quantiles are values of k other than the least, so every bucket has rows.
    """
    wanted = [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)]
    n, low, approx = docs.agg(F.count("*"), F.min("k"), F.percentile_approx("k", wanted, 20_000)).first()
    buckets = max(1, n // ROWS_A_BUCKET)
    first = min(MAX_BUCKETS, buckets)
    bounds = sorted({approx[i * MAX_BUCKETS // first - 1] for i in range(1, first)} - {low}) if approx else []
    longs = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    dealt = docs.withColumn("bucket", (_below(longs, len(bounds)) if bounds else F.lit(0)).cast("long"))
    inner = min(MAX_BUCKETS, -(-buckets // MAX_BUCKETS))
    if inner > 1:
        spread = dealt.groupBy("bucket").agg(F.percentile_approx("k", [i / inner for i in range(1, inner)]).alias("cuts"), F.min("k").alias("low"))
        cuts = common.written(spread.select("bucket", F.array_distinct(F.filter("cuts", lambda x: x > F.col("low"))).alias("cuts")), "minhash-cuts")
        # MAX_BUCKETS rows, of up to as many longs; a plain join beyond 64 MB
        hint = F.broadcast if len(bounds) * inner <= 8 << 20 else (lambda x: x)
        dealt = dealt.join(hint(cuts), "bucket").withColumn("bucket", F.col("bucket") * MAX_BUCKETS + _below(F.col("cuts"), inner)).drop("cuts")
    by_bucket = W.orderBy("bucket")  # one row for each bucket
    above = F.coalesce(F.lead("bucket").over(by_bucket), F.min("bucket").over(by_bucket.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = common.written(dealt.groupBy("bucket").agg(F.max("k").alias("head")).select("bucket", "head", above.alias("above")), "minhash-heads")
    hint = F.broadcast if buckets <= MAX_HEADS else (lambda x: x)
    place = lambda b, tail: F.struct(F.col(b).alias("bucket"), F.lit(tail).alias("tail"))
    here, both = F.array(place("bucket", False)), F.array(place("bucket", False), place("above", True))
    placed = dealt.join(hint(heads), "bucket").withColumn("place", F.explode(F.when(F.col("k") == F.col("head"), both).otherwise(here)))
    w = W.partitionBy("place.bucket").orderBy("place.tail", F.desc("k"), F.desc("t"))
    return placed.select(*docs.columns, "place", *(F.lead(c).over(w).alias(f"next_{c}") for c in ["t", *extra])).filter("not place.tail").drop("place")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of the text with its second half replaced by the next document's start.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Nulls: a null text is empty (its fingerprint is empty; two empty ones have likeness 1); rows
    without an id come last.  Ties and repeated rows: rows of one id are ordered by text, descending;
    equal texts have equal fingerprints.  A single row is its own next.  An empty table gives no rows.
    Ids must be integers.
    """
    key = common.column(docs, id_col)
    rows = docs.select(key.alias("doc_id"), F.coalesce(key.cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(common.column(docs, text_col).cast("string"), F.lit("")).alias("t"))
    pairs = with_next(fingerprint(rows, "t", "fp"), ["fp"])
    half = F.floor(F.length("t") / 2).cast("int")
    edited = pairs.select("doc_id", F.length("t").cast("long").alias("n_chars"), "fp", "next_fp", F.concat(F.substr("t", F.lit(1), F.length("t") - half), F.substr("next_t", F.lit(1), half)).alias("e"))
    both = fingerprint(edited, "e", "efp")
    return both.select(
        "doc_id", "n_chars", F.sha2("e", 256).alias("edited_sha256"), rendered(F.col("fp")).alias("fingerprint"), rendered(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.documents(spark, sf_dir))
