"""Temperature mixing of sources, realised as budgeted block permutations.

Shares ``p_s`` of tokens are raised to an exponent and normalised: ``w_s = p_s^a / sum p^a``.
With ``a = 1`` nothing changes; a smaller exponent evens the sources out and repeats the
small ones.  The smallest exponent in [0, 1] that still meets the target (an entropy to
reach at most, a limit on repetitions, or both) is found by bisection over a fixed grid.

Each source then yields draws up to ``w_s * budget`` tokens: pass after pass over all of its
documents, each pass in a new pseudo-random permutation, the last one cut by the budget.  The
draw at a fraction f of its source's budget goes to block ``floor(f * n_blocks)``, so each block
holds every source in its weight; inside a block draws are permuted by a hash.

At scale: running sums are two-level.  Draws are hashed into 4,096 runs per source and pass;
only sums per run are scanned in order, and rows are ordered inside one run only, so a source
with a third of all rows is spread over thousands of window groups.  The driver sees three
numbers per bisection step, never the sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRID = 4096
MAX_REPEATS = 4.0
N_BLOCKS = 64


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))


def exponent(totals: DataFrame, max_repeats: float | None, target_entropy: float | None, budget_share: float = 1.0) -> float:
    """Smallest ``k / 4096`` whose weights respect both targets (1.0 if none does).

    Repetitions and the distance to a uniform mixture both fall as the exponent rises, so
    bisection holds.  ``target_entropy`` is in bits: the mixture's entropy may not exceed it.
    """
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    shares = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def fits(k: int) -> bool:
        a = k / GRID
        z, y, least = shares.agg(F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log2("p")), F.min("p")).first()
        repeats, entropy = budget_share * least ** (a - 1) / z, _entropy(z, y, a)
        return (max_repeats is None or repeats <= max_repeats * (1 + 1e-9)) and (target_entropy is None or entropy <= target_entropy + 1e-9)

    lo, hi = 0, GRID
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo / GRID


def _entropy(z: float, y: float, a: float) -> float:
    return math.log2(z) - a * y / z


def mix(docs: DataFrame, budget: int | None = None, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, n_blocks: int = N_BLOCKS, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per draw: ``doc_id, source, n_tokens, pass_no, start, block, order_key, text_hash``.

    ``n_tokens`` counts words (runs that aren't white space); ``budget`` is in tokens, by
    default all of them.  A draw belongs to the result if it *starts* inside its source's
    budget ``floor(w_s * budget)``, so a source is over it by less than one document.

    Nulls: a null source is a source of its own; a document of null or empty text has no
    tokens and is drawn once per pass that is begun where it falls.  Sources without any token are
    not drawn.  Ties and repeated rows: equal ids in a run are ordered by tokens; each
    row is drawn.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    words = F.regexp_count(common.column(docs, text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    narrow = common.written(
        docs.select(
            common.column(docs, id_col).alias("doc_id"),
            F.xxhash64(common.column(docs, text_col).cast("string")).alias("text_hash"),
            common.column(docs, source_col).alias("source"),
            F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"),
        ),
        "mix-docs",
    )
    return _draws(spark, narrow, budget, max_repeats, target_entropy, n_blocks, seed)


def _draws(spark: SparkSession, narrow: DataFrame, budget: int | None, max_repeats: float | None, target_entropy: float | None, n_blocks: int, seed: int) -> DataFrame:
    totals = common.written(source_totals(narrow), "mix-totals")
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(totals, max_repeats, target_entropy, budget / total if total else 1.0)
    z = totals.filter("tokens > 0").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)))).first()[0] or 1.0
    weight = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z)
    plan = totals.filter("tokens > 0").select(
        F.col("source").alias("s"),
        F.floor(weight * F.lit(float(budget)) + F.lit(1e-6)).cast("long").alias("quota"),
        F.col("tokens").alias("per_pass"),
    )
    # a pass is begun while its start lies inside the quota
    passes = plan.withColumn("passes", F.ceil(F.col("quota") / F.col("per_pass")).cast("int"))
    copies = narrow.join(passes, narrow.source.eqNullSafe(passes.s)).filter("passes > 0").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pass_no").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    keyed = copies.withColumn("order_key", key).withColumn("run", F.substring("order_key", 1, 3))
    sums = keyed.groupBy("source", "pass_no", "run").agg(F.sum("n_tokens").alias("in_run"))
    ordered = W.partitionBy("source", "pass_no").orderBy("run")
    offsets = sums.withColumn("before", F.sum("in_run").over(ordered.rowsBetween(W.unboundedPreceding, -1)))
    offsets = offsets.select(F.col("source").alias("o_source"), F.col("pass_no").alias("o_pass"), F.col("run").alias("o_run"), F.coalesce("before", F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "pass_no", "run").orderBy("order_key", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    started = placed.join(offsets, placed.source.eqNullSafe(offsets.o_source) & (placed.pass_no == offsets.o_pass) & (placed.run == offsets.o_run)).withColumn("start", F.col("pass_no") * F.col("per_pass") + F.col("before") + F.col("inside"))
    block = F.floor(F.col("start") * F.lit(n_blocks) / F.col("quota")).cast("int")
    return started.filter("start < quota").select("doc_id", "source", "n_tokens", "pass_no", "start", block.alias("block"), "order_key", "text_hash")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, once for each of their draws."""
    kid, kh, times, once, name = (common.unused(n, docs) for n in ("_kept_id", "_kept_hash", "_times", "_time", "_row_hash"))
    draws = mix(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(kid), F.col("text_hash").alias(kh))
    counts = draws.groupBy(kid, kh).agg(F.count("*").cast("int").alias(times))
    hashed = docs.withColumn(name, F.xxhash64(common.column(docs, text_col).cast("string"))).dropDuplicates([id_col, name])
    on = common.column(hashed, id_col).eqNullSafe(counts[kid]) & (hashed[name] == counts[kh])
    rows = hashed.join(counts, on).withColumn(once, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.drop(kid, kh, times, once, name)


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's source mixed to at most four repetitions, over a budget of all tokens."""
    return mix(common.documents(spark, sf_dir)).drop("text_hash")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
b AS (SELECT sum(tokens)::BIGINT AS total FROM s),
p AS (SELECT source, tokens, tokens / total::DOUBLE AS p FROM s, b),
bisect AS (
  SELECT 0 AS lo, 4096 AS hi
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid,
      (SELECT power(min(p), (lo + hi) // 2 / 4096.0::DOUBLE - 1) / sum(power(p, (lo + hi) // 2 / 4096.0::DOUBLE)) FROM p) <= 4.0 * (1 + 1e-9) AS ok
    FROM bisect WHERE lo < hi)),
a AS (SELECT min(lo) / 4096.0::DOUBLE AS a FROM bisect WHERE lo = hi),
z AS (SELECT sum(power(p, a)) AS z FROM p, a),
q AS (SELECT source, tokens, floor(power(p, a) / z * total::DOUBLE + 1e-6)::BIGINT AS quota FROM p, a, z, b),
c AS (SELECT d.doc_id, d.source, d.n_tokens, q.tokens, q.quota, unnest(range(ceil(quota / tokens::DOUBLE)::BIGINT))::INT AS pass_no
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, md5('7|' || pass_no || '|' || coalesce(doc_id::VARCHAR, 'null')) AS order_key FROM c),
r AS (SELECT *, pass_no * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, pass_no ORDER BY order_key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
SELECT doc_id, source, n_tokens, pass_no, start::BIGINT AS start, floor(start * 64 / quota::DOUBLE)::INT AS block, order_key FROM r WHERE start < quota
"""
