"""Benchmark decontamination as a prefix-filtered set join.  DataFrame functions only.

An item's windows are its runs of ``window`` words (an item of fewer words is one window).  A
window is contained in a document only if all of its tokens are, so its necessary prefix in
the global order by rarity is one token: the rarest.  Token frequencies are counted over all
documents (for the benchmark's vocabulary).  Document positions that hold some window's
prefix token become candidates; the positional bound (the window must lie inside the document
at the offset of its token) and the length bound come next, and the words are then compared.

At scale: while the windows take at most ``MAX_BROADCAST`` bytes they are broadcast, and documents are scanned without
being shuffled.  Beyond it tokens are counted before they meet the vocabulary, narrow rows (document, position,
token, hash of the next token) meet the prefixes by token, and candidates meet their document's words once
to be compared: all of it grows with the documents' words and the candidates, no matter how long a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: bytes of windows, as Spark holds them, up to which they are broadcast
MAX_BROADCAST = 64 << 20
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case: digits, a-z and whatever isn't ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD), "")


def windows(items: DataFrame, window: int) -> DataFrame:
    """Every item's windows, ``(item, win)``."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(n - F.lit(window) + 1, F.lit(1)))
    runs = items.filter(n > 0).select("item", F.explode(starts).alias("at"), "w")
    return runs.select("item", F.expr(f"slice(w, at, {window})").alias("win")).distinct()


def prefix_table(docs: DataFrame, wins: DataFrame, small: bool) -> DataFrame:
    """``token, offset, next, win, id`` by the rarest token of each window ``(id, win)``; ``next`` is a hash of the token behind it.

    Windows with a token that no document has are left out.
    """
    vocabulary = wins.select(F.explode("win").alias("token")).distinct()
    tokens = docs.select(F.explode("w").alias("token"))
    if small:
        counts = tokens.join(F.broadcast(vocabulary), "token").groupBy("token").count()
    else:
        counts = tokens.groupBy("token").count().join(vocabulary, "token")
    placed = wins.select("id", F.posexplode("win").alias("offset", "token")).join(counts, "token", "left")
    rarest = placed.groupBy("id").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "offset")).alias("r"))
    after = F.get("win", F.col("r.offset") + 1)
    table = wins.join(rarest.filter("r.n > 0"), "id").select(F.col("r.token").alias("token"), F.col("r.offset").alias("offset"), F.when(after.isNotNull(), F.xxhash64(after)).alias("next"), "win", "id")
    return common.written(table, "decontam-prefix")


def _scanned(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Occurrences ``(doc_id, th, start, len, id)`` with the windows broadcast."""
    at = F.col("pos") - F.col("offset")
    words_ = rows.select("doc_id", "th", "w", F.posexplode("w").alias("pos", "token"))
    inside = words_.join(F.broadcast(table), "token").filter((at >= 0) & (at + F.size("win") <= F.size("w")))
    return inside.filter(F.slice("w", at + 1, F.size("win")) == F.col("win")).select("doc_id", "th", at.alias("start"), F.size("win").alias("len"), "id")


def _shuffled(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The same with windows and words meeting by token."""
    at = F.col("pos") - F.col("offset")
    pairs = F.transform("w", lambda x, i: F.struct(x.alias("token"), F.xxhash64(F.get("w", i + 1)).alias("behind")))
    narrow = rows.select("doc_id", "th", F.size("w").alias("n"), F.posexplode(pairs).alias("pos", "x")).select("doc_id", "th", "n", "pos", "x.token", "x.behind")
    near = narrow.join(table, "token").filter((at >= 0) & (at + F.size("win") <= F.col("n")) & (F.col("next").isNull() | (F.col("next") == F.col("behind"))))
    asked = near.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.collect_set(F.struct(at.alias("start"), F.size("win").alias("len"), "id", "win")).alias("asked"))
    met = rows.dropDuplicates(["doc_id", "th"]).join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")))
    held = F.filter("asked", lambda x: F.slice(F.col("w"), x["start"] + 1, x["len"]) == x["win"])
    return met.select("doc_id", "th", F.explode(held).alias("x")).select("doc_id", "th", "x.start", "x.len", "x.id")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str, max_broadcast: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``(doc_id, th, w)``, occurrences of windows in them, and the items of each window ``(id, item)``."""
    text = common.column(docs, text_col).cast("string")
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("th"), words(text).alias("w"))
    items = benchmark.select(common.column(benchmark, item_col).cast("string").alias("item"), words(common.column(benchmark, item_text_col).cast("string")).alias("w"))
    owned = common.written(windows(items, window), "decontam-windows")
    wins = common.written(owned.select("win").distinct().withColumn("id", F.monotonically_increasing_id()), "decontam-ids")
    # 16 bytes and the rounded-up string for each word, and what a row and its place in a hash table take
    size = wins.agg(F.sum(F.aggregate("win", F.lit(128).cast("long"), lambda n, x: n + F.octet_length(x) + 24))).first()[0] or 0
    small = size <= max_broadcast
    table = prefix_table(rows, wins, small)
    return rows, (_scanned if small else _shuffled)(rows, table), owned.join(wins, "win").select("id", "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items, spans``.

    ``spans`` are the (start, len) word spans of all window occurrences, sorted; ``n_hit`` counts the
    words that any of them covers; ``items`` are the ids of items with an occurring window, sorted as
    strings.

    Nulls: a null text has no words; an item without words has no window; a null item id isn't listed.
    Ties: among equally rare tokens the smaller one is the prefix, which changes no result.
    Repeated rows each give a row; empty tables give no rows or no hits.
    """
    rows, hits, owners = _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col, max_broadcast)
    hits = common.written(hits, "decontam-hits")
    spans = hits.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"))
    named = hits.select("doc_id", "th", "id").distinct().join(owners, "id").groupBy(F.col("doc_id").alias("nd"), F.col("th").alias("nt")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    found = spans.withColumn("n_hit", covered).join(named, F.col("d").eqNullSafe(F.col("nd")) & (F.col("t") == F.col("nt")), "left")
    return (
        rows.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
        .join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
        )
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of any item occurs.

    Nulls: a null text has no words and stays, as do rows without an id.  Rows repeated whole stay or go together; equal texts of
    different ids are judged alike.  An empty benchmark or table takes nothing away.
    """
    _, hits, _ = _hits(docs, benchmark, window, id_col, text_col, item_col, item_text_col, max_broadcast)
    keys = common.written(hits.select(F.col("doc_id").alias("_kept_id"), F.col("th").alias("_kept_hash")).distinct(), "decontam-hit")
    return common.semi(docs, keys, id_col, text_col, anti=True)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.greatest("n_items", F.lit(0)).alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item, n, array_to_string(w[pos : pos + n - 1], ' ') AS win FROM s),
p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.pos, p.n, x.item FROM p JOIN x ON x.n = p.n AND array_to_string(p.w[p.pos : p.pos + p.n - 1], ' ') = x.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS pos FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)
"""
