"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of orders 0 to 3 is counted on labelled text, with escape
probabilities by method C: in a context with n symbols, d of them distinct, a seen symbol has
``c / (n + d)`` and the escape to the shorter context ``d / (n + d)``; below order 0 all 256 bytes are
alike.  The statistics are then frozen, so the code length of a byte depends on the three before
it alone, and all languages' trees are flattened into one table (context, byte) -> code lengths, as 32-bit floats:
every context that was seen has a row, nothing is pruned or cut.  A text begins after three line feeds.
A text's language is the one with the shortest code; the score is its posterior probability.

Learning uses a bounded sample of rows: about ``SAMPLE_DOCS`` labelled rows a language, chosen by a hash
of their id, whole texts of each.  Executors count; the driver sees counts of distinct four-byte
strings.  The table is broadcast, so a model of more than ``MAX_TABLE`` bytes is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 500
#: labels that a model takes at most; more is an error, as the table would grow with them
MAX_LANGUAGES = 256
#: bytes of the table of code lengths, which every worker holds
MAX_TABLE = 256 << 20
START = b"\n\n\n"
SLICE = 1 << 19

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, 0: not seen in learning
    row: np.ndarray  # code of three symbols -> row of the table
    cost: np.ndarray  # (row * symbols + symbol, language) -> code length in bits

    @property
    def size(self) -> int:
        return int(self.symbol.max()) + 1


def _lengths(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths in bits of every (context, symbol), given those of the shorter context."""
    n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen, escape = np.log2((n + d) / counts), np.log2((n + d) / d)
    return np.where(counts > 0, seen, np.where(n > 0, escape, 0) + shorter)


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct four-byte strings of a text after ``START``, as integers, and their counts."""
    x = np.frombuffer(START + text, np.uint8).astype(np.int64)
    return np.unique(((x[:-3] * 256 + x[1:-2]) * 256 + x[2:-1]) * 256 + x[3:], return_counts=True)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """A model from each language's four-byte strings and their counts."""
    languages = sorted(counts)
    held = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in counts.values())]))
    used = np.unique(np.concatenate([[START[0]], *(held >> shift & 255 for shift in (0, 8, 16, 24))]))
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(1, len(used) + 1)
    a = len(used) + 1
    recoded = lambda g: ((symbol[g >> 24] * a + symbol[g >> 16 & 255]) * a + symbol[g >> 8 & 255]) * a + symbol[g & 255]
    kept = np.unique(recoded(held) // a)
    if (size := 4 * (a * a + len(kept)) * a * len(languages)) > MAX_TABLE:
        raise ValueError(f"a table of {size} bytes is too large to broadcast: fewer languages or sample rows are needed")
    row = np.tile(np.arange(a * a, dtype=np.int32), a)  # of order 2, by the last two symbols
    row[kept] = a * a + np.arange(len(kept), dtype=np.int32)
    cost = np.empty(((a * a + len(kept)) * a, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        codes, n = recoded(counts[lang][0]), counts[lang][1]
        bits = np.full((1, a), 8.0)
        for k in (1, 2, 3):
            seen = np.bincount(codes % a**k, n, a**k).reshape(-1, a)
            bits = _lengths(seen, bits if k == 1 else np.tile(bits, (a, 1))[: len(seen)])
        top = np.zeros((len(kept), a))
        np.add.at(top, (np.searchsorted(kept, codes // a), codes % a), n)
        top = _lengths(top, bits[kept % (a * a)]) if len(kept) else top
        cost[:, j] = np.concatenate([bits, top]).ravel()
    return Model(languages, symbol, row, cost)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages) code lengths in bits, in slices of bounded memory."""
    sizes = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), len(model.languages)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    a, line = model.size, int(model.symbol[10])
    for lo in range(0, len(data), SLICE):
        hi = min(lo + SLICE, len(data))
        pad = max(0, 3 - lo)
        s = np.concatenate([np.full(pad, line), model.symbol[data[max(0, lo - 3) : hi]]])
        first, last = np.searchsorted(starts + sizes, lo, "right"), np.searchsorted(starts, hi, "left")
        before = [s[2:-1].copy(), s[1:-2].copy(), s[:-3].copy()]
        mine = np.arange(first, last)
        for k, x in enumerate(before, 1):  # nothing of the text before counts as context
            for d in range(k):
                at = starts[mine] + d - lo
                x[at[(at >= 0) & (at < hi - lo)]] = line
        rows = model.row[(before[2] * a + before[1]) * a + before[0]].astype(np.int64)
        bits = model.cost[rows * a + s[3:]]
        mine = mine[sizes[mine] > 0]
        out[mine] += np.add.reduceat(bits, np.maximum(starts[mine] - lo, 0), axis=0, dtype=np.float64)
    return out


def posterior(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = bits.argmin(1)
    return best, 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            g, n = grams(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["l", "g", "n"])


def learn(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows for which ``trainable`` holds and text and label aren't null.

    Repeated rows count each time if their id is chosen; null ids are chosen or not together.  Without any such row the model knows no language.
    """
    rows = docs.filter(trainable).select(common.column(docs, id_col).alias("k"), common.column(docs, text_col).cast("string").alias("t"), common.column(docs, lang_col).cast("string").alias("l")).filter("t is not null and l is not null")
    counts = dict(map(tuple, rows.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()))
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    share = F.when(F.lit(False), F.lit(0.0))
    for lang, n in counts.items():
        share = share.when(F.col("l") == lang, F.lit(min(1.0, SAMPLE_DOCS / n)))
    place = F.pmod(F.xxhash64("k", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    common.small_batches(docs)
    sample = common.mapped(rows.filter(place < share).select("l", "t"), _counted, "l string, g bigint, n bigint")
    found = sample.groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    lang, g, n = found.column("l").to_pylist(), found.column("g").to_numpy(), found.column("n").to_numpy()
    at: dict[str, list[int]] = {x: [] for x in counts}
    for i, x in enumerate(lang):
        at[x].append(i)
    return fit({x: (g[i], n[i]) for x, i in at.items() if i})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every row.

    Nulls: a null text, or one without letters, is ``und`` with score 0 and null bits per byte; so is every
    text if nothing was learnt.  Ties go to the smaller label.  Repeated rows each give a row; a
    null id is passed on.  An empty table gives no rows.
    """
    common.small_batches(docs)
    key = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lettered = [bool(m.languages and t and _LETTER.search(t)) for t in texts]
            raw = [t.encode() if ok else b"" for t, ok in zip(texts, lettered)]
            bits = code_lengths(m, raw) if m.languages else np.zeros((len(raw), 1))
            best, score = posterior(bits) if len(raw) else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([m.languages[b] if ok else "und" for b, ok in zip(best, lettered)], pa.string()),
                    pa.array([float(s) if ok else 0.0 for s, ok in zip(score, lettered)], pa.float64()),
                    pa.array([float(x.min()) / len(r) if ok else None for x, r, ok in zip(bits, raw, lettered)], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    rows = docs.select(common.column(docs, id_col).alias("doc_id"), common.column(docs, text_col).cast("string").alias("text"))
    return common.mapped(rows, run, f"doc_id {key}, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.5, max_bits: float = 6.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told.

    Rejected are texts that are null or without letters, that score under ``min_score``, or that the best
    language needs more than ``max_bits`` bits a byte for (nothing like what was learnt).
    """
    common.small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names may hold dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            raw = [t.encode() if m.languages and t and _LETTER.search(t) else b"" for t in texts]
            bits = code_lengths(m, raw) if m.languages else np.zeros((len(raw), 1))
            _, score = posterior(bits)
            sizes = np.array([len(r) for r in raw])
            yield batch.filter(pa.array((sizes > 0) & (score >= min_score) & (bits.min(1) <= max_bits * sizes)))

    return common.mapped(plain, run, plain.schema).toDF(*names)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def op10_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = identify(docs, learn(docs, ~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
