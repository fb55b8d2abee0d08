"""SimHash near-duplicates with a generalised pigeonhole index.

A text's fingerprint has bit b set if it is set in over half of its shingles' XXH64 hashes.
Fingerprints at ``radius`` or fewer differing bits are linked.  The 64 bits are dealt into m parts,
correlated bits together; part i gets a threshold t_i, with ``sum(t_i + 1) = radius + 1``, so any
linked pair is within its threshold in some part.  m and the thresholds come from dynamic programming
over estimated costs (a bounded sample of fingerprints, ``PLAN_SAMPLE``; it decides speed, not results).

A part of threshold 0 is probed by its value, one of threshold 1 by its value and by the values
with one set bit cleared (of two values a bit apart, the one that has the bit probes the other).
Within a bucket candidates are verified and only a spanning star of the links is emitted, never all
pairs.  A bucket over ``CAP`` fingerprints is dealt again by blocks of all bits, of which any linked pair
shares one, and again by other blocks while it is over the cap, up to ``SPLITS`` times; no link is lost.

Only distinct fingerprints are searched; documents meet them again in a join.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
PLAN_SAMPLE = 2000
CAP = 1 << 15
SPLITS = 4  # times that a bucket over the cap is dealt again
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PAIRS = 1 << 21  # candidates that are verified at once
BLOCK = 1 << 20  # shingles in a block of a bucket's texts; two blocks meet in a task


def text_fingerprint(text: bytes, shingle: int = SHINGLE, distinct: bool = False) -> int:
    """Lower-cases A-Z; no word at all: 0.  ``distinct`` counts each shingle once."""
    import xxhash

    w = _WORD.findall(text.lower())
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    grams = set(grams) if distinct else grams
    h = np.array([digest(g, SEED) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """``doc_id, text_hash, fp`` (a signed long with the 64 bits) of every row."""
    common.small_batches(docs)
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([text_fingerprint(t.encode() if t else b"", shingle, distinct) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    text = common.column(docs, text_col).cast("string")
    rows = docs.select(common.column(docs, id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return common.mapped(rows, run, f"doc_id {key}, text_hash bigint, fp bigint")


# -- the plan ------------------------------------------------------------------------------


def grouped_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m parts of nearly equal size; each part grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.abs(np.nan_to_num(np.corrcoef(bits.T))) if len(bits) > 1 else np.zeros((64, 64))
    left, parts = set(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        part = [min(left)]
        left.discard(part[0])
        while len(part) < size:
            best = max(sorted(left), key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def _part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def plan(sample: np.ndarray, n: int, radius: int) -> list[tuple[list[int], int]]:
    """Parts with thresholds 0 or 1, or -1 for a part that isn't probed, of the least estimated cost.

    The cost of a choice is n times its probes plus its candidate pairs; candidates are estimated from the
    sample's pairs within the threshold in the part, and from uniform bits where the sample has none.
    """
    best = None
    for m in range((radius + 2) // 2, radius + 2):
        parts = grouped_bits(sample, m)
        cost = []
        for part in parts:
            v = _part_values(sample, part)
            _, c = np.unique(v, return_counts=True)
            pairs = max(1, len(v) * (len(v) - 1) / 2)
            same = max(float((c * (c - 1) / 2).sum()) / pairs, 2.0 ** -len(part))
            near = max(same, min(1.0, same * (1 + len(part))))
            total = n * n / 2.0
            cost.append({-1: 0.0, 0: 16.0 * n + same * total, 1: 16.0 * n * (1 + len(part) / 2) + near * total})
        table = {0: (0.0, [])}  # units spent -> (cost, thresholds); all parts must spend radius + 1
        for c in cost:
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (total, chosen) in table.items():
                for t in (-1, 0, 1):
                    s = spent + t + 1
                    new = (total + c[t], [*chosen, t])
                    if s <= radius + 1 and (s not in after or new < after[s]):
                        after[s] = new
            table = after
        if radius + 1 in table and (best is None or table[radius + 1][0] < best[0]):
            best = (table[radius + 1][0], list(zip(parts, table[radius + 1][1])))
    return best[1]


# -- probing and verification -------------------------------------------------------------


def probes(fps: np.ndarray, chosen: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, fingerprint, whether it is the bucket's own value) rows."""
    for k, (part, t) in enumerate(chosen):
        if t < 0:
            continue
        v = _part_values(fps, part)
        yield _bucket(v, k), fps, np.ones(len(fps), bool)
        for i in range(len(part)) if t else ():
            has = (v >> np.uint64(i)) & np.uint64(1) == 1
            yield _bucket(v[has] ^ np.uint64(1 << i), k), fps[has], np.zeros(int(has.sum()), bool)


def _bucket(values: np.ndarray, part: int) -> np.ndarray:
    """A part's value and number mixed to 64 bits without loss (parts of up to 60 bits)."""
    x = (values << np.uint64(4)) | np.uint64(part)
    return x * np.uint64(0x9E3779B97F4A7C15)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to one star for each component."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def links_in_buckets(buckets: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links within each bucket; pairs of two probing fingerprints aren't compared."""
    order = np.lexsort((fps, ~own, buckets))
    buckets, fps, own = buckets[order], fps[order], own[order]
    edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, int)
    ends = np.append(edge[1:], len(buckets))
    n_own = np.add.reduceat(own.astype(np.int64), edge) if len(edge) else edge
    sizes = ends - edge
    work = n_own * sizes
    small = (sizes > 1) & (n_own > 0) & (work <= PAIRS)
    lo, hi, k = edge[small], ends[small], n_own[small]
    done = np.cumsum(work[small])
    at = 0
    while at < len(lo):  # as many small buckets as fit, all their pairs at once
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, "right")))
        first = np.repeat(lo[at:to], k[at:to])
        i = first + _ramp(k[at:to])
        n = np.repeat(hi[at:to], k[at:to]) - i - 1
        left, right = np.repeat(i, n), np.repeat(i + 1, n) + _ramp(n)
        near = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        left, right = fps[left[near]], fps[right[near]]
        yield stars(left, right)
        at = to
    for j in np.flatnonzero((sizes > 1) & (n_own > 0) & (work > PAIRS)):
        yield _walk(fps[edge[j] : ends[j]], int(n_own[j]), radius)


def _ramp(n: np.ndarray) -> np.ndarray:
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n)


def _walk(fps: np.ndarray, n_own: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first over one bucket, a few nodes against all that aren't reached yet."""
    left = np.ones(len(fps), bool)
    out_u, out_v = [], []
    for start in range(n_own):
        if not left[start]:
            continue
        left[start], frontier = False, [start]
        while frontier:
            now = np.array(frontier[-64:])
            del frontier[-64:]
            open_ = np.flatnonzero(left)
            near = np.bitwise_count(fps[now][:, None] ^ fps[open_][None, :]) <= radius
            near &= (now < n_own)[:, None] | (open_ < n_own)[None, :]
            got = open_[near.any(0)]
            left[got] = False
            frontier += got.tolist()
            out_u.append(fps[got])
            out_v.append(np.full(len(got), fps[start]))
    return (np.concatenate(out_u), np.concatenate(out_v)) if out_u else (fps[:0], fps[:0])


#: probes that are compared at once, whole buckets
LOT = 1 << 18


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``(u, v)`` within the buckets of ``(bucket, fp, own)``; all rows of a bucket in one task, a lot of buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in common.whole_groups(batches, LOT):
            b, f, o = (lot.column(i).to_numpy() for i in range(3))
            found = list(links_in_buckets(b, f.view(np.uint64), o, radius))
            u, v = stars(*(np.concatenate([np.zeros(0, np.uint64), *(x[i] for x in found)]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return common.mapped(rows.repartition("bucket").sortWithinPartitions("bucket"), run, "u bigint, v bigint")


def _split(rows: DataFrame, radius: int, depth: int) -> DataFrame:
    """Large buckets, dealt again.

    A pair differs in at most ``radius`` bits, so of any ``radius + 1`` blocks of the 64 bits it agrees in one: the bucket is dealt
    again by (block, block value), with other blocks at every ``depth``.  Probing fingerprints go along.
    """
    bits = np.random.default_rng(depth).permutation(64) if depth else np.arange(64)
    blocks = [[int(x) for x in block] for block in np.array_split(bits, radius + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, fps, own = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)
            for k, block in enumerate(blocks):
                new = (old ^ _bucket(_part_values(fps, block), k)) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), b.column(1), pa.array(own)], names=["bucket", "fp", "own"])

    return common.mapped(rows, run, "bucket bigint, fp bigint, own boolean")


def links(fps: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """Spanning links ``(u, v)`` of all distinct fingerprints ``fp`` within ``radius`` bits."""
    n = fps.count()
    rate = min(1.0, PLAN_SAMPLE / max(1, n))
    held = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) <= F.lit(int(rate * (1 << 30)))).limit(2 * PLAN_SAMPLE).collect()
    chosen = plan(np.array([r["fp"] for r in held], np.int64).view(np.uint64), n, radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, fp, own in probes(b.column(0).to_numpy().view(np.uint64), chosen):
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(own)], names=["bucket", "fp", "own"])

    rows = common.mapped(fps.select("fp"), run, "bucket bigint, fp bigint, own boolean")
    found = []
    for depth in range(SPLITS + 1):
        large = common.written(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > cap).select("bucket"), "simhash-large")
        if depth == SPLITS or large.isEmpty():  # what is still large then is compared as it is
            found.append(_links(rows, radius))
            break
        # the buckets over the cap: few, as each holds more than cap fingerprints
        found.append(_links(rows.join(large, "bucket", "left_anti"), radius))
        rows = common.written(_split(rows.join(large, "bucket", "left_semi"), radius, depth), "simhash-split")
    return functools.reduce(DataFrame.unionByName, found)


def _roots(rows: DataFrame, radius: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """``(fp, least, root)`` of every distinct fingerprint of ``rows``; ``least`` is its first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    distinct = common.written(rows.groupBy("fp").agg(first.alias("least")), "simhash-distinct")
    found = components(links(distinct, radius, cap))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; the component's id is its smallest document id.

    Nulls: a null or empty text, or one of white space, has fingerprint zero, linked like any other; null
    ids are never a component's id unless it has no other.  Ties and repeated rows: equal fingerprints
    are in one component; each row is returned.  An empty table gives no rows.
    """
    rows = common.written(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    roots = _roots(rows, radius, cap)
    named = roots.groupBy("root").agg(F.min("least").alias("first"))
    member = common.written(roots.join(named, "root").select(F.col("fp").alias("f"), F.col("first.doc_id").alias("component_id")), "simhash-member")
    return rows.join(member, rows.fp == member.f).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``words`` words; a shorter text is one run, none gives an empty set."""
    import xxhash

    w = _WORD.findall(text.lower())
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)] if w else []
    return np.array(sorted({xxhash.xxh64_intdigest(x) for x in runs}), np.uint64)


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """``(root, h, fp, key, set, mh)``: the shingle set and its least hash by each of several orders (0 for an empty set)."""
    odd = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF) for k in range(hashes)]
    for batch in batches:
        sets = [shingle_set((t or "").encode(), words) for t in batch.column("t").to_pylist()]
        least = [[int((x * o ^ (x * o) >> np.uint64(29)).min().view(np.int64)) if len(x) else 0 for o in odd] for x in sets]
        cols = [*(batch.column(c) for c in ("root", "h", "fp", "key")), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["root", "h", "fp", "key", "set", "mh"])


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Jaccard similarity of two sets is at least ``similarity``; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    return shared >= F.lit(similarity) * (F.size(a) + F.size(b) - shared) - F.lit(1e-9)


def later_copies(sets: list[np.ndarray], sides: list[int], similarity: float) -> list[int]:
    """Numbers of the sets that are similar to an earlier one, of another side if there are two.

    Similar sets share one of each one's first ``n - ceil(similarity n) + 1`` shingles, rarest first, so only sets that do are compared.
    """
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ends = np.cumsum([len(x) for x in sets])
    ranked = [np.sort(x) for x in np.split(rank[at], ends[:-1])]
    two, index, empty, out = len(set(sides)) > 1, {}, [], []
    for no, x in enumerate(ranked):
        n = len(x)
        prefix = x[: n - max(1, math.ceil(similarity * n - 1e-9)) + 1].tolist()
        tried, found = set(), any(not two or sides[o] != sides[no] for o in empty) if n == 0 else False
        for token in prefix if not found else ():
            for o in index.get(token, ()):
                if o in tried or two and sides[o] == sides[no]:
                    continue
                tried.add(o)
                size = len(ranked[o])
                if min(n, size) >= similarity * max(n, size) - 1e-9:
                    shared = len(np.intersect1d(x, ranked[o], assume_unique=True))
                    if found := shared >= similarity * (n + size - shared) - 1e-9:
                        break
            if found:
                break
        if found:
            out.append(no)
        if n == 0:
            empty.append(no)
        for token in prefix:
            index.setdefault(token, []).append(no)
    return out


def _rest(left: DataFrame, similarity: float, block: int) -> DataFrame:
    """``(h, fp)`` of texts that are similar to an earlier one with which they share a MinHash; all such pairs are compared.

    A bucket of more than ``block`` shingles is dealt by pairs of blocks of its texts.
    """
    spots = left.select("root", "h", "fp", F.size("set").alias("size"), F.posexplode("mh").alias("k", "m"))
    blocks = F.greatest(F.lit(1), F.ceil(F.sum("size") / block)).cast("int")
    shared = spots.groupBy("root", "k", "m").agg(F.count("*").alias("n"), blocks.alias("blocks")).filter("n > 1").drop("n")
    side = F.pmod(F.xxhash64("h", "fp"), F.col("blocks")).cast("int")
    dealt = spots.join(shared, ["root", "k", "m"]).select("h", "fp", "k", "m", side.alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    place = ["root", "k", "m", "lo", "hi"]
    rows = dealt.select("h", "fp", "k", "m", "side", F.least("side", "o").alias("lo"), F.greatest("side", "o").alias("hi")).join(left.select("root", "h", "fp", "key", "set"), ["h", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled() -> pa.RecordBatch:
            gone = later_copies([x[1] for x in held], [x[0] for x in held], similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[i][c] for i in gone], pa.int64()) for c in (2, 3)], names=["h", "fp"])

        now, held = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*place, "side", "h", "fp")]
            sets = batch.column("set")
            for i, row in enumerate(zip(*cols)):
                if row[:5] != now:
                    yield settled()
                    now, held = row[:5], []
                held.append((row[5], sets[i].values.to_numpy(), *row[6:]))
        yield settled()

    return common.mapped(rows.repartition(*place).sortWithinPartitions(*place, "key").select(*place, "side", "h", "fp", "set"), run, "h bigint, fp bigint").distinct()


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 9, hashes: int = 6, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, without near copies: texts whose sets of ``words``-word shingles have Jaccard ``similarity``.

    SimHash proposes, exact sets decide.  Fingerprints of the set of single words are linked at ``radius``
    bits (the README says how many pairs are), components of the links are candidates.  Of a component's texts that share the first
    MinHash of their shingles, those similar to the one of the smallest id go; this settles most copies of large groups.  Of those left all that
    share any of ``hashes`` MinHashes are compared with each other, and the later of two similar ones goes.  A similar pair
    shares one of them but with probability ``(1 - similarity) ** hashes``, so six miss one candidate in 15,000; no
    group's pairs are emitted.

    Nulls: rows without an id are kept only if no copy has an id; text null counts as empty.  Equal texts are
    copies.  Rows repeated whole are kept once.  An empty table gives no rows.
    """
    rows = common.written(fingerprints(docs, 1, id_col, text_col, True), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    texts = common.written(rows.groupBy("text_hash", "fp").agg(first.alias("least")), "simhash-texts")
    found = components(links(common.written(texts.select("fp").distinct(), "simhash-distinct"), radius, cap))
    member = texts.join(found, texts.fp == found.node, "left").select("text_hash", "fp", "least", F.coalesce("root", "fp").alias("root"))
    several = member.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    near = member.join(several, "root", "left_semi").select("root", "fp", F.col("least").alias("l"), F.col("text_hash").alias("h"))
    text = common.column(docs, text_col).cast("string")
    body = docs.select(common.column(docs, id_col).alias("k"), F.xxhash64(text).alias("th"), text.alias("t"))
    sets = near.join(body, body.k.eqNullSafe(F.col("l.doc_id")) & (body.th == near.h)).dropDuplicates(["h", "fp"]).select("root", "h", "fp", F.struct("l.none", "l.doc_id", "h", "fp").alias("key"), "t")
    kind = sets.schema["key"].dataType.simpleString()
    left = common.written(common.mapped(sets, lambda it: _shingle_sets(it, words, hashes), f"root bigint, h bigint, fp bigint, key {kind}, set array<bigint>, mh array<bigint>"), "simhash-sets")
    at = left.withColumn("m", F.get("mh", F.lit(0)))
    leads = at.groupBy("root", "m").agg(F.min("key").alias("lead"), F.min_by("set", "key").alias("lead_set"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = common.written(at.join(leads, ["root", "m"]).filter((F.col("key") > F.col("lead")) & similar(F.col("set"), F.col("lead_set"), similarity)).select("h", "fp"), "simhash-copies")
    others = common.written(_rest(left.join(copies, ["h", "fp"], "left_anti"), similarity, block), "simhash-copies")
    removed = copies.unionByName(others).select(F.col("h").alias("text_hash"), "fp")
    kept = common.written(texts.join(removed, ["text_hash", "fp"], "left_anti").select("least.doc_id", "text_hash"), "simhash-kept")
    return common.semi(docs, kept, id_col, text_col, once=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
