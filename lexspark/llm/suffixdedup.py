"""Exact removal of repeated 100-byte strings by suffix sorting with bucket pointers.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a smaller
document, or in the same one before).  Sorting every suffix of a corpus over a network would move
many times its size, so suffixes are sorted only where an earlier copy is possible and not yet certain:

1. *Anchors.*  In every window of LENGTH bytes the q-gram with the least hash is an anchor, so equal
   windows have equal anchors; about one byte in 35 is one.  An anchor's context is all that the windows
   choosing it can cover.  Of anchors with one q-gram and one context all but the earliest are
   copies in full: their contexts are removed.  This is settled inside map tasks first.  Here strings are told
   by hashes: 64 bits of the q-gram, and among those of one q-gram 64 bits of the context.
2. *Edges.*  What is left in q-gram groups with several contexts: the first of each context.  Their bytes meet by
   q-gram, in lots of bounded size, and a lot's suffixes are sorted.  Equal windows have their anchor at one place, so a window
   meets only those that begin as far before theirs.  The suffixes from the anchors on are sorted by words of eight bytes:
   buckets of equal words are refined by sorting on the pointer at a later word to the bucket there.  Only unresolved buckets
   are refined, a few at a time, and their parts' names are written at once, so those refined after them sort by the newer
   names.  Neighbours in that order are compared byte by byte.  Suffixes that begin one byte earlier then need no sort of
   their own: their bucket is that of the suffix one byte on, split by the byte in front, and goes when one is left in it.
   Of equal windows all but the earliest are removed.
3. The intervals of both are united per document.

A q-gram of more than ``CAP`` edges is split by longer strings: the windows of its contexts are dealt into two halves by their
offset, each half under all bytes that its windows have in common, and again if that isn't enough.  Halves of one
window each hold equal strings only, whose earliest is a grouped minimum.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LENGTH = 100
Q = 32
#: edges of a q-gram that are sorted together; more are split by longer strings
CAP = 20_000
#: bytes of contexts that are sorted at once, beyond which a task goes on with the next q-grams
SORTED_BYTES = 2 << 20
#: bytes hashed at once: their arrays stay in a core's cache, and below the size from which each is mapped by itself
_SLICE = 1 << 15

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _SLICE + 1), _powers(_INVERSE, _SLICE + 1)
_PLACES = np.arange(_SLICE, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int = Q) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(q-gram hash, context hash, text number, position in it) of the anchors of joined texts."""
    wide = length - q + 1  # q-grams in a window
    starts = np.concatenate([[0], ends[:-1]])
    step = _SLICE - 4 * length
    for lo in range(0, len(data) - length + 1, step):
        base = max(0, lo - wide + 1)
        piece = data[base : lo + step + 2 * length]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_TABLE[piece] * _UP[: len(piece)], dtype=np.uint64, out=sums[1:])
        grams = sums[q:] - sums[:-q]
        grams *= _DOWN[: len(grams)]
        low = _mixed(grams)
        low &= ~np.uint64(_SLICE - 1)
        low |= _PLACES[: len(low)]
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        stop = min(lo + step, base + len(low))  # windows start from lo on
        whole = np.ones(stop - lo, bool)
        near = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, stop + length, "left")]
        cut = (near[:, None] - np.arange(1, length)).ravel() - lo  # those go on behind a text's end
        whole[cut[(cut >= 0) & (cut < len(whole))]] = False
        at = (low[lo - base : stop - base][whole] & np.uint64(_SLICE - 1)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at  # the least of a later window never stands before that of an earlier one
        text = np.searchsorted(ends, at + base, "right")
        left = np.minimum(wide - 1, at + base - starts[text])
        right = np.minimum(length, ends[text] - at - base)
        context = _mixed((sums[at + right] - sums[at - left]) * _DOWN[at - left] + (left * 1000 + right).astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        yield _mixed(grams[at]), context, text, at + base - starts[text]


_ANCHOR = "h bigint, c bigint, k bigint, pos bigint, sure boolean"
_MARK = "h bigint, k bigint, pos bigint, sure boolean"
_ROWS = 1 << 14


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of narrow rows put together to about ``_ROWS``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if any(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of texts ``(k, base, t)``; a place in a text is ``base`` plus the byte's number."""
    for batch in batches:
        raw = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
        ids, base = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
        got = list(anchors(data, ends)) if len(data) >= LENGTH else []
        if not got:
            continue
        h, c, text, pos = (np.concatenate(x) for x in zip(*got))
        h, c, k, pos = h.view(np.int64), c.view(np.int64), ids[text], pos + base[text]
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        alone = new & np.append(new[1:], True)
        some = order[~alone]  # only q-grams that come again are put in order
        order = np.concatenate([order[alone], some[np.lexsort((pos[some], k[some], c[some], h[some]))]])
        h, c, k, pos = h[order], c[order], k[order], pos[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
        again = np.concatenate([[False], (k[1:] == k[:-1]) & (pos[1:] == pos[:-1])]) & ~new  # a row that is there twice
        h, c, k, pos, sure = h[~again], c[~again], k[~again], pos[~again], ~new[~again]
        # a copy of what this task has seen is settled; it needs no company, so it is dealt at random
        h = np.where(sure, _mixed((k * 31 + pos).view(np.uint64)).view(np.int64), h)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(k), pa.array(pos), pa.array(sure)], names=["h", "c", "k", "pos", "sure"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies and edges of anchors sorted by (h, c, k, pos), and the sure ones among them as they are; of a q-gram that goes on in the next batch one row is held."""
    last: tuple | None = None  # (h, c, k, pos) of the row before
    head: tuple | None = None  # (h, k, pos) of a q-gram's first row, while it has but one context
    for batch in _larger(batches):
        sure = batch.column(4).to_numpy()
        order = np.concatenate([np.flatnonzero(~sure), np.flatnonzero(sure)])
        n = len(sure) - int(sure.sum())
        h, c, k, pos = (batch.column(i).to_numpy()[order] for i in range(4))
        before = last or (0, 0, 0, 0)
        prior = [np.concatenate([[v], x[:-1]]) for v, x in zip(before, (h, c, k, pos))]
        new_h, new_c, same = h != prior[0], c != prior[1], (k == prior[2]) & (pos == prior[3])
        if last is None:
            new_h[0] = True
        new_h, new_c, same = new_h[:n], (new_c[:n] | new_h[:n]), same[:n]
        copy = ~new_c & ~same
        group = np.cumsum(new_h)  # 0: the q-gram of the batch before
        several = np.zeros(int(group[-1]) + 1 if n else 1, bool)
        several[group[new_c & ~new_h]] = True
        edge = (new_c & ~new_h) | (new_h & several[group])
        rows = [np.flatnonzero(copy), np.flatnonzero(edge)]
        held = []
        if head is not None and n:
            if several[0]:
                held.append(head)
            head = None if several[0] or group[-1] > 0 else head
        if n and new_h.any() and not several[-1]:
            at = int(np.flatnonzero(new_h)[-1])
            head = (h[at], k[at], pos[at])
        elif n and new_h.any():
            head = None
        at = np.concatenate([*rows, np.arange(n, len(h))])
        out = [np.concatenate([x[at], np.array([v[i] for v in held], np.int64)]) for i, x in enumerate((h, k, pos))]
        flags = np.concatenate([np.ones(len(rows[0]), bool), np.zeros(len(rows[1]), bool), np.ones(len(h) - n, bool), np.zeros(len(held), bool)])
        last = (h[n - 1], c[n - 1], k[n - 1], pos[n - 1]) if n else last
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(flags)], names=["h", "k", "pos", "sure"])


_EDGE = "h bigint, k bigint, start bigint, left int, context binary, low int, high int"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``(k, base, t, edges)`` every edge with its bytes: ``left`` of them stand before the anchor, windows begin up to ``high`` - 1 before it."""
    wide = LENGTH - Q
    for batch in batches:
        if not batch.num_rows:
            continue
        k, base = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raw = [t.encode() for t in batch.column(2).to_pylist()]
        edges = batch.column(3)
        which = np.repeat(np.arange(len(raw)), np.diff(edges.offsets.to_numpy()))
        h, pos = (x.to_numpy() for x in edges.flatten().flatten())
        at = pos - base[which]
        s = np.maximum(0, at - wide)
        parts = [raw[i][a:b] for i, a, b in zip(which.tolist(), s.tolist(), (at + LENGTH).tolist())]
        n = len(h)
        columns = [pa.array(h), pa.array(k[which]), pa.array(s + base[which]), pa.array((at - s).astype(np.int32)), pa.array(parts, pa.binary()), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, wide + 1, np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _EDGE.split(", ")])


def eight_grams(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as numbers that sort like them; zeros stand behind the end."""
    v = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        v = (v[:-k] << np.uint64(8 * k)) | v[k:]
    return v


def suffix_order(grams: np.ndarray, depth: int, parts: int = 4, alike: int = 8) -> np.ndarray:
    """Positions of a string, given its ``eight_grams``, so that suffixes with ``depth`` bytes in common are neighbours, by bucket-pointer refinement.

    With ``alike`` 1 the string is one of numbers, and ``depth`` counts them.

    A bucket holds suffixes that begin alike; its name is the place of its first suffix in the order.  A round takes buckets
    of more than one suffix, sorts each by the names that its suffixes have further on, and doubles how much is alike.
    It does so in ``parts``, and a part's new names are written before the next part is sorted.
    """
    n = len(grams)
    order = np.argsort(grams)
    new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    pointer = np.zeros(n + 1, np.int64)  # what is behind the end stands before all
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots) and alike < depth:
        kept = []
        heads = np.flatnonzero(np.concatenate([[True], np.diff(pointer[order[slots]]) != 0]))
        cuts = np.unique(np.concatenate([heads[np.searchsorted(heads, len(slots) * np.arange(1, parts) // parts).clip(max=len(heads) - 1)], [0, len(slots)]]))
        for lo, hi in zip(cuts, cuts[1:]):
            mine = slots[lo:hi]
            at = order[mine]
            key = pointer[at] * (n + 1) + pointer[np.minimum(at + alike, n)]
            by = np.argsort(key)
            at, key = at[by], key[by]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            order[mine] = at
            pointer[at] = np.maximum.accumulate(np.where(new, mine + 1, 0))
            kept.append(mine[~(new & np.append(new[1:], True))])
        slots, alike = np.concatenate(kept), 2 * alike
    return order


def equal_strings(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Numbers for the strings of ``length`` bytes at ``starts``, equal if and only if the strings are: neighbours in suffix order are compared by all their bytes.

    This sorts every suffix and supposes nothing of the strings; the query's windows have anchors and go by ``late_windows``.
    """
    grams = eight_grams(data)
    place = np.empty(len(data), np.int64)
    place[suffix_order(grams, length)] = np.arange(len(data))
    by = np.argsort(place[starts])
    at = starts[by]
    same = np.flatnonzero(grams[at[1:]] == grams[at[:-1]]) if len(at) else at
    for i in (*range(8, length - 8, 8), length - 8):
        same = same[grams[at[same] + i] == grams[at[same + 1] + i]]
    new = np.ones(len(at), bool)
    new[same + 1] = False
    out = np.empty(len(at), np.int64)
    out[by] = np.cumsum(new)
    return out


def late_windows(data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """At ``[i, d]`` whether the window that begins ``d`` bytes before anchor ``i`` equals that of an anchor of its group with a lower rank.

    Anchor ``i`` is a place in ``data`` with ``left`` bytes of its context before it and ``right`` from it on; its windows have ``d`` from ``low`` to ``high`` - 1.
    """
    n, wide, words = len(anchor), LENGTH - Q, -(-LENGTH // 8)
    padded = np.concatenate([np.zeros(wide, np.uint8), data, np.zeros(8 * words, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, wide + 8 * words)[anchor]
    from_anchor = np.ascontiguousarray(around[:, wide:])
    from_anchor[np.arange(8 * words) >= np.minimum(right, LENGTH)[:, None]] = 0
    from_anchor = from_anchor.view(">u8").astype(np.uint64)
    place = np.empty(n * words, np.int64)
    place[suffix_order(from_anchor.ravel(), words, alike=1)] = np.arange(n * words)
    order = np.lexsort((place[::words], group))
    # neighbours compared byte by byte: how many they share from the anchor on
    other = from_anchor[order][1:] ^ from_anchor[order][:-1]
    word = (other != 0).argmax(1)
    bits = other[np.arange(n - 1), word]
    shared = np.concatenate([[-1], 8 * word + ((bits[:, None] >> np.arange(56, -1, -8).astype(np.uint64)) == 0).sum(1)])
    shared[1:][bits == 0] = 8 * words
    shared[1:][group[order][1:] != group[order][:-1]] = -1
    # from here on an anchor's number is its place in that order
    before = np.ascontiguousarray(around[order, :wide][:, ::-1].T)
    left, right, rank, low, high, bucket = (x[order] for x in (left, right, rank, low, high, group.astype(np.int64)))
    late = np.zeros((n, wide + 1), bool)
    ids = np.arange(n)
    for d in range(wide + 1):
        alike = np.cumsum(shared < LENGTH - d)
        here = (low[ids] <= d) & (d < high[ids]) & (right[ids] >= LENGTH - d)
        at, behind = ids[here], alike[ids[here]]
        if len(at):
            new = np.concatenate([[True], (bucket[here][1:] != bucket[here][:-1]) | (behind[1:] != behind[:-1])])
            heads = np.flatnonzero(new)
            late[at, d] = rank[at] > np.repeat(np.minimum.reduceat(rank[at], heads), np.diff(np.append(heads, len(at))))
        if d < wide:  # suffixes one byte longer: by the pointer to the bucket one byte on, and that byte
            stay = left[ids] > d
            ids = ids[stay]
            key = bucket[stay] * 256 + before[d][ids]
            by = np.argsort(key, kind="stable")
            ids, key = ids[by], key[by]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            several = ~(new & np.append(new[1:], True)[: len(key)])
            ids, bucket = ids[several], np.cumsum(new)[several]
    out = np.empty_like(late)
    out[order] = late
    return out


def _joined(got: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of contexts one behind another, and the size of each."""
    parts = pa.concat_arrays([b.column(4) for b in got]).cast(pa.large_binary())
    bounds = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return np.frombuffer(parts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)


def _by_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by q-gram in lots of about ``SORTED_BYTES``; a q-gram's rows are in one lot."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        if size >= SORTED_BYTES:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(h, last, "right"))
            held.append(b.slice(0, cut))
            if cut < len(h):
                yield held
                held, size, b = [], 0, b.slice(cut)
            else:
                continue
        held.append(b)
        size += len(_joined([b])[0])
    if held:
        yield held


def _sorted_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lot in _by_gram(batches):
        yield from _sorted_lot(lot)


def _sorted_lot(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    h, k, start, left, low, high = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1, 2, 3, 5, 6))
    data, sizes = _joined(got)
    at = start + left
    by = np.lexsort((at, k))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(np.append(True, (k[by][1:] != k[by][:-1]) | (at[by][1:] != at[by][:-1])))
    late = late_windows(data, np.cumsum(sizes) - sizes + left, left, sizes - left, np.cumsum(np.append(True, h[1:] != h[:-1])), rank, low, high)
    # windows of one context in a row become one interval
    edges = np.diff(np.pad(late, ((0, 0), (1, 1))).view(np.int8), axis=1)
    which, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    if len(which):
        yield pa.RecordBatch.from_arrays([pa.array(k[which]), pa.array(at[which] - last), pa.array(at[which] - first + LENGTH)], names=["k", "s", "e"])


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of q-grams over the cap, twice: the windows that begin nearer to the anchor and those that begin further before it.

    ``h`` becomes a hash of the bytes that all windows of a half hold; it only decides who meets whom.  A half whose common
    bytes a context lacks has no window there.
    """
    for b in batches:
        rows = []
        for h, k, start, left, context, low, high in zip(*(b.column(i).to_pylist() for i in range(7))):
            middle = (low + high) // 2
            for a, z in ((low, middle), (middle, high)):
                begin, end = left - a, left - z + 1 + LENGTH  # all windows lie over these bytes
                if a < z and begin >= 0 and end <= len(context):
                    digest = hashlib.blake2b(b"%d %d %d " % (h, a, z) + context[begin:end], digest_size=8).digest()
                    rows.append((int.from_bytes(digest, "little", signed=True), k, start, left, context, a, z))
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[f.split()[0] for f in _EDGE.split(", ")])


def _edge_intervals(contexts: DataFrame, cap: int) -> DataFrame:
    """Intervals of late windows; q-grams over the cap are halved until they aren't, or until a half is one window."""
    sort = lambda df: common.mapped(df.repartition("h").sortWithinPartitions("h"), _sorted_edges, "k bigint, s bigint, e bigint")
    found, todo = [], contexts
    while True:
        sizes = todo.groupBy("h").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("wide")).filter(F.col("n") > cap)
        large = common.written(sizes.select("h", (F.col("wide") > 1).alias("more")), "suffix-large")
        if large.isEmpty():
            found.append(sort(todo))
            return functools.reduce(DataFrame.unionByName, found)
        found.append(sort(todo.join(large, "h", "left_anti")))
        windows = todo.join(large.filter("not more"), "h", "left_semi").select("k", (F.col("start") + F.col("left") - F.col("low")).alias("s"), F.substring("context", F.col("left") - F.col("low") + 1, F.lit(LENGTH)).alias("w")).filter(F.length("w") == LENGTH)
        least = windows.groupBy("w").agg(F.min(F.struct("k", "s")).alias("least"))
        late = windows.join(least, "w").filter(F.struct("k", "s") > F.col("least"))
        found.append(late.select("k", "s", (F.col("s") + LENGTH).alias("e")))
        todo = common.written(common.mapped(todo.join(large.filter("more"), "h", "left_semi"), _halved, _EDGE), "suffix-halves")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        spans = batch.column("spans")
        bounds, values = spans.offsets.to_numpy(), spans.values
        s_all, e_all = (values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for i, (text, base) in enumerate(zip(batch.column("t").to_pylist(), batch.column("base").to_pylist())):
            raw = text.encode()
            s, e = s_all[bounds[i] : bounds[i + 1]] - base, e_all[bounds[i] : bounds[i + 1]] - base
            kept, at, gone, runs = hashlib.sha256(), 0, 0, []
            if len(s):
                s, e = np.maximum(s, 0), np.minimum(e, len(raw))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.concatenate([[True], s[1:] > e[:-1]])
                begin = np.flatnonzero(new)
                runs = list(zip(s[begin].tolist(), e[np.append(begin[1:], len(s)) - 1].tolist()))
            for a, b in runs:
                kept.update(raw[at:a])
                gone, at = gone + b - a, b
            kept.update(raw[at:])
            for c, v in zip(cols, (len(raw), gone, len(runs), kept.hexdigest(), [{"s": a, "e": b} for a, b in runs])):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


#: places in texts of one id differ above these bits
_BITS = 40


def _variants(rows: DataFrame) -> DataFrame:
    """``rows (k, th)`` of ids with several texts: ``k, th, base``, a multiple of 2 ** ``_BITS`` by the order of the texts' hashes."""
    several = rows.groupBy("k").agg(F.min("th").alias("low"), F.max("th").alias("high")).filter("low != high").select("k")
    texts = rows.join(several, "k", "left_semi").distinct()
    return texts.withColumn("base", (F.row_number().over(W.partitionBy("k").orderBy("th")) - 1) * F.lit(1 << _BITS))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; spans are the removed byte runs.

    Nulls: a null text is empty.  A row without an id counts as smaller than all others, and is ordered
    among such rows by a hash of its text.  Ties: rows repeated whole aren't earlier than each other, so both are
    judged against the rest alike; different texts of one id are documents of their own, the one of the smaller hash
    earlier.  Ids must be integers.  Texts of under 100 bytes lose nothing.  An empty table gives no rows.
    """
    common.small_batches(docs)
    key, text = common.column(docs, id_col), common.column(docs, text_col).cast("string")
    hidden = F.lit(-(1 << 62)) + F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1))
    name = docs.select(key).schema[0].dataType.simpleString()
    rows = docs.select(key.alias("doc_id"), F.coalesce(key.cast("long"), hidden).alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    variants = common.written(_variants(rows.select("k", F.xxhash64("t").alias("th"))), "suffix-variants")
    if variants.isEmpty():
        rows = rows.select("doc_id", "k", F.lit(0).cast("long").alias("base"), "t")
    else:
        rows = rows.withColumn("th", F.xxhash64("t")).join(variants, ["k", "th"], "left").select("doc_id", "k", F.coalesce("base", F.lit(0)).cast("long").alias("base"), "t")
    base = F.shiftleft(F.shiftright("pos", _BITS), _BITS).alias("base")
    found = common.mapped(rows.select("k", "base", "t"), _anchor_rows, _ANCHOR)
    marks = common.written(common.mapped(found.repartition("h").sortWithinPartitions("h", "c", "k", "pos"), _marks, _MARK), "suffix-marks")
    edges = marks.filter("not sure").groupBy("k", base).agg(F.collect_list(F.struct("h", "pos")).alias("edges"))
    contexts = common.written(common.mapped(rows.join(edges, ["k", "base"]).select("k", "base", "t", "edges"), _contexts, _EDGE), "suffix-contexts")
    sure = marks.filter("sure").select("k", "pos", (F.col("pos") - (LENGTH - Q)).alias("s"), (F.col("pos") + LENGTH).alias("e"))
    late = _edge_intervals(contexts, cap).select("k", F.col("s").alias("pos"), "s", "e")
    spans = common.written(sure.unionByName(late).groupBy("k", base).agg(F.collect_list(F.struct("s", "e")).alias("spans")), "suffix-spans")
    common.dropped(marks, contexts)
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    joined = rows.join(spans, ["k", "base"], "left").select("doc_id", "base", "t", F.coalesce("spans", none).alias("spans"))
    return common.mapped(joined, _removed, f"doc_id {name}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<s:bigint,e:bigint>>")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir)).drop("spans")
