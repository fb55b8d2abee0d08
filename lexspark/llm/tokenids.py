"""Token-id output in a bit-plane container.

Documents are sorted by id over the cluster, encoded, ended with an end id, and their ids are
cut into blocks of a fixed size.  A block's ids, as little-endian 32-bit integers, are transposed into
byte planes (or bit planes) and each plane is compressed with zstandard: the high planes are
almost constant and all but vanish.  Blocks are rows of a Parquet table, so Spark's commit
protocol covers lost executors and any store that Spark writes to is good.

Block payload: ``BPS1``, mode (B or b), number of planes (one byte), number of ids (u32), the
planes' compressed lengths (u32 each), then the zstandard frames.  Beside it each row is the
chunk index: shard, chunk number, first id's place in the shard, and the documents of the block
(ids, lengths, whether the first goes on from the block before, and where that one began).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BLOCK = 65536
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: bytes of a worker's newer cache generation; when it is full it replaces the older one
CACHE_BYTES = 32 << 20
#: characters of the longest pretoken that is cached
LONG = 64
#: bytes of texts that are encoded at once (a longer text alone)
LOT = 8 << 20

MAGIC = b"BPS1"


def pack(ids: np.ndarray, mode: str = "B", level: int = 3) -> bytes:
    """A block's payload; mode B: four byte planes, b: 32 bit planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    planes = raw.T if mode == "B" else np.packbits(np.unpackbits(raw, axis=1).T, axis=1)
    c = zstandard.ZstdCompressor(level=level)
    frames = [c.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return MAGIC + struct.pack("<cBI", mode.encode(), len(frames), len(ids)) + struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a bit-plane block")
    mode, planes, n = struct.unpack_from("<cBI", payload, 4)
    lengths, at = struct.unpack_from(f"<{planes}I", payload, 10), 10 + 4 * planes
    d, out = zstandard.ZstdDecompressor(), []
    for size in lengths:
        out.append(np.frombuffer(d.decompress(payload[at : at + size]), np.uint8))
        at += size
    rows = np.stack(out)
    raw = rows.T if mode == b"B" else np.packbits(np.unpackbits(rows, axis=1)[:, :n].T, axis=1)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


# How the byte-level tokenizer cuts a text into pretokens.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\pL+| ?\pN+| ?[^\s\pL\pN]+|\s"
# End of the fixed values.
#: texts that aren't cut: white space in runs or at an end (it decides a pretoken by what follows), control characters
_RUNS = r"[ \t\n\f\r][ \t\n\f\r]|^[ \t\n\f\r]|[ \t\n\f\r]$|[\x00-\x08\x0B\x0E-\x1F\x7F]"
#: characters of which all Unicode tables agree whether they are letters, digits or space; texts with others aren't cut
_UNSURE = r"[^\x00-\x7EÀ-ÖØ-öø-ɏ\x{1E00}-\x{1EFF}‘’“”–—…«»¡¿]"
_CUT = "\x1f"


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that ``codes`` name, one after the other; a lot has far fewer than 2 ** 31 ids."""
    n = sizes[codes]
    ends = np.cumsum(n, dtype=np.int32)
    at = np.repeat(starts[codes] - (ends - n), n)
    at += np.arange(len(at), dtype=np.int32)
    return values[at]


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int32) - sizes


class Encoder:
    """Encoding of whole texts, a column at a time, with a cache of pretokens.

    The tokenizer cuts a text into pretokens and encodes each for itself, and a single space between two other
    characters always starts one.  So texts are cut at spaces, distinct pieces into pretokens, and of these only
    those not in the cache are encoded, all in one call: joined by line feeds, which are tokens of their own.
    Ids are then gathered by their numbers.  A text with other white space, or with characters that Unicode tables
    class in different ways, is encoded as it is.

    Pretokens that come once in a lot aren't kept: most never come again.  The cache holds two generations of about ``CACHE_BYTES`` each (230 bytes are reckoned for an entry, its objects
    and its place in the table included); pretokens of over ``LONG`` characters aren't kept.
    """

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(tokenizer) if "/" not in tokenizer else tokenizer)
        named = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole_only = "|".join([_RUNS, *named])
        self.tokenizer.model._resize_cache(0)  # pretokens that come again are kept here
        self.feed = int(self.whole("\n")[0])
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "Ġ"]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def ids(self, names: list[str], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pretokens: all of them, and where each one's start and how many they are.  Of new ones those that come ``often`` are kept."""
        out = list(map(self.new.get, names))
        if self.old:
            again = [i for i, v in enumerate(out) if v is None]
            found = list(map(self.old.get, map(names.__getitem__, again)))
            back = [(i, v) for i, v in zip(again, found) if v is not None]
            for i, v in back:
                out[i] = v
            self.keep([names[i] for i, _ in back], [v for _, v in back])
        missing = [i for i, v in enumerate(out) if v is None]
        # those after a space tell their first id by it, others are joined by line feeds; white space and nothing are encoded as they are
        after = [i for i in missing if names[i][:1] == " " and len(names[i]) > 1]
        others = [i for i in missing if names[i][:1] != " " and names[i] and not names[i].isspace()]
        for i in set(missing).difference(after, others):
            out[i] = self.whole(names[i]).tobytes()
        starts, sizes = np.zeros(len(names), np.int32), np.zeros(len(names), np.int32)
        known = [i for i, v in enumerate(out) if v is not None]
        values = [out[i] for i in known]
        sizes[known] = np.array(list(map(len, values)), np.int32) // 4
        starts[known] = _starts(sizes[known])
        tokens = [np.frombuffer(b"".join(values), "<u4")]
        for of, feed in ((after, 0), (others, 1)):
            if of:
                got = self.whole(("\n" if feed else "").join([names[i] for i in of]))
                edge = np.flatnonzero(got == self.feed) if feed else np.flatnonzero(self.spaced[got])[1:]
                begin, end = np.concatenate([[0], edge + feed]), np.append(edge, len(got))
                starts[of], sizes[of] = begin + sum(map(len, tokens)), end - begin
                tokens.append(got)
                raw, kept = got.tobytes(), np.flatnonzero(often[of])
                self.keep([names[of[k]] for k in kept.tolist()], [raw[4 * x : 4 * y] for x, y in zip(begin[kept].tolist(), end[kept].tolist())])
        return np.concatenate(tokens), starts, sizes

    def keep(self, names: list[str], values: list[bytes]) -> None:
        if self.size >= CACHE_BYTES:
            self.old, self.new, self.size = self.new, {}, 0
        if names and max(map(len, names)) > LONG:
            names, values = zip(*[(n, v) for n, v in zip(names, values) if len(n) <= LONG] or [((), ())])
        self.new.update(zip(names, values))
        self.size += 230 * len(names)

    def encode(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text; a null is empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        edge = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
        coded = pieces.flatten().dictionary_encode()
        codes, distinct = coded.indices.to_numpy().copy(), coded.dictionary
        heads, which = np.unique(codes[edge], return_inverse=True)  # a text's first piece has no space before it
        codes[edge] = len(distinct) + which
        forms = pa.concat_arrays([pc.binary_join_element_wise(pa.scalar(" "), distinct, ""), distinct.take(pa.array(heads))])
        cut = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(forms, _PRETOKEN, rf"\0{_CUT}"), _CUT), _CUT)
        at = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        named = cut.flatten().dictionary_encode()
        names, parts = named.dictionary, named.indices.to_numpy()
        unsure = pc.match_substring_regex(names, _UNSURE).to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(texts, self.whole_only).to_numpy(zero_copy_only=False)
        if unsure.any():
            odd |= np.logical_or.reduceat(np.logical_or.reduceat(unsure[parts], at)[codes], edge)
        names = pc.if_else(pa.array(unsure), "", names)  # the texts of those don't use them
        spread = np.diff(np.append(at, len(parts)))
        times = np.bincount(parts, np.repeat(np.bincount(codes, minlength=len(forms)), spread), len(names))
        values, starts, sizes = self.ids(pc.binary_join(pa.ListArray.from_arrays([0, len(names)], names), _CUT)[0].as_py().split(_CUT), times > 1)
        in_form = np.add.reduceat(sizes[parts], at, dtype=np.int32)
        ids = _gathered(_gathered(values, starts, sizes, parts), _starts(in_form), in_form, codes)
        ends = np.cumsum(np.add.reduceat(in_form[codes], edge)).tolist()
        out = [ids[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


_ENCODERS: dict[str, Encoder] = common.held({})


def encoder(tokenizer: str) -> Encoder:
    """One for each Python worker."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def _container_schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("first_doc_start", pa.int64()), ("doc_ids", pa.list_(key)), ("lengths", pa.list_(pa.int64())), ("ends", pa.list_(pa.bool_())), ("payload", pa.binary())])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, batches put together or cut to about ``LOT`` bytes of text: the more of it, the more it repeats."""

    def joined() -> tuple[pa.Array, pa.Array]:
        return tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = before = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(sizes, before + LOT - size, "right"))
            if to == at and held:
                yield joined()
                held, size = [], 0
                continue
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            size += int(sizes[to - 1]) - before
            at, before = to, int(sizes[to - 1])
    if held:
        yield joined()


def _blocks(batches: Iterator[pa.RecordBatch], key: pa.DataType, tokenizer: str, block: int, end_id: int, mode: str) -> Iterator[pa.RecordBatch]:
    schema, enc, end = _container_schema(key), encoder(tokenizer), np.array([end_id], "<u4")
    shard, chunk, first, doc_start = TaskContext.get().partitionId(), 0, 0, 0
    ids, held, docs, lengths, ends = [], 0, [], [], []

    def flush() -> pa.RecordBatch:
        nonlocal chunk, first, ids, held, docs, lengths, ends
        values = np.concatenate(ids)
        row = [shard, chunk, first, held, doc_start, docs, lengths, ends, pack(values, mode)]
        out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        chunk, first = chunk + 1, first + held
        ids, held, docs, lengths, ends = [], 0, [], [], []
        return out

    for keys, texts in _lots(batches):
        for doc_id, own in zip(keys.to_pylist(), enc.encode(texts)):
            data, at, began = np.append(own, end), 0, first + held
            total = len(data)
            while at < total:
                take = min(block - held, total - at)
                if not docs:
                    doc_start = began
                ids.append(data[at : at + take])
                docs.append(doc_id)
                lengths.append(take)
                ends.append(at + take == total)
                held, at = held + take, at + take
                if held == block:
                    yield flush()
    if held:
        yield flush()


def write_ids(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, block: int = BLOCK, mode: str = "B", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, sort by id and write the container; returns the container as read back.

    Nulls: a null text is empty (its end id alone); null ids come first.  Ties and repeated
    rows: rows of one id are ordered by text, and each is written.  Texts of any length are
    encoded whole and span blocks.  An empty table gives an empty container.
    """
    key = docs.select(common.column(docs, id_col).alias("k"))
    import pyspark.sql.pandas.types as to_arrow

    common.small_batches(docs)
    kind, name = to_arrow.to_arrow_type(key.schema["k"].dataType), key.schema["k"].dataType.simpleString()
    schema = f"shard int, chunk bigint, first bigint, n_ids bigint, first_doc_start bigint, doc_ids array<{name}>, lengths array<bigint>, ends array<boolean>, payload binary"
    rows = docs.select(common.column(docs, id_col).alias("k"), F.coalesce(common.column(docs, text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.repartitionByRange("k").sortWithinPartitions("k", "t")  # the sample for the bounds holds ids only
    return common.written(common.mapped(rows, lambda it: _blocks(it, kind, tokenizer, block, end_id, mode), schema), "token-ids")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in ("shard", "doc_start", "doc_id", "at", "n", "crc")}
        for r in batch.to_pylist():
            data, at, began = unpack(r["payload"]).tobytes(), 0, r["first_doc_start"]
            for doc_id, n, over in zip(r["doc_ids"], r["lengths"], r["ends"]):
                for k, v in zip(cols, (r["shard"], began, doc_id, r["first"] + at, n, zlib.crc32(data[4 * at : 4 * (at + n)]))):
                    cols[k].append(v)
                at += n
                began = r["first"] + at if over else began
        kinds = (pa.int32(), pa.int64(), batch.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))


def crc32_combined(one: int, two: int, n: int) -> int:
    """crc32 of a + b from crc32(a), crc32(b) and the length of b, by squaring the shift operator."""
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    square = lambda m: [times(m, row) for row in m]
    op = square(square([0xEDB88320, *(1 << i for i in range(31))]))  # four zero bits
    while n:
        op = square(op)
        if n & 1:
            one = times(op, one)
        n >>= 1
    return one ^ two


def _xor(values: Iterator[int]) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pieces = batch.column("pieces")
        edge, values = pieces.offsets.to_numpy(), pieces.values
        n, crc = (values.field(k).to_numpy() for k in (1, 2))
        sums, whole = np.concatenate([[0], np.cumsum(n)]), crc[edge[:-1]]
        for i in np.flatnonzero(np.diff(edge) > 1):  # documents in several blocks
            for j in range(edge[i] + 1, edge[i + 1]):
                whole[i] = crc32_combined(int(whole[i]), int(crc[j]), 4 * int(n[j]))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_start"), batch.column("doc_id"), pa.array(sums[edge[1:]] - sums[edge[:-1]], pa.int64()), pa.array(whole, pa.int64())], names=["shard", "doc_start", "doc_id", "n_tokens", "ids_crc32"])


def read_index(container: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the container."""
    name = container.schema["doc_ids"].dataType.elementType.simpleString()
    pieces = common.mapped(container, _pieces, f"shard int, doc_start bigint, doc_id {name}, at bigint, n bigint, crc bigint")
    grouped = pieces.groupBy("shard", "doc_start", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))
    docs = common.mapped(grouped, _joined, f"shard int, doc_start bigint, doc_id {name}, n_tokens bigint, ids_crc32 bigint")
    # one row per shard (output file) in this window
    totals = container.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(before, "shard").select("doc_id", (F.col("before") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_index(write_ids(common.documents(spark, sf_dir)))
