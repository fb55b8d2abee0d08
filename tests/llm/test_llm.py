"""Queries against SQL where there is some, else against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import chat, common, decontam, langid, licenses, mixing, orderminhash, queries, sharding, simhash, suffixdedup, tokenids

WORDS = ["".join(random.Random(i).choice("abcdeé") for _ in range(3 + i % 6)) for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeats, ties, and columns whose names helpers use too."""
    long = prose(1, 3000)
    rows = [(1, prose(2, 60)), (2, None), (3, ""), (4, long), (5, prose(2, 60)), (5, prose(2, 60)), (6, long.replace(WORDS[3], WORDS[4])), (None, prose(7, 30)), (None, None), (8, "x"), (9, " \n ")]
    return spark.createDataFrame([(d, t, "en", None if d == 8 else "s", 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, lang string, source string, _row_hash int, _kept_id int, fp int, t int")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def test_every_operator_takes_odd_rows_and_none(spark, docs):
    items = spark.createDataFrame([(1, prose(2, 12)), (None, "x"), (3, None)], "item_id long, text string")
    model = langid.learn(docs, F.lit(True))
    operators = {
        "scan": licenses.scan, "assign": sharding.assign, "mix": mixing.mix, "edits": orderminhash.fingerprint_edits, "ids": lambda d: tokenids.read_index(tokenids.write_ids(d)),
        "near": simhash.near_duplicates, "clean": lambda d: decontam.decontaminate(d, items), "language": lambda d: langid.identify(d, model),
    }
    for name, run in operators.items():
        assert run(docs).count() >= (10 if name == "mix" else 11), name
        assert run(docs.limit(0)).count() == 0, name
    for keep in (simhash.keep_first, mixing.mixed, lambda d: decontam.keep_clean(d, items), lambda d: langid.keep_identified(d, model)):
        assert keep(docs).columns == docs.columns and keep(docs.limit(0)).count() == 0
    assert suffixdedup.remove_repeats(docs).count() == 11
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0
    chats = spark.createDataFrame([(1, 0, "user", None), (1, 0, None, "a"), (None, None, "x", "y")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chats).count() == 2 and chat.format_chats(chats.limit(0)).count() == 0


def test_licence_notices_of_several_paragraphs_and_amid_prose():
    table, (mit, bsd) = licenses.compiled(licenses.all_templates(), 0.8), (licenses.TEMPLATES[n][-1] for n in ("MIT", "BSD-3-Clause"))
    found = lambda text: {m[0] for m in licenses.matches(text, table, 0.8)}
    for name, text, cuts in (("MIT", mit, ("The above copyright", "THE SOFTWARE IS")), ("BSD-3-Clause", bsd, ("1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE"))):
        for c in cuts:
            text = text.replace(c, "\n\n" + c, 1)
        assert name in found(f"{prose(1, 900)}\n\n{text}\n\n{prose(2, 900)}") and name in found(text)
    assert "THE IMPLIED WARRANTIES" in bsd and found(f"{prose(3, 400)} {licenses.TEMPLATES['MPL-2.0'][0]} {prose(4, 400)}") == {"MPL-2.0"}
    line = "Released under the MIT License."
    assert [m[2] for m in licenses.matches(f"{prose(5, 90)} {line} {prose(6, 90)}\n{line}", table, 0.8)] == [2, 3] and not found(prose(7, 900))


def test_complete_licences():
    """Whole files, files with something before them, truncated by a tenth, and in part only."""
    texts = {n: ts[-1] for n, ts in licenses.all_templates().items()}
    table = licenses.compiled(licenses.all_templates(), 0.8)
    as_whole = lambda text: {m[0]: m[1] for m in licenses.matches(text, table, 0.8) if m[2] == 0}
    long = [n for n, t in texts.items() if len(t) > 3000]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(long)
    for name in long:
        assert as_whole(texts[name].upper().replace("\n", "\r\n"))[name] == 1.0
        assert name in as_whole("Copyright 2001 by somebody\n\n" + texts[name]) and name in as_whole(texts[name][: len(texts[name]) * 9 // 10])
        assert all(m[0] != name or m[2] > 0 for m in licenses.matches(texts[name][: len(texts[name]) // 3], table, 0.8))
    embedded = f"{prose(1, 3000)}\n\n{texts['Apache-2.0']}\n\n{prose(2, 3000)}"
    assert "Apache-2.0" in {m[0] for m in licenses.matches(embedded, table, 0.8)}


def test_index_leaves_no_licence_out():
    r = random.Random(2)
    texts = {f"T{i}": [" ".join(r.choice("abcdefgh") for _ in range(r.randint(3, 40)))] for i in range(30)}
    table = licenses.compiled(texts, 0.6)
    for _ in range(300):
        words = " ".join(r.choice("abcdefgh") for _ in range(r.randint(2, 40)))
        own = licenses.bigrams(words.split())
        want = {(n, 2 * len(own & b) / (len(own) + len(b))) for n, b, _, _ in table.rows if 2 * len(own & b) / (len(own) + len(b)) >= 0.6}
        assert {m[:2] for m in licenses.matches(words, table, 0.6) if m[2] == 0} == want


def test_shards(spark):
    rows = queries.queries()["op2_virtual_slots"](spark, SF).collect()
    source = {r.doc_id: (r.text or "").encode() for r in common.documents(spark, SF).collect()}
    assert all(r.size == len(source[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(source[r.doc_id]) for r in rows)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    heavy = {s: sum(r.size for r in rows if r.shard == s) for s in range(8)}
    slots = {}
    for r in rows:
        slots[r.virtual_slot] = slots.get(r.virtual_slot, 0) + r.size
    assert max(heavy.values()) - min(heavy.values()) <= max(slots.values())  # greedy: no closer than one slot
    assert {r.next_version for r in rows} == {3} and all(r.next_shard in (r.shard, 8) or r.next_shard < 8 for r in rows) and any(r.next_shard == 8 for r in rows)
    after = {s: sum(r.size for r in rows if r.next_shard == s) for s in range(9)}
    assert max(after.values()) <= sum(after.values()) / 9 + max(slots.values())


def test_slot_maps_are_edited_with_few_moves(spark, tmp_path):
    r = random.Random(3)
    sizes = {i: r.randint(1, 400) for i in range(4096)}
    one = sharding.plan(sizes, 8)
    two = sharding.grow(one, sizes)
    mean = sum(sizes.values()) / 9
    assert max(one.loads(sizes)) <= 1.001 * sum(sizes.values()) / 8 and (two.version, two.n_shards) == (2, 9)
    assert all(a == b or b == 8 for a, b in zip(one.shard_of, two.shard_of)) and max(two.loads(sizes)) < 1.02 * mean and two.loads(sizes)[8] > 0.98 * mean
    later = {i: s * (3 if one.shard_of[i] == 0 else 1) for i, s in sizes.items()}
    three = sharding.rebalance(two, later, tolerance=0.02)
    mean, loads = sum(later.values()) / 9, two.loads(later)
    excess = sum(max(0, x - mean) for x in loads)
    moved = sum(later[i] for i, (a, b) in enumerate(zip(two.shard_of, three.shard_of)) if a != b)
    assert max(three.loads(later)) <= 1.02 * mean and 0 < moved <= 1.1 * excess and three.version == 3
    assert sharding.rebalance(three, later).shard_of == three.shard_of
    path = f"file://{tmp_path}/map"
    for m in (one, two, three):
        sharding.save_map(spark, m, path)
    for m, version in ((one, 1), (three, None)):
        assert [x.shard for x in sorted(sharding.load_map(spark, path, version).collect())] == list(m.shard_of)
    with pytest.raises(Exception, match="exists"):
        sharding.save_map(spark, three, path)


def test_chat_round_trip(spark):
    texts = ["", "</s>[INST] ok", "<\\/s>", "[\\INST]", "<", "[", "[/ROLE] [/TURN]", "a\n<s>"]
    rows = [(i, k, r, t) for i, t in enumerate(texts) for k, r in enumerate(("user", "assistant", "tool[/ROLE]"))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"))
    assert {(r.conv_id, k, t.role, t.text) for r in out.collect() for k, t in enumerate(r.t)} == set(rows)


def test_edits(spark):
    rows = {r.doc_id: r.text or "" for r in common.documents(spark, SF).collect()}
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in queries.queries()["op5_order_minhash"](spark, SF).collect()}
    for i, d in enumerate(order):
        t, after, half = rows[d], rows[order[(i + 1) % len(order)]], len(rows[d]) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() and got[d].n_chars == len(t)
    assert len({(rows[d], got[d].fingerprint) for d in rows}) == len(set(rows.values()))


def order_minhash(text):
    """Bins with their 40 bits, by the definition: minimal pairs of (word pair, occurrence) in text order."""
    import xxhash

    chained = lambda *parts: __import__("functools").reduce(lambda seed, b: xxhash.xxh64_intdigest(b, seed), parts, 42)
    w = [x for x in re.split("[\x09-\x0d ]+", text) if x]
    grams = [tuple(w[i : i + 2]) for i in range(max(len(w) - 1, min(len(w), 1)))]
    seen, bins = {}, {}
    for pos, g in enumerate(grams):
        h, n = chained(*(x.encode() for x in g)) >> 31, seen.get(g, 0)
        seen[g] = n + 1
        h = h if n == 0 else chained(h.to_bytes(8, "little"), n.to_bytes(4, "little")) >> 31
        bins.setdefault(h >> 27, []).append((h, pos))
    out = {}
    for b, pairs in sorted(bins.items()):
        kept = sorted(sorted(pairs)[:2], key=lambda x: x[1])
        out[b] = chained(*(h.to_bytes(8, "little") for h, _ in kept)) >> 24
    return out


@pytest.mark.parametrize("rows,buckets", [(2048, 4096), (20, 4096), (5, 3)])
def test_order_minhash(spark, monkeypatch, rows, buckets):
    """Fingerprints and likenesses against the definition, in one bucket, in many, and in buckets of buckets."""
    monkeypatch.setattr(orderminhash, "ROWS_A_BUCKET", rows)
    monkeypatch.setattr(orderminhash, "MAX_BUCKETS", buckets)
    r = random.Random(6)
    texts = {i * 3: prose(i % 90, r.randint(0, 200)) + " ab" * r.randint(0, 9) for i in range(150)} | {1: "", 2: "x", 451: "a b a b a b", 452: None}
    order = sorted(texts, reverse=True)
    got = {x.doc_id: x for x in orderminhash.fingerprint_edits(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, d in enumerate(order):
        t, after = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(order_minhash, (t, edited, after))
        shown = lambda x: "".join(f"{k << 40 | v:012x}" for k, v in x.items())
        like = lambda x, y: sum(x.get(k) == v for k, v in y.items()) / len(x.keys() | y.keys()) if x or y else 1.0
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (shown(a), shown(b)) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[d].near_edited, got[d].near_next) == pytest.approx((like(a, b), like(a, c)))


def test_token_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts, start = {r.doc_id: r.text or "" for r in common.documents(spark, SF).collect()}, 0
    for r in sorted(queries.queries()["op6_token_ids"](spark, SF).collect()):
        ids = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r.n_tokens
    e, r = tokenids.Encoder(), random.Random(3)
    parts = ["a", "é", "9", "'s", " ", "  ", "\n", "_", ".", "you", "🙂", "²", "<|endoftext|>", "ệ", "\xa0", "\x1f", "\t", " b", "\r\n"]
    for lot in range(4):  # the later ones from the cache, and with its generations changing
        e.size = tokenids.CACHE_BYTES * (lot == 2)
        xs = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(1000)] + ["x" * 5000, None]
        assert [v.tolist() for v in e.encode(pa.array(xs))] == [t.encode(x or "", add_special_tokens=False).ids for x in xs]
    for mode in "Bb":
        ids = np.arange(1003, dtype="<u4") * 37
        assert (tokenids.unpack(tokenids.pack(ids, mode)) == ids).all()
    a, b = b"abcd" * 9, b"xy12" * 5
    assert tokenids.crc32_combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def removed(rows):
    """By the contract: (bytes, removed bytes, runs, digest of the rest); texts of one id in the order of their hashes."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def after_removal(spark, rows, **options):
    found = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found)


@pytest.mark.parametrize("lot,cap", [(2 << 20, 20_000), (2000, 20_000), (2 << 20, 12), (2 << 20, 1)])
def test_suffix_dedup(spark, monkeypatch, lot, cap):
    """With lots of few bytes, and with q-grams over the cap, halved until they aren't."""
    monkeypatch.setattr(suffixdedup, "SORTED_BYTES", lot)
    r = random.Random(5)
    passages = [prose(50 + i, 40) for i in range(5)]
    rows = [(d, prose(d, r.randint(0, 60)) + "".join(r.choice(passages)[: r.randint(50, 250)] + prose(d + 9, 3) for _ in range(r.randint(0, 3)))) for d in range(80)]
    rows += [(80, None), (81, "x" * 1500), (82, rows[3][1])]
    assert after_removal(spark, rows, cap=cap) == sorted(removed(rows))


def test_suffix_dedup_of_very_long_texts(spark):
    long = prose(77, 220_000)
    assert len(long.encode()) > (1 << 20) + 20_000
    rows = [(1, prose(1, 300)), (2, long[:900_000] + prose(1, 300) + long[900_000:]), (3, prose(3, 50) + long[-5000:-100] + prose(4, 50)), (4, long[1000:1_200_000])]
    assert after_removal(spark, rows) == sorted(removed(rows))


def test_suffix_dedup_of_one_id_with_several_texts(spark):
    one, two = prose(1, 60), "short"
    rows = [(1, one + " | " + one), (1, two), (2, one), (2, one), (None, one), (None, one + two), (3, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.xxhash64("text").alias("h"), F.xxhash64("text").bitwiseAND(F.lit((1 << 60) - 1)).alias("hidden")).collect()
    order = sorted(texts, key=lambda x: (x.doc_id is not None, x.doc_id or x.hidden, x.h))
    want, done = [], {}
    for x in order:  # rows repeated whole are judged alike
        key = (x.doc_id, x.text)
        if key not in done:
            done[key] = None
    for (d, t), w in zip(done, removed(list(done))):
        want += [w] * sum((x.doc_id, x.text) == (d, t) for x in texts)
    assert sorted(after_key(x) for x in want) == sorted(after_key(tuple(x)) for x in suffix_rows(spark, rows))


def after_key(x):
    return tuple(map(repr, x))


def suffix_rows(spark, rows):
    return suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()


def test_suffix_order_keeps_strings_that_begin_alike_together():
    r = random.Random(1)
    for _ in range(60):
        base = "".join(r.choice(r.choice(["ab", "abc\0", "abcdefgh"])) for _ in range(r.randint(100, 500)))
        data = (base + base[r.randint(0, 50) :] + base[:150]).encode()
        starts = sorted(r.sample(range(len(data) - 99), 60))
        got, first = suffixdedup.equal_strings(np.frombuffer(data, np.uint8), np.array(starts)), {}
        want = [first.setdefault(data[s : s + 100], i) for i, s in enumerate(starts)]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_suffix_edges_are_sorted_from_their_anchors_on(monkeypatch):
    """A lot sorts a word of eight bytes, not a byte: thirteen suffixes a context; and finds what comparing all windows of a q-gram finds."""
    sorted_ones, order = [], suffixdedup.suffix_order
    monkeypatch.setattr(suffixdedup, "suffix_order", lambda grams, *a, **k: sorted_ones.append(len(grams)) or order(grams, *a, **k))
    r = random.Random(3)
    some = lambda n: bytes(r.choice(b"ab\0") for _ in range(n))
    sides = [(some(68), some(68)) for _ in range(3)]
    rows, want = [], set()
    for h in range(40):
        gram, low, high, seen = some(32), *r.choice([(0, 69), (0, 69), (20, 41), (7, 8)]), {}
        for _ in range(r.randint(1, 12)):
            near, far = r.choice(sides)[0], r.choice(sides)[1]
            i, j = r.choice([0, r.randint(0, 68)]), r.choice([68, r.randint(0, 68)])
            left, right = some(i) + near[i:], far[:j] + some(68 - j)
            left, right = left[r.choice([0, 0, r.randint(0, 68)]) :], right[: r.choice([68, 68, r.randint(0, 68)])]
            rows.append((h, r.randint(0, 30), 1000 * r.randint(0, 2), len(left), left + gram + right, low, high))
        mine = sorted((x for x in rows if x[0] == h), key=lambda x: (x[1], x[2] + x[3]))
        for _, k, start, n, context, low, high in mine:
            for d in range(low, high):
                window = context[n - d : n - d + 100] if n >= d else b""
                if len(window) == 100:
                    first = seen.setdefault((d, window), (k, start + n))
                    if first < (k, start + n):
                        want |= {(k, start + n - d + i) for i in range(100)}
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
    names = [f.split()[0] for f in suffixdedup._EDGE.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 50]), kinds)], names=names) for i in range(0, len(rows), 50)]
    found = {(x["k"], i) for b in suffixdedup._sorted_edges(iter(batches)) for x in b.to_pylist() for i in range(x["s"], x["e"])}
    assert want and found == want
    assert sum(sorted_ones) == 13 * len(rows)


def test_suffix_anchors_are_those_of_every_whole_window(monkeypatch):
    """In slices of a few windows and in one: short, empty and repeated texts, none of whose windows reach into the next."""
    r = random.Random(8)
    texts = [prose(i, r.randint(0, 40)).encode()[: r.choice([0, 1, 99, 100, 101, 5000])] for i in range(60)] + [b"x" * 700, b"", b"y" * 99]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    every = []
    for size in (1 << 9, 1 << 11, suffixdedup._SLICE):
        monkeypatch.setattr(suffixdedup, "_SLICE", size)
        got = [np.concatenate(x).tolist() for x in zip(*suffixdedup.anchors(data, ends))]
        every.append(set(zip(*got)))
        for i, t in enumerate(texts):
            at = sorted(p for _, j, p in zip(got[0], got[2], got[3]) if i == j)
            assert all(any(w <= p <= w + 68 for p in at) for w in range(len(t) - 99)) and (len(t) >= 100 or not at)
    assert every[0] == every[1] == every[2]


def test_decontamination_by_broadcast_and_by_shuffle(spark, same):
    """Beyond the bound of a broadcast windows and words meet by token, with the same result; rare, common and repeated words."""
    d = common.documents(spark, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontam.decontaminate(d, items, max_broadcast=0)
    same(out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")), decontam.OP9_SQL)
    r = random.Random(4)
    texts = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(3, "A b. a!"), (None, "a b a a"), (None, None), (50, "b " * 3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("token", F.lit("x"))
    bench = spark.createDataFrame([(1, "a b b a"), (2, "a b a"), (None, "b b b b b b"), (3, ""), (4, "zz a"), (5, "b a b b a b a a b b a b")], "item_id long, text string")
    key = lambda df: sorted((repr(x.doc_id), x.n_words, x.n_hit, x.n_items, tuple(x.items), tuple(map(tuple, x.spans or []))) for x in df.collect())
    got = key(decontam.decontaminate(docs, bench, window=5))
    assert got == key(decontam.decontaminate(docs, bench, window=5, max_broadcast=0))
    for d_, n, n_hit, n_items, items_, spans in got:
        assert n_items == len(items_) and n_hit == len({p for s, k in spans for p in range(s, s + k)}) and n_hit <= n, d_
    by_hand = ["a b b a", "a b a", "b b b b b", "b a b b a", "a b b a b", "b b a b a", "b a b a a", "a b a a b", "b a a b b", "a a b b a"]
    text = dict(texts[:40])
    want = {i: sum(any(p <= q < p + len(w.split()) for w in by_hand for p in range(len(t.split())) if t.split()[p : p + len(w.split())] == w.split()) for q in range(len(t.split()))) for i, t in text.items()}
    assert all(want[int(x[0])] == x[2] for x in got if x[0] not in ("None", "3", "50"))
    kept = [sorted(repr(x.doc_id) for x in decontam.keep_clean(docs, bench, window=5, max_broadcast=m).collect()) for m in (0, 1 << 30)]
    assert kept[0] == kept[1] == sorted(x[0] for x in got if x[2] == 0)


def test_simhash_components(spark):
    rows = queries.queries()["op8_simhash"](spark, SF).collect()
    fps = {int(r.fingerprint, 16) for r in rows}
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                label[root(a)] = root(b)
    least = {}
    for r in rows:
        k = root(int(r.fingerprint, 16))
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least[root(int(r.fingerprint, 16))] for r in rows)


def test_simhash_fingerprints_and_links_by_brute_force(spark, monkeypatch):
    """Every bit by counting, and components of all pairs, also where buckets are over the cap and lots are small."""
    import xxhash

    r = random.Random(13)
    texts = ["", None, "One", "a B", " \t", "Ab cd ab CD ab cd", "É é É", "x " * 200, *(prose(i, r.randint(3, 40)) for i in range(30))]
    texts += [" ".join(t.split()[:-1] + ["zz"]) for t in texts[10:30]] + texts[15:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def fingerprint(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower) if x]
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    for radius, cap, lot in ((2, simhash.CAP, simhash.LOT), (2, 2, 4), (9, 3, 5)):
        monkeypatch.setattr(simhash, "LOT", lot)
        label = list(range(len(fps)))
        for _ in fps:
            label = [min(label[j] for j, g in enumerate(fps) if (f ^ g).bit_count() <= radius) for f in fps]
        got = sorted(simhash.near_duplicates(docs, radius=radius, cap=cap).collect())
        assert [(x.doc_id, x.fp % (1 << 64), x.component_id) for x in got] == [(i, f, c) for i, (f, c) in enumerate(zip(fps, label))], (radius, cap)


def test_near_copies_go_and_others_stay(spark):
    base = [prose(100 + i, 200) for i in range(20)]
    near = [b.rsplit(" ", 1)[0] + " changed" for b in base]
    far = [prose(300 + i, 200) for i in range(20)]
    rows = [*enumerate(base), *enumerate(near, 20), *enumerate(far, 40), *enumerate(base, 60)]
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(20)) | set(range(40, 60)) <= kept and not kept & set(range(60, 80)) and len(kept & set(range(20, 40))) <= 2


@pytest.mark.parametrize("block", [simhash.BLOCK, 150])
def test_near_copies_go_though_an_older_text_shares_a_passage(spark, block):
    rows = []
    for g in range(20):
        words, r = [f"w{g}x{i}" for i in range(120)], random.Random(g)
        texts = [words[:104] + r.sample(words[104:], 16) for _ in range(3)]
        texts.append(texts[2][:-2] + texts[2][:-3:-1])
        rows += [(10 * g + i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {d: set(simhash.shingle_set(t.encode(), 5).tolist()) for d, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(10 * g + 2, 10 * g + 3) and not any(alike(10 * g + a, 10 * g + b) for a in range(3) for b in range(a)) for g in range(20))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert kept == {d for d in sets if d % 10 < 3}


def test_later_copies_are_those_of_all_pairs():
    r = random.Random(11)
    base = [r.sample(range(400), 60) for _ in range(6)]
    sets = [np.array(sorted(set(r.choice(base)[: r.randint(40, 60)]) | set(r.sample(range(400), r.randint(0, 12)))), np.int64) for _ in range(150)] + [np.zeros(0, np.int64)] * 2
    for sides in ([0] * 152, [i % 3 // 2 for i in range(152)]):
        two = len(set(sides)) > 1
        want = [i for i in range(152) if any((not two or sides[i] != sides[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9 for j in range(i))]
        assert simhash.later_copies(sets, sides, 0.8) == want and 5 < len(want) < 147


def test_near_copies_of_large_groups(spark):
    """Recall against all pairs: groups of one to hundreds, with words changed here and there, a block changed, words added."""
    r = random.Random(21)
    rows = []
    for g, size in enumerate([150, 60, 20, *[4] * 20, *[1] * 60]):
        base = [f"g{g}w{r.randint(0, 3000)}" for _ in range(r.choice((80, 200, 400)))]
        for _ in range(size):
            w = list(base)
            for p in r.sample(range(len(w)), r.randint(0, len(w) // 100)):
                w[p] = f"x{r.randint(0, 9999)}"
            at = r.randint(0, len(w) - 5)
            w[at : at + r.randint(0, 4)] = [f"y{r.randint(0, 9999)}" for _ in range(r.randint(0, 3))]
            rows.append(" ".join(w))
    r.shuffle(rows)
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    copies = {i for i in range(len(rows)) if any(alike(i, j) for j in range(i))}
    kept = {x.doc_id for x in simhash.keep_first(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    gone = set(range(len(rows))) - kept
    assert gone <= copies and len(gone) >= 0.95 * len(copies) and len(copies) > 200


def code_length(text, learnt):
    """PPM by the book: orders 3 to 0, method C, escapes added up, eight bits below."""
    import math

    counts = [{} for _ in range(4)]
    for t in learnt:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                c = counts[k].setdefault(b[i - k : i], {})
                c[b[i]] = c.get(b[i], 0) + 1
    b, total = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(b)):
        for k in (3, 2, 1, 0):
            c = counts[k].get(b[i - k : i], {})
            n, d = sum(c.values()), len(c)
            if b[i] in c:
                total += math.log2((n + d) / c[b[i]])
                break
            total += math.log2((n + d) / d) if d else 0
        else:
            total += 8
    return total


def test_code_lengths_by_the_book(spark, monkeypatch):
    r = random.Random(14)
    learnt = {"a": [prose(i, r.randint(0, 60)) for i in range(12)], "b": ["".join(r.choice("xyz é") for _ in range(200)) for _ in range(5)], "c": ["", "q"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in learnt.items() for t in ts)]
    model = langid.learn(spark.createDataFrame([*rows, (99, None, "a"), (98, "zz", None)], "doc_id long, text string, lang string"), F.lit(True))
    texts = ["", "x", prose(3, 40), "xyz xyz é", "ÿ🙂 never seen", "q" * 50, *("".join(r.choice("abcxyzq é\n") for _ in range(r.randint(0, 300))) for _ in range(20))]
    for size in (langid.SLICE, 64):  # texts on both sides of a slice's edge
        monkeypatch.setattr(langid, "SLICE", size)
        got = langid.code_lengths(model, [t.encode() for t in texts])
        for t, bits in zip(texts, got):
            assert bits == pytest.approx([code_length(t, learnt[x]) for x in model.languages], rel=1e-5, abs=1e-3)
    monkeypatch.setattr(langid, "MAX_TABLE", 1000)
    with pytest.raises(ValueError, match="too large"):
        langid.fit({"a": langid.grams(prose(1, 90).encode())})


def test_languages(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in common.documents(spark, d).collect()}
    rows = [r for r in queries.queries()["op10_ppm_langid"](spark, d).collect() if r.held_out and r.lang_pred != "und" and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) > 0.98 * len(rows)


def test_pipeline_by_brute_force(spark):
    """Every stage's rows against all pairs, all windows, the book's code lengths and the tokenizer, on what the stage before it kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    now = common.documents(spark, SF)
    now = now.unionByName(spark.createDataFrame([(9001, "12 345 !?", None, "src1", 9), (9002, "ἀρχὴ σοφίας φόβος " * 9, None, "src1", 162), (9003, None, "en", "src1", 0)], now.schema))
    before, columns = now.collect(), now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.written(stage(spark, now, SF), f"test-{name}")
        kept[name] = now.collect()
        assert name == "token_ids" or now.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)

    learnt = {}
    for r in before:
        if r.text is not None and r.lang is not None:
            learnt.setdefault(r.lang, []).append(r.text)
    counted = {}
    for k, ts in learnt.items():
        n = Counter(g for t in ts for g, c in zip(*(x.tolist() for x in langid.grams(t.encode()))) for _ in range(c))
        counted[k] = (np.array(sorted(n)), np.array([n[g] for g in sorted(n)]))
    model = langid.fit(counted)
    told = []
    for r in before:
        if r.text and re.search(r"[^\W\d_]", r.text):
            bits = langid.code_lengths(model, [r.text.encode()])[0]
            if 1 / sum(2.0 ** -min(x - min(bits), 1000) for x in bits) >= 0.5 and min(bits) <= 6 * len(r.text.encode()):
                told.append(r.doc_id)
    assert ids(kept["language_id"]) == sorted(told) and len(told) <= len(before) - 3

    rows = sorted(kept["language_id"], key=lambda r: r.doc_id)
    sets = [set(simhash.shingle_set(r.text.encode(), 5).tolist()) for r in rows]
    copies = {r.doc_id for i, r in enumerate(rows) if any(rows[j].text == r.text or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in range(i))}
    gone = set(ids(rows)) - set(ids(kept["near_dedup"]))
    assert gone <= copies and len(gone) >= 0.9 * len(copies) > 0

    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    assert ids(kept["decontamination"]) == ids(r for r in kept["near_dedup"] if not hit(r.text))

    count = lambda t: len([x for x in re.split("[\x20\x09-\x0d]+", t or "") if x])
    tokens = {}
    for r in kept["decontamination"]:
        tokens[r.source] = tokens.get(r.source, 0) + count(r.text)
    total = sum(tokens.values())
    shares = {k: v / total for k, v in tokens.items() if v}
    a = next(k / 4096 for k in range(4097) if min(shares.values()) ** (k / 4096 - 1) / sum(p ** (k / 4096) for p in shares.values()) <= 2.0 * (1 + 1e-9))
    z = sum(p**a for p in shares.values())
    want = []
    for k, p in shares.items():
        quota, at, n = int(p**a / z * total + 1e-6), 0, 0
        mine = [r for r in kept["decontamination"] if r.source == k]
        while at < quota:
            for r in sorted(mine, key=lambda r: hashlib.md5(f"7|{n}|{r.doc_id}".encode()).hexdigest()):
                want += [r.doc_id] if at < quota else []
                at += count(r.text)
            n += 1
    assert ids(kept["mix_sources"]) == sorted(want)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    raw = [(r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in sorted(kept["mix_sources"], key=lambda r: r.doc_id)]
    starts = np.cumsum([0, *(len(x) for _, x in raw)]).tolist()
    assert sorted(map(tuple, kept["token_ids"])) == sorted((d, s, len(x), zlib.crc32(x.tobytes())) for (d, x), s in zip(raw, starts))


def test_pipeline_of_odd_rows_and_none(spark, tmp_path):
    """Nulls, empty and repeated rows, a column with a dot; then no rows at all."""
    rows = [(i, prose(i % 20, 60), "en", "a" if i % 2 else None) for i in range(40)] + [(40, None, None, None), (41, "", "en", "a"), (None, prose(50, 60), None, "b"), (1, prose(1, 60), "en", "a"), (1, prose(99, 60), "en", "a"), (42, "12 34", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("a.b", F.lit(1)).withColumn("_times", F.lit(2))
    for part, some in ((docs, True), (docs.limit(0), False)):
        where = str(tmp_path / str(some))
        spark.createDataFrame([(1, prose(3, 12)), (None, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES:
            after = common.written(stage(spark, part, where), f"odd-{name}")
            assert name == "token_ids" or after.columns == docs.columns
            assert (after.count() > 0) == some, name
            part = after


def test_pipeline_runs_and_clears_what_it_leaves(spark):
    import glob

    scratch = common.scratch_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{scratch}/*"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.agg(F.sum("n_tokens")).first()[0] == out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{scratch}/*")) - before} <= {"token-ids", "pipeline-mix_sources"}
