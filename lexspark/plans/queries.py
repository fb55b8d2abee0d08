"""The engine's registered queries and, where SQL can state them, their SQL.

Whole documents come from two corpora made of the tables (``synth``: many lines, ``casebook``: many shapes); scalar
functions run over columns of the tables.  Expectations are computed from the source rows, without parsing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions import patterns as P
from ..functions import sequence as Q
from ..functions import text as T
from ..functions.references import cross_references
from ..sources import readers, sinks
from . import casebook, synth
from .document import ALIASES, DATES, first_of, parse_documents, record_map, structure_json
from .structure import StructureTables, parse_structure

Query = Callable[[SparkSession, str], DataFrame]

_NODE = ["doc_id", "node_seq", "element_id", "parent_id", "element_type", "number", "title", "raw_text"]


def _table(name: str) -> Query:
    return lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet")


_documents, _pages, _orders, _lineitem, _nation = map(_table, ("documents", "pages", "orders", "lineitem", "nation"))


def _synth(spark: SparkSession, d: str) -> StructureTables:
    return parse_structure(synth.legal_corpus(spark, d))


def _cases(spark: SparkSession, d: str) -> StructureTables:
    return parse_structure(casebook.documents(spark, d), keep=("shape",))


# -- the corpus of many lines -----------------------------------------------------------------


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("nodes", *_NODE[1:])


def _node_counts(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("nodes", "element_type").groupBy("element_type").agg(F.count("*").alias("n"))


def _node_tree(spark: SparkSession, d: str) -> DataFrame:
    """Parents, levels and depths."""
    return _synth(spark, d).rows("nodes", "node_seq", "parent_seq", "level", "depth")


def _node_content(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("nodes", "node_seq", "raw_text", "normalized_text").select("doc_id", "node_seq", F.length("raw_text").alias("chars"), F.sha2("normalized_text", 256).alias("text_sha256"))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("lines", "line_no", "text", "source", "kind").select("doc_id", "line_no", "text", "source", F.col("kind").isNotNull().alias("is_marker"))


def _line_markers(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("lines", "line_no", "kind", "number", "marker", "rest").filter("kind is not null")


def _marker_columns(spark: SparkSession, d: str) -> DataFrame:
    """The same from the column expressions, over exploded lines."""
    lines = _synth(spark, d).prepared.select("doc_id", F.posexplode(T.filled(T.lines(F.col("body")))).alias("pos", "line"))
    # a line's kind is decided once: what is filtered names the array's element, not the expression
    found = lines.select("doc_id", "pos", F.explode(F.array(F.struct("line", M.line_kind(F.col("line")).alias("kind")))).alias("x")).filter("x.kind is not null")
    rows = found.select("doc_id", "pos", "x.kind", M.marker_groups(F.col("x.kind"), F.col("x.line")).alias("g"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), "kind", M.canonical_number(F.col("kind"), F.col("g.number")).alias("number"), "g.marker", "g.rest")


def _quote_state(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("lines", "line_no", "kind", "number", "inside_quote").filter("inside_quote").select("doc_id", "line_no", "kind", "number")


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_synth(spark, d).rows("lines", *_JUDGED).filter("kind is not null")).drop("kind", "number")


_JUDGED = ("line_no", "kind", "number", "accepted", "code", "score", "reasons")


def _judged(lines: DataFrame, *more: str) -> DataFrame:
    return lines.select("doc_id", *more, "line_no", "kind", "number", "accepted", "code", F.coalesce(F.round(F.col("score") * 100).cast("int"), F.lit(-1)).alias("score"), F.array_join("reasons", ",").alias("reasons"))


def _lookahead(spark: SparkSession, d: str) -> DataFrame:
    """The next marker of any kind."""
    return _synth(spark, d).rows("lines", "line_no", "next_marker")


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("diagnostics", "diag_seq", "code", "message", "severity", "line_no")


def _doc_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _synth(spark, d).doc_stats
    count = lambda k: F.coalesce(F.try_element_at("element_counts", F.lit(k)), F.lit(0)).alias(f"n_{k}")
    return s.select("doc_id", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"), "source_content_sha256", "raw_character_count", "main_body_character_count", "annex_character_count", "annex_block_count", "logical_line_count", "flattened_input", "reconstructed_boundary_count", "node_count", *map(count, ("chapter", "article", "clause", "point")), "embedded_marker_count", "cross_reference_count")


def _confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return sinks.low_confidence(_synth(spark, d).doc_stats, 0.95).agg(F.count("*").alias("below"))


def _doc_refs(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).rows("references", "source_element_id", "ref_no", "text", "article", "start", "end")


def _annex_split(spark: SparkSession, d: str) -> DataFrame:
    return _synth(spark, d).annex_blocks.select("doc_id", "number", "heading", "raw_text", "start_line", "parsed")


def _nested_json(spark: SparkSession, d: str) -> DataFrame:
    return structure_json(_synth(spark, d)).select("doc_id", F.length("structure").alias("chars"), F.sha2("structure", 256).alias("structure_sha256"))


def _flat_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Clean documents without noise or annex, their line breaks lost."""
    return parse_structure(synth.flat_corpus(spark, d)).rows("nodes", "element_id", "element_type", "title", "raw_text", "source")


# -- the corpus of many shapes ----------------------------------------------------------------


def _case_nodes(where: str, *columns: str) -> Query:
    return lambda spark, d: _cases(spark, d).rows("nodes", "place", *columns).filter(where).select("doc_id", "place", *columns)


def _case_diagnostics(where: str) -> Query:
    return lambda spark, d: _cases(spark, d).rows("diagnostics", "place", "code", "severity", "line_no").filter(where).select("doc_id", "place", "code", "severity", "line_no")


def _case_decisions(where: str) -> Query:
    """The lines whose decision the casebook states."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        stated = spark.createDataFrame([(i, x[0]) for i, c in enumerate(casebook.CASES) for x in c.decided], "shape int, line_no int")
        return _judged(_cases(spark, d).rows("lines", *_JUDGED).join(F.broadcast(stated), ["shape", "line_no"])).filter(where)

    return run


def _case_refs(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).rows("references", "source_element_id", "text", "point", "clause", "article", "start", "end").drop("shape")


def _case_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _cases(spark, d).doc_stats
    return s.select("doc_id", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"), "source_content_sha256", "raw_character_count", F.col("flattened_input").cast("int").alias("flat"), F.col("reconstructed_boundary_count").alias("made"), F.col("reconstructed_physical_line_count").alias("cut"), "node_count", "embedded_marker_count", "cross_reference_count", "annex_block_count")


def _case_annex(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).annex_blocks.select("doc_id", "number", "heading", "start_line", F.length("raw_text").alias("chars"))


def _repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document twice, under no id and under an id that all share: each is parsed by itself."""
    docs = casebook.documents(spark, d)
    both = docs.withColumn("key", F.col("doc_id")).withColumn("doc_id", F.explode(F.array(F.lit(None), F.lit(7).cast("long"))))
    return parse_structure(both, keep=("key",)).rows("nodes", "element_id", "title", "raw_text")


# -- records ----------------------------------------------------------------------------------

#: fields of a record by the alias that is used: its place is the key modulo the number of aliases
_FIELDS = {**{k: v for k, v in ALIASES.items() if k != "code"}, **{f"date_{k}": v for k, v in DATES.items()}}


def _spread(keys: DataFrame) -> DataFrame:
    """Keys dealt to all cores, before texts are made of them: a file may be a single group of rows, which is a single task."""
    spark = keys.sparkSession
    return keys.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A JSON record per order; which alias holds a field depends on the key, aliases before it are empty."""
    k = F.col("o_orderkey")
    entries = [(F.lit("content"), F.lit("Điều 1. Phạm vi\n1. Nội dung")), (F.lit("keywords"), F.concat(F.lit("k"), k))]
    for field, names in _FIELDS.items():
        value = F.when(k % 5 == 0, "main").when(k % 5 == 1, "legacy").otherwise(F.concat(F.lit("u"), k)) if field == "source_url" else F.concat(F.lit(f"{field}-"), k)
        for i, name in enumerate(names):
            entries.append((F.when(k % len(names) == i, name), value))
            entries.append((F.when((k % len(names) > i) & (k % 3 == 0), name), F.lit("")))
    entries += [(F.when(k % 2 == 0, "jurisdiction"), F.concat(F.lit("J"), k)), (F.when(k % 2 == 1, "language"), F.concat(F.lit("L"), k))]
    pairs = F.filter(F.array(*[F.struct(n.alias("n"), v.cast("string").alias("v")) for n, v in entries]), lambda e: e["n"].isNotNull())
    record = F.to_json(F.map_from_entries(pairs))
    return _spread(_orders(spark, d).select("o_orderkey")).select(k.cast("string").alias("doc_id"), record.alias("record"))


def _alias_coalesce(spark: SparkSession, d: str) -> DataFrame:
    m = record_map(F.col("record"))
    return _records(spark, d).select("doc_id", *[first_of(m, _FIELDS[f]).alias(f) for f in ("document_id", "title", "date_enactment", "date_expiry")])


def _parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    out = parse_documents(_records(spark, d))
    texts = lambda *names: ",".join(f"{n}:string" for n in names)
    plain = ("document_id", "title", "document_type", "document_number", "issuing_authority", "status", "source_url", "jurisdiction", "language")
    document = f"struct<{texts(*plain)},dates:struct<{texts(*DATES)}>,classification:struct<{texts('domain', 'sub_domain')},classification_codes:array<string>>,source_metadata:struct<{texts('keywords', 'content')}>>"
    schema = f"document {document}, parser struct<source_content_sha256:string>, structure array<struct<element_id:string,children:array<struct<title:string>>>>"
    x = out.select("doc_id", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"), F.from_json("json", schema).alias("x"))  # each text is read once
    first, meta = F.get("x.structure", F.lit(0)), "x.document.source_metadata"
    return x.select(
        "doc_id", "confidence", *[f"x.document.{n}" for n in plain], *[f"x.document.classification.{n}" for n in ("domain", "sub_domain")], *[F.col(f"x.document.dates.{k}").alias(f"date_{k}") for k in DATES],
        F.get("x.document.classification.classification_codes", F.lit(0)).alias("code"), F.col(f"{meta}.keywords").alias("metadata_keywords"), F.col(f"{meta}.content").alias("metadata_content"),
        F.col("x.parser.source_content_sha256").alias("content_sha256"), first["element_id"].alias("first_id"), F.get(first["children"], F.lit(0))["title"].alias("first_child"),
    )


# -- sources and sinks ------------------------------------------------------------------------


def _path(spark: SparkSession, name: str) -> str:
    """A new folder where the session keeps what its executors share."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/lexspark"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Parsed documents written as JSONL and read back as records."""
    path = _path(spark, "jsonl")
    sinks.write_jsonl(parse_documents(_records(spark, d)), path, compression="gzip")
    back = readers.read_jsonl(spark, path)
    return back.select(F.get_json_object("record", "$.document.document_id").alias("document_id"), F.get_json_object("record", "$.structure[0].title").alias("title"), F.get_json_object("record", "$.parser.confidence").cast("double").alias("confidence"))


def _files(kind: str, before: str, after: str) -> Query:
    """A file per nation, read as records."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _path(spark, f"files-{kind}")
        rows = _nation(spark, d).select(F.concat(F.lit(before), "n_name", F.lit(after)).alias("value"), F.col("n_nationkey").alias("n"))
        rows.repartition(1).write.partitionBy("n").text(path)
        got = readers.read_records(spark, f"{path}/*/*.txt", suffix=kind)
        return got.select(F.regexp_extract(F.get_json_object("record", "$.source"), r"/n=(\d+)/", 1).cast("int").alias("n"), F.trim(F.get_json_object("record", "$.content")).alias("content"), (F.get_json_object("record", "$.title") == F.col("doc_id")).alias("stem_is_title"))

    return run


def _scan_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of JSON, with blank lines between, read as records."""
    path = _path(spark, "records")
    line = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("language")))
    _documents(spark, d).select(F.explode(F.array(line, F.lit("  "))).alias("value")).write.text(path)
    m = record_map(F.col("record"))
    return readers.read_jsonl(spark, path).select("doc_id", F.length(F.coalesce(F.try_element_at(m, F.lit("content")), F.lit(""))).alias("chars"), F.try_element_at(m, F.lit("language")).alias("language"))


def _scan_json(spark: SparkSession, d: str) -> DataFrame:
    """Per region one file with an array of objects, read as records."""
    path = _path(spark, "arrays")
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    arrays = _nation(spark, d).groupBy("n_regionkey").agg(F.to_json(F.collect_list(item)).alias("value"))
    arrays.repartition("n_regionkey").write.partitionBy("n_regionkey").text(path)
    return readers.read_json(spark, f"{path}/*/*.txt").select(F.col("doc_id").cast("int").alias("n"), F.get_json_object("record", "$.title").alias("title"))


# -- texts ------------------------------------------------------------------------------------


def _looks_like_html(spark: SparkSession, d: str) -> DataFrame:
    both = _pages(spark, d).select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("t")).unionByName(_documents(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t")))
    return both.select("id", T.looks_like_html(F.coalesce("t", F.lit(""))).alias("is_html"))


def _flattened(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return _documents(spark, d).select("doc_id", T.is_flattened(t, T.filled(T.lines(t))).alias("flattened"))


def _text(column: Callable[[Column], Column], out: str = "text", before: str = "") -> Query:
    """A text function over every whole document."""
    return lambda spark, d: _documents(spark, d).select("doc_id", column(F.concat(F.lit(before), F.coalesce("text", F.lit("")))).alias(out))


def _explode_lines(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.filled(T.lines(F.coalesce("text", F.lit("")))))).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text"))


def _heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return _explode_lines(spark, d).select("doc_id", "line_no", T.heading_like(F.col("text")).alias("heading"))


def _normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Clean texts with all that normalising takes away strewn in."""
    marked = F.concat(F.lit("\ufeff## "), F.col("content"), F.lit("\r\n\r\n\r\n\r\nCÔNG BÁO/Số 12\r\n Kết\u200b thúc \t ."))
    return synth.legal_corpus(spark, d).select("doc_id", T.normalize_text(marked).alias("text"))


def _nfc(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their accents taken apart, put together again."""
    apart = F.col("text")
    for whole, parts in (("é", "é"), ("ü", "ü"), ("ñ", "ñ"), ("ê", "ê")):
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    return _documents(spark, d).select("doc_id", F.sha2(T.composed_text(F.coalesce(apart, F.lit(""))), 256).alias("text_sha256"))


def _cue_repair(spark: SparkSession, d: str) -> DataFrame:
    """Split cues in three cases around every document's own text."""
    t = F.coalesce("text", F.lit(""))
    split = F.concat_ws(" ", *[x for a, b in P.SPLIT_CUES for x in (F.lit(f"{a} {b}"), F.lit(f"{a[0].upper()}{a[1:]} \n {b}"), F.lit(f"{a.upper()} {b.upper()}"))])
    return _documents(spark, d).select("doc_id", F.sha2(T.repair_cues(F.concat(t, F.lit(" | "), split, F.lit(" | xc ủa"))), 256).alias("text_sha256"))


def _annex_heading(spark: SparkSession, d: str) -> DataFrame:
    """Whether a line with an annex's keyword starts an annex; what follows the keyword goes by the key."""
    k = F.col("o_orderkey")
    rest = F.element_at(F.array(*map(F.lit, _ANNEX_RESTS)), (k % len(_ANNEX_RESTS) + 1).cast("int"))
    line = F.concat(F.lit("Phụ lục "), (k % 90 + 1).cast("string"), F.lit(" "), F.replace(rest, F.lit("{k}"), k.cast("string")))
    rows = _orders(spark, d).select(k.alias("doc_id"), line.alias("line")).withColumn("g", M.marker_groups(F.lit("annex"), F.col("line")))
    return rows.select("doc_id", F.col("g.number").alias("number"), M.annex_heading(F.lit("annex"), F.col("line"), F.col("g.rest")).alias("heading"))


_ANNEX_RESTS = ["", "(kèm theo {k})", "ban hành kèm theo {k}", "của Luật {k}", "này", "DANH MỤC {k}"]


# -- numbers ----------------------------------------------------------------------------------

_ROMAN_PLACES = [["", "M", "MM", "MMM"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]]


def _numeral(n: Column) -> Column:
    digit = lambda p, unit: F.element_at(F.array(*map(F.lit, p)), (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.concat(*[digit(p, unit) for p, unit in zip(_ROMAN_PLACES, (1000, 100, 10, 1))])


def _roman(spark: SparkSession, d: str) -> DataFrame:
    """Numerals of keys up to 3999, each also spoilt: a numeral with a further I before it or four Is behind."""
    n = F.col("o_orderkey") % 4000
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), _numeral(n).alias("numeral"))
    return rows.select("doc_id", Q.roman(F.col("numeral")).alias("n"), Q.roman(F.lower("numeral")).alias("lower_n"), Q.roman(F.concat("numeral", F.lit("IIII"))).alias("spoilt"), Q.roman(F.concat(F.lit("IM"), "numeral")).alias("led"))


def _sequence_value(spark: SparkSession, d: str) -> DataFrame:
    k, letters = F.col("o_orderkey"), F.array(F.lit(""), *map(F.lit, P.POINT_ORDER), F.lit("f"), F.lit("w"))
    letter = F.element_at(letters, (k % 26 + 1).cast("int"))
    value = lambda n, kind: Q.sequence_value(n, F.lit(kind))
    words = F.element_at(F.array(*map(F.lit, ["nhất", "hai", "ba", "tư", "năm", "sáu", "bảy", "tám", "chín", "mười"])), (k % 10 + 1).cast("int"))
    rows = {
        "article": value(F.concat((k % 10000).cast("string"), letter), "article"), "point": value(F.concat(F.when(letter == "", "a").otherwise(letter), F.when(k % 3 == 0, "").otherwise((k % 7).cast("string"))), "point"),
        "chapter": value(_numeral(k % 4000), "chapter"), "part": value(F.concat(F.lit("thứ "), words), "part"), "section": value(F.concat(k.cast("string"), F.lit(".")), "section"), "dated": value(F.concat(F.lit("thứ "), k.cast("string")), "article"),
    }
    flat = [F.coalesce(v[f], F.lit(-1)).alias(f"{n}_{f}") for n, v in rows.items() for f in ("base", "suffix")]
    return _orders(spark, d).select(k.alias("doc_id"), *flat)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two numbers for every line item: bases near each other, suffixes from none to d."""
    letters = F.array(*map(F.lit, ("", "a", "b", "c", "d", "f")))
    a, b = F.col("l_quantity").cast("long"), F.col("l_partkey")
    number = lambda base, at: F.concat(base.cast("string"), F.element_at(letters, (at % 6 + 1).cast("int")))
    return _lineitem(spark, d).select("l_orderkey", "l_partkey", F.col("l_suppkey"), a.alias("qty"), number(a, b).alias("before"), number(a + b % 4 - 1, F.col("l_suppkey")).alias("now"))


def _transition(spark: SparkSession, d: str) -> DataFrame:
    moved = Q.transition(F.when(F.col("qty") % 10 == 0, F.lit(None)).otherwise(F.col("before")), F.col("now"), F.lit("clause"))
    return _pairs(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "qty", moved.alias("moved")).groupBy("l_orderkey", "l_partkey", "l_suppkey", "qty", "moved").agg(F.count("*").alias("n"))


def _clause_follows(spark: SparkSession, d: str) -> DataFrame:
    follows = Q.clause_follows(F.when(F.col("qty") % 10 == 0, F.lit(None)).otherwise(F.col("before")), F.col("now"))
    return _pairs(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "qty", follows.alias("follows")).groupBy("l_orderkey", "l_partkey", "l_suppkey", "qty", "follows").agg(F.count("*").alias("n"))


def _point_rank(spark: SparkSession, d: str) -> DataFrame:
    letter = F.substring(F.lower("o_orderpriority"), 3, 1)
    return _orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), Q.point_rank(F.element_at(F.array(*map(F.lit, P.POINT_ORDER)), (F.col("o_orderkey") % 23 + 1).cast("int"))).alias("rank"), Q.point_rank(letter).alias("other"), Q.starts_sequence(F.concat((F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("")), F.lit("clause")).alias("starts"))


def _payload(spark: SparkSession, d: str) -> DataFrame:
    """A clause number before a price in several spellings, by the price's own digits."""
    price = F.col("l_extendedprice").cast("long").cast("string")
    k = F.col("l_partkey") % 6
    rest = F.when(k == 0, F.concat(price, F.lit(" đồng"))).when(k == 1, F.concat(F.lit("| "), price)).when(k == 2, F.concat(F.lit("Giá "), price)).when(k == 3, F.concat(price, F.lit("%"))).when(k == 4, F.concat(F.lit("("), price, F.lit(")"))).otherwise(F.concat(F.lit("đồng "), price))
    number = F.when(F.col("l_suppkey") % 4 == 0, "05").otherwise(F.concat(F.col("l_suppkey") % 90 + 1, F.lit("")))
    marker = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("Khoản "), number, F.lit("."))).otherwise(F.concat(number, F.lit(".")))
    return _lineitem(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", M.numeric_payload(F.lit("clause"), number, marker, rest).alias("is_numeric")).groupBy("l_orderkey", "l_partkey", "l_suppkey", "is_numeric").agg(F.count("*").alias("n"))


_CITED = [("Điều {k}", "của Luật", True), ("Điều {k}.", "của Luật", False), ("Điều {k}.", ", khoản 1 Điều 6", True), ("Chương {k}", "QUY ĐỊNH", False), ("Mục {k}", "được quy định tại", True), ("Điều {k}", "và Điều 6", True), ("Điều {k}:", "Theo dõi", False), ("Điều {k}", "; Điều 7", True), ("Phần {k}", "Theo dõi", True)]


def _structural_reference(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in _CITED]), (k % len(_CITED) + 1).cast("int"))
    marker = F.replace(pick(0), F.lit("{k}"), k.cast("string"))
    return _orders(spark, d).select(k.alias("doc_id"), M.structural_reference(F.lit("article"), marker, pick(1)).alias("cited"), M.structural_reference(F.lit("clause"), marker, pick(1)).alias("of_clause"), M.delimiter(marker).alias("delimiter"), M.explicit_keyword(F.lit("clause"), F.concat(F.when(k % 2 == 0, "Khoản ").otherwise(""), k.cast("string"), F.lit("."))).alias("explicit"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Citations behind every document's own text."""
    k = F.col("doc_id").cast("string")
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" theo điểm b khoản 2 Điều "), k, F.lit(", khoản 3a Điều 7; Dieu thu 9 và Điều "), k)
    rows = _documents(spark, d).select("doc_id", F.posexplode(cross_references(t)).alias("pos", "r"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("ref_no"), "r.text", "r.point", "r.clause", "r.article", "r.start", "r.end")


_LINES = r"string_split(regexp_replace(coalesce(text, ''), '\x0B|\x0C|\x1C|\x1D|\x1E|\x{85}|\x{2028}|\x{2029}', chr(10), 'g'), chr(10))"
_FILLED = f"list_filter({_LINES}, lambda x: length(trim(x, ' ' || chr(9) || chr(13))) > 0)"
_REJECT = "CASE what WHEN 'cited' THEN 'structural_reference_kept_as_text' WHEN 'numeric' THEN 'numeric_data_not_clause' WHEN 'dotted' THEN 'ambiguous_dotted_point' END"
_SAID = "SELECT doc_id, line_no, CASE what WHEN 'quoted' THEN 'embedded_quoted_marker' ELSE " + _REJECT + " END AS code, CASE what WHEN 'quoted' THEN 'Kept quoted article marker as content: Điều 9.' ELSE 'Rejected ambiguous marker and kept it as text: ' || CASE what WHEN 'cited' THEN 'Điều 5' WHEN 'numeric' THEN '12.' ELSE 'k.' END END AS message FROM body WHERE what IN ('cited', 'numeric', 'quoted', 'dotted')"
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_NODE_WHERE = {
    "element_ids": "true", "preamble": "element_type = 'preamble'", "heading_titles": "element_type IN ('part', 'chapter', 'section', 'subsection', 'division', 'article')", "point_titles": "element_type IN ('clause', 'point')",
}
_SAID_WHERE = {
    "case_diagnostics": "true", "quoted_markers": "code = 'embedded_quoted_marker'", "annex_refs": "code = 'annex_reference_kept_as_text'", "major_sequence": "code LIKE '%_sequence_%' AND code NOT LIKE 'point%'", "point_sequence": "code LIKE 'point_sequence%'",
    "duplicate_ids": "code = 'duplicate_element_id'", "article_reversal": "code = 'article_number_reversal'", "empty_input": "code = 'empty_input'", "unstructured": "code IN ('no_structural_markers', 'annex_tail_extracted')", "severity_escalation": "severity = 'warning' AND code LIKE '%clause%'",
}
_DECIDED_WHERE = {"case_decisions": "true", "dotted_points": "kind = 'point' AND score IN (88, 35)", "explicit_keywords": "score >= 98", "quoted_lines": "score = -1"}


def queries() -> dict[str, Query]:
    return {
        "nodes": _nodes, "node_counts": _node_counts, "node_tree": _node_tree, "node_content": _node_content, "legal_corpus": synth.legal_corpus, "segments": _segments, "line_markers": _line_markers, "marker_columns": _marker_columns, "quote_state": _quote_state,
        "decisions": _decisions, "lookahead": _lookahead, "diagnostics": _diagnostics, "doc_stats": _doc_stats, "confidence_gate": _confidence_gate, "doc_refs": _doc_refs, "annex_split": _annex_split, "structure_json": _nested_json, "flat_recovery": _flat_recovery,
        **{n: _case_nodes(w, "element_id", "parent_id", "element_type", "number", "depth", "title", "raw_text") for n, w in _NODE_WHERE.items()}, **{n: _case_diagnostics(w) for n, w in _SAID_WHERE.items()}, **{n: _case_decisions(w) for n, w in _DECIDED_WHERE.items()},
        "case_refs": _case_refs, "case_stats": _case_stats, "annex_number": _case_annex, "annex_heading": _annex_heading, "repeated_ids": _repeated_ids,
        "alias_coalesce": _alias_coalesce, "documents": _parsed_documents, "sink_roundtrip": _sink_roundtrip, "scan_text": _files(".txt", "Điều 1. ", ""), "scan_html": _files(".html", "<p>Điều 1. ", "</p><script>x</script>"), "scan_jsonl": _scan_jsonl, "scan_json": _scan_json,
        "looks_like_html": _looks_like_html, "flattened": _flattened, "collapse_ws": _text(T.collapse_ws), "explode_lines": _explode_lines, "normalize_text": _normalize_text, "nfc": _nfc, "content_sha256": _text(lambda c: F.sha2(c, 256), "sha256"), "pdf_cue_repair": _cue_repair,
        "fold_ascii": _text(T.fold_ascii, before="Đất ĐAI "), "slug": _text(T.slug, before="Đất đai "), "heading_like": _heading_lines, "html_to_text": lambda s, d: _pages(s, d).select("page_id", T.html_to_text(F.coalesce("html", F.lit(""))).alias("text")),
        "roman": _roman, "sequence_value": _sequence_value, "transition": _transition, "clause_follows": _clause_follows, "point_rank": _point_rank, "numeric_payload": _payload, "structural_reference": _structural_reference, "cross_refs": _references,
    }


def oracle_sql() -> dict[str, str]:
    n = synth.NODES
    return {
        "nodes": synth.duck("SELECT * FROM nodes", n), "node_counts": synth.duck("SELECT what AS element_type, count(*) AS n FROM body WHERE what IN ('chapter', 'article', 'clause', 'point') GROUP BY what"), "legal_corpus": synth.duck(synth.DUCK),
        "node_tree": synth.duck("""SELECT doc_id, line_no AS node_seq, coalesce(CASE what WHEN 'article' THEN max(CASE what WHEN 'chapter' THEN line_no END) OVER w WHEN 'clause' THEN max(CASE what WHEN 'article' THEN line_no END) OVER w WHEN 'point' THEN max(CASE what WHEN 'clause' THEN line_no END) OVER w END, 0) AS parent_seq,
  CASE what WHEN 'chapter' THEN 1 WHEN 'article' THEN 5 WHEN 'clause' THEN 6 ELSE 7 END AS level, CASE what WHEN 'chapter' THEN 0 WHEN 'article' THEN 1 WHEN 'clause' THEN 2 ELSE 3 END AS depth FROM body WHERE what IN ('chapter', 'article', 'clause', 'point') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"""),
        "node_content": synth.duck(r"SELECT doc_id, node_seq, length(raw_text) AS chars, sha256(regexp_replace(raw_text, '\s+', ' ', 'g')) AS text_sha256 FROM nodes", n),
        "segments": synth.duck("SELECT doc_id, line_no, text, 'line' AS source, what <> 'title' AS is_marker FROM body"),
        "line_markers": synth.duck(synth.MARKERS), "marker_columns": synth.duck(synth.MARKERS),
        "quote_state": synth.duck("SELECT doc_id, line_no, 'article' AS kind, '9' AS number FROM body WHERE what = 'quoted'"),
        "decisions": synth.duck(f"""SELECT doc_id, line_no, what IN ('chapter', 'article', 'clause', 'point') AS accepted, {_REJECT} AS code,
  CASE what WHEN 'cited' THEN 5 WHEN 'numeric' THEN 2 WHEN 'dotted' THEN 35 WHEN 'chapter' THEN 98 WHEN 'article' THEN 98 WHEN 'clause' THEN 93 WHEN 'point' THEN 96 ELSE -1 END AS score,
  CASE what WHEN 'cited' THEN 'reference_lexical_cue' WHEN 'numeric' THEN 'numeric_payload_shape' WHEN 'dotted' THEN 'isolated_bare_letter_dot' WHEN 'clause' THEN 'valid_bare_clause_sequence' WHEN 'point' THEN 'canonical_point_parenthesis' WHEN 'quoted' THEN '' ELSE 'explicit_major_keyword' END AS reasons FROM body WHERE what <> 'title'"""),
        "lookahead": synth.duck("""SELECT doc_id, line_no, first_value(CASE WHEN what <> 'title' THEN (CASE what WHEN 'cited' THEN 'article 5' WHEN 'numeric' THEN 'clause 12' WHEN 'quoted' THEN 'article 9' WHEN 'dotted' THEN 'point k' ELSE what || ' ' || number END) END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_marker FROM body"""),
        "diagnostics": synth.duck(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT AS diag_seq, code, message, 'info' AS severity, line_no FROM ({_SAID})"),
        "doc_stats": synth.duck(f"""SELECT d.doc_id, greatest(0, 1000 - 5 * (SELECT count(*) FROM ({_SAID}) s WHERE s.doc_id = d.doc_id) - least(200, 5 * count(*) FILTER (what = 'quoted')))::INT AS confidence,
  sha256(string_agg(text, chr(10) ORDER BY art, k, sub)) AS source_content_sha256, length(string_agg(text, chr(10) ORDER BY art, k, sub)) AS raw_character_count, length(string_agg(text, chr(10) ORDER BY art, k, sub) FILTER (what <> 'annex')) AS main_body_character_count,
  coalesce(length(string_agg(text, chr(10) ORDER BY art, k, sub) FILTER (what = 'annex')), 0) AS annex_character_count, (count(*) FILTER (what = 'annex') > 0)::INT AS annex_block_count, count(*) FILTER (what <> 'annex') AS logical_line_count, false AS flattened_input, 0 AS reconstructed_boundary_count,
  count(*) FILTER (what IN ('chapter', 'article', 'clause', 'point')) AS node_count, count(*) FILTER (what = 'chapter') AS n_chapter, count(*) FILTER (what = 'article') AS n_article, count(*) FILTER (what = 'clause') AS n_clause, count(*) FILTER (what = 'point') AS n_point,
  count(*) FILTER (what = 'quoted') AS embedded_marker_count, count(*) FILTER (what IN ('clause', 'cited', 'quoted')) AS cross_reference_count FROM lines l JOIN d USING (doc_id) GROUP BY d.doc_id"""),
        "confidence_gate": synth.duck(f"SELECT count(*) AS below FROM (SELECT d.doc_id, 1000 - 5 * (SELECT count(*) FROM ({_SAID}) s WHERE s.doc_id = d.doc_id) - least(200, 5 * (SELECT count(*) FROM body b WHERE b.doc_id = d.doc_id AND what = 'quoted')) AS c FROM d) WHERE c < 950"),
        "doc_refs": synth.duck(r"""SELECT doc_id, element_id AS source_element_id, i::INT AS ref_no, m[i] AS text, m[i][6:] AS article, (list_sum(list_transform(p[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::INT AS start, (list_sum(list_transform(p[1 : i], lambda x: length(x))) + list_sum(list_transform(m[1 : i], lambda x: length(x))))::INT AS "end"
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, element_id, regexp_extract_all(t, 'Điều [0-9]+') AS m, regexp_split_to_array(t, 'Điều [0-9]+') AS p FROM (SELECT doc_id, element_id, title || ' ' || replace(raw_text, chr(10), ' ') AS t FROM nodes)))""", n),
        "annex_split": synth.duck("SELECT doc_id, 'I' AS number, 'PHỤ LỤC I' AS heading, 'PHỤ LỤC I' || chr(10) || '1. Biểu mẫu đơn' AS raw_text, (SELECT max(line_no) + 1 FROM body b WHERE b.doc_id = d.doc_id)::INT AS start_line, false AS parsed FROM d WHERE doc_id % 7 = 0"),
        "structure_json": synth.duck("SELECT doc_id, length(j) AS chars, sha256(j) AS structure_sha256 FROM tree", n + synth.JSON),
        "flat_recovery": synth.duck("SELECT doc_id, element_id, what AS element_type, title, raw_text, 'inline_fallback' AS source FROM flat_nodes", synth.FLAT + synth.FLAT_NODES),
        **_case_sql(),
        **_text_sql(),
        **_number_sql(),
    }


def _case_sql() -> dict[str, str]:
    k, rows = casebook.K, casebook.ROWS
    node = f"""SELECT k AS doc_id, place, {k('path')} AS element_id, CASE WHEN contains(path, '/') THEN regexp_replace({k('path')}, '/[^/]*$', '') END AS parent_id, regexp_extract(path, '([a-z]+)(-[^/]*)?$', 1) AS element_type, number, length(path) - length(replace(path, '/', '')) AS depth, {k('title')} AS title, {k('content')} AS raw_text
  FROM o JOIN {casebook.expected('nodes', 'path, number, title, content')} e USING (shape)"""
    said = f"SELECT k AS doc_id, place, code, severity, line_no FROM o JOIN {casebook.expected('said', 'code, severity, line_no')} e USING (shape)"
    decided = f"SELECT k AS doc_id, line_no, kind, number, score >= 88 AS accepted, nullif(code, '') AS code, score, reasons FROM o JOIN {casebook.expected('decided', 'line_no, kind, number, code, score, reasons')} e USING (shape)"
    refs = f"""SELECT k AS doc_id, source AS source_element_id, {k('txt')} AS text, point, clause, {k('article')} AS article, strpos(t, {k('txt')}) - 1 AS start, strpos(t, {k('txt')}) - 1 + length({k('txt')}) AS "end"
  FROM (SELECT o.k, r.*, concat_ws(' ', nullif({k('n.title')}, ''), nullif(replace({k('n.content')}, chr(10), ' '), '')) AS t FROM o JOIN {casebook.expected('refs', 'source, txt, point, clause, article')} r USING (shape) JOIN {casebook.expected('nodes', 'path, number, title, content')} n ON n.shape = o.shape AND n.path = r.source)"""
    layout = casebook.values([(i, c.text, *c.layout, len(c.nodes), len(c.refs), int(c.annex is not None), sum(s[0] == "embedded_quoted_marker" for s in c.said), *(sum(s[1] == v for s in c.said) for v in ("error", "warning", "info")), int(any(s[0] == "empty_input" for s in c.said))) for i, c in enumerate(casebook.CASES)], "shape, txt, flat, made, cut, nodes, refs, annex, quoted, e, w, i, nothing")
    stats = f"""SELECT k AS doc_id, CASE WHEN nothing = 1 THEN 0 ELSE 1000 - CASE WHEN flat = 1 THEN 80 ELSE least(60, 5 * made) END - least(200, 5 * quoted) - 180 * e - 40 * w - 5 * i END AS confidence, sha256({k('txt')}) AS source_content_sha256, length({k('txt')}) AS raw_character_count, flat, made, cut, nodes AS node_count, quoted AS embedded_marker_count, refs AS cross_reference_count, annex AS annex_block_count FROM o JOIN {layout} e USING (shape)"""
    annex = casebook.values([(i, *c.annex, c.text.replace("\r", "").split("\n", c.annex[2] - 1)[-1]) for i, c in enumerate(casebook.CASES) if c.annex], "shape, number, heading, start_line, txt")
    with_o = lambda sql: f"WITH {rows} {sql}"
    return {
        **{n: with_o(f"SELECT * FROM ({node}) WHERE {w}") for n, w in _NODE_WHERE.items()}, **{n: with_o(f"SELECT * FROM ({said}) WHERE {w}") for n, w in _SAID_WHERE.items()}, **{n: with_o(f"SELECT * FROM ({decided}) WHERE {w}") for n, w in _DECIDED_WHERE.items()},
        "case_refs": with_o(refs), "case_stats": with_o(stats), "annex_number": with_o(f"SELECT k AS doc_id, number, {k('heading')} AS heading, start_line, length({k('txt')}) AS chars FROM o JOIN {annex} e USING (shape)"),
        "repeated_ids": with_o(f"SELECT v.doc_id, n.doc_id AS key, element_id, title, raw_text FROM ({node}) n, (SELECT NULL::BIGINT AS doc_id UNION ALL SELECT 7) v"),
    }


def _record_sql() -> dict[str, str]:
    key = lambda f: f"'{f}-' || o_orderkey"
    plain = {f: key(f) for f in ("document_id", "title", "document_type", "document_number", "issuing_authority", "status", "domain", "sub_domain", *(f"date_{x}" for x in DATES))}
    plain |= {
        "source_url": "CASE WHEN o_orderkey % 5 < 2 THEN '' ELSE 'u' || o_orderkey END", "jurisdiction": "CASE WHEN o_orderkey % 2 = 0 THEN 'J' || o_orderkey ELSE 'Vietnam' END", "language": "CASE WHEN o_orderkey % 2 = 1 THEN 'L' || o_orderkey ELSE 'vi' END",
        "code": "CASE WHEN o_orderkey % 3 < 2 THEN 'document_number-' || o_orderkey END", "metadata_keywords": "'k' || o_orderkey", "metadata_content": "NULL", "content_sha256": "sha256('Điều 1. Phạm vi' || chr(10) || '1. Nội dung')", "first_id": "'article-1'", "first_child": "'Khoản 1'",
    }
    chosen = lambda names: ", ".join(f"{plain[f]} AS {f}" for f in names)
    return {
        "alias_coalesce": f"SELECT o_orderkey::VARCHAR AS doc_id, {chosen(('document_id', 'title', 'date_enactment', 'date_expiry'))} FROM orders",
        "documents": f"SELECT o_orderkey::VARCHAR AS doc_id, 1000 AS confidence, {chosen(plain)} FROM orders",
        "sink_roundtrip": "SELECT 'document_id-' || o_orderkey AS document_id, 'Phạm vi' AS title, 1.0::DOUBLE AS confidence FROM orders",
        "scan_text": "SELECT n_nationkey AS n, 'Điều 1. ' || n_name || chr(10) AS content, true AS stem_is_title FROM nation", "scan_html": "SELECT n_nationkey AS n, chr(10) || 'Điều 1. ' || n_name || chr(10) || chr(10) AS content, true AS stem_is_title FROM nation",
        "scan_jsonl": "SELECT doc_id::VARCHAR AS doc_id, length(coalesce(text, '')) AS chars, lang AS language FROM documents", "scan_json": "SELECT n_nationkey AS n, n_name AS title FROM nation",
    }


def _text_sql() -> dict[str, str]:
    cues = [x for a, b in P.SPLIT_CUES for x in (a + b, a[0].upper() + a[1:] + b, (a + b).upper())]
    headings = f"SELECT doc_id, unnest(range(1, len(f) + 1))::INT AS line_no, unnest(f) AS line FROM (SELECT doc_id, {_FILLED} AS f FROM documents)"
    # block tags break lines, what is not shown goes, other tags vanish, references are decoded
    tags = "address|article|aside|blockquote|br|div|dl|dt|dd|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
    html = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '</?({tags})(\s[^>]*)?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
    for _ in range(2):
        for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
            html = f"replace({html}, '{name}', '{char}')"
    return {
        **_record_sql(),
        "looks_like_html": r"SELECT id, regexp_matches(lower(substring(t, 1, 4096)), '<(html|body|div|p|table|br|span|h[1-6])\b') AS is_html FROM (SELECT 'p' || page_id AS id, coalesce(html, '') AS t FROM pages UNION ALL SELECT 'd' || doc_id, coalesce(text, '') FROM documents)",
        "flattened": f"SELECT doc_id, coalesce(len(f) > 0 AND ((len(f) = 1 AND length(text) >= 120) OR (len(f) <= 3 AND length(text) >= 250) OR list_max(list_transform(f, lambda x: length(x))) >= 500 OR list_sum(list_transform(f, lambda x: length(x))) >= 300 * len(f)), false) AS flattened FROM (SELECT doc_id, text, {_FILLED} AS f FROM documents)",
        "collapse_ws": rf"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text FROM documents",
        "explode_lines": f"SELECT doc_id, unnest(range(1, len(f) + 1))::INT AS line_no, unnest(f) AS text FROM (SELECT doc_id, {_FILLED} AS f FROM documents)",
        "normalize_text": synth.duck("SELECT doc_id, string_agg(text, chr(10) ORDER BY art, k, sub) || chr(10) || chr(10) || 'Kết thúc .' AS text FROM lines GROUP BY doc_id"),
        "nfc": "SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS text_sha256 FROM documents",
        "content_sha256": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "pdf_cue_repair": f"SELECT doc_id, sha256(coalesce(text, '') || ' | {' '.join(cues)} | xc ủa') AS text_sha256 FROM documents",
        "fold_ascii": "SELECT doc_id, replace(lower(strip_accents('Đất ĐAI ' || coalesce(text, ''))), 'đ', 'd') AS text FROM documents",
        "slug": "SELECT doc_id, trim(regexp_replace('DDat ddai ' || strip_accents(coalesce(text, '')), '[^A-Za-z0-9]+', '-', 'g'), '-') AS text FROM documents",
        "heading_like": rf"SELECT doc_id, line_no, length(v) BETWEEN 1 AND 180 AND a > 0 AND (u * 5 >= a * 4 OR (w <= 12 AND NOT regexp_matches(v, '[.!?;:]\n?$'))) AS heading FROM (SELECT *, length(v) - length(regexp_replace(v, '\p{{L}}', '', 'g')) AS a, length(v) - length(regexp_replace(v, '\p{{Lu}}', '', 'g')) AS u, len(regexp_extract_all(v, '[^\s]+')) AS w FROM (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '^[_-]+|[_-]+$', '', 'g') AS v FROM ({headings})))",
        "html_to_text": f"SELECT page_id, {html} AS text FROM pages",
        "annex_heading": f"SELECT o_orderkey AS doc_id, (o_orderkey % 90 + 1)::VARCHAR AS number, (o_orderkey % {len(_ANNEX_RESTS)})::INT IN (0, 1) AS heading FROM orders",
        "cross_refs": """WITH t AS (SELECT doc_id, doc_id::VARCHAR AS k, coalesce(text, '') || ' theo ' AS head FROM documents),
r AS (SELECT t.*, unnest([1, 2, 3, 4]) AS ref_no, unnest([0, 2, 4, 4 + 3]) AS gap, unnest(['điểm b khoản 2 Điều ' || k, 'khoản 3a Điều 7', 'Dieu thu 9', 'Điều ' || k]) AS txt, unnest(['b', NULL, NULL, NULL]) AS point, unnest(['2', '3a', NULL, NULL]) AS clause, unnest([k, '7', 'thu 9', k]) AS article FROM t)
SELECT doc_id, ref_no, txt AS text, point, clause, article, s AS start, s + length(txt) AS "end" FROM (SELECT *, (length(head) + CASE ref_no WHEN 1 THEN 0 WHEN 2 THEN 20 + length(k) + 2 WHEN 3 THEN 20 + length(k) + 2 + 15 + 2 ELSE 20 + length(k) + 2 + 15 + 2 + 10 + 4 END)::INT AS s FROM r)""",
    }


def _number_sql() -> dict[str, str]:
    order = P.POINT_ORDER

    rank = lambda x: f"strpos('{order}', {x})"

    pair = f"""SELECT l_orderkey, l_partkey, l_suppkey, qty, qty % 10 = 0 AS first, qty AS bb, l_partkey % 6 AS bs, qty + l_partkey % 4 - 1 AS nb, l_suppkey % 6 AS ns FROM (SELECT *, l_quantity::BIGINT AS qty FROM lineitem)"""

    moved = "CASE WHEN ns = 5 THEN 'unknown' WHEN first THEN 'first' WHEN bs = 5 THEN 'unknown' WHEN nb = bb THEN CASE WHEN ns = bs THEN 'same' WHEN ns = bs + 1 THEN 'suffix_next' WHEN ns < bs THEN 'backward' ELSE 'jump' END WHEN nb = bb + 1 AND ns = 0 THEN 'next' WHEN nb < bb THEN 'backward' ELSE 'jump' END"
    follows = "CASE WHEN first THEN nb = 1 AND ns = 0 WHEN nb = bb THEN ns BETWEEN 1 AND 4 AND bs <= 4 AND ns = bs + 1 ELSE nb = bb + 1 AND ns = 0 END"
    grouped = lambda out, name: f"SELECT l_orderkey, l_partkey, l_suppkey, qty, {out} AS {name}, count(*) AS n FROM ({pair}) GROUP BY ALL"
    k = "o_orderkey"
    cited = casebook.values([(i, int(c), m[-1] if m[-1] in ".:" else "") for i, (m, _, c) in enumerate(_CITED)], "i, cited, delimiter")
    return {
        "roman": f"SELECT {k} AS doc_id, CASE WHEN n > 0 THEN n END AS n, CASE WHEN n > 0 THEN n END AS lower_n, NULL::INT AS spoilt, NULL::INT AS led FROM (SELECT {k}, ({k} % 4000)::INT AS n FROM orders)",
        "sequence_value": f"""SELECT {k} AS doc_id, CASE WHEN i > 23 THEN -1 ELSE {k} % 10000 END AS article_base, CASE WHEN i > 23 THEN -1 ELSE i END AS article_suffix,
  CASE WHEN i > 23 THEN -1 ELSE greatest(i, 1) END AS point_base, CASE WHEN i > 23 THEN -1 WHEN {k} % 3 = 0 THEN 0 ELSE {k} % 7 END AS point_suffix, CASE WHEN {k} % 4000 = 0 THEN -1 ELSE {k} % 4000 END AS chapter_base, CASE WHEN {k} % 4000 = 0 THEN -1 ELSE 0 END AS chapter_suffix,
  {k} % 10 + 1 AS part_base, 0 AS part_suffix, {k} AS section_base, 0 AS section_suffix, -1 AS dated_base, -1 AS dated_suffix FROM (SELECT *, {k} % 26 AS i FROM orders)""",
        "transition": grouped(moved, "moved"), "clause_follows": grouped(follows, "follows"),
        "point_rank": f"SELECT {k} AS doc_id, {k} % 23 + 1 AS rank, {rank('substring(lower(o_orderpriority), 3, 1)')} * (substring(lower(o_orderpriority), 3, 1) <> '')::INT AS other, {k} % 3 = 1 AND {k} % 2 = 1 AS starts FROM orders",
        "numeric_payload": "SELECT l_orderkey, l_partkey, l_suppkey, l_suppkey % 3 <> 0 AND (l_suppkey % 4 = 0 OR l_partkey % 6 IN (0, 1, 3)) AS is_numeric, count(*) AS n FROM lineitem GROUP BY ALL",
        "structural_reference": f"SELECT {k} AS doc_id, cited = 1 AS cited, false AS of_clause, delimiter, {k} % 2 = 0 AS explicit FROM orders JOIN {cited} c ON c.i = {k} % {len(_CITED)}",
    }
