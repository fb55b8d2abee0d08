"""The engine: registered queries against SQL, rules on texts of our own, variants of a text, and agreement of its two forms."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

import lexspark
from lexspark.functions import markers as M
from lexspark.functions import sequence as Q
from lexspark.functions import text as T
from lexspark.operators import lines as L
from lexspark.operators import recover
from lexspark.plans import queries
from lexspark.plans.structure import parse_structure


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, same, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


# text, then numbers expected of each type (all others: none)
GOLDEN = [
    ("CHƯƠNG II\nQUY ĐỊNH\nĐiều 5. Phạm vi\n1. Một\na) Chữ\nb) Chữ\nđ) Chữ\n2. Hai\n2a. Chèn", {"chapter": ["II"], "article": ["5"], "clause": ["1", "2", "2a"], "point": ["a", "b", "đ"]}),
    ("Điều 1. Năm\n2023. Không phải khoản\n1. Đúng\n12.5 triệu đồng\n3. Nhảy", {"article": ["1"], "clause": ["1"]}),
    ("Điều 1. Sửa đổi\n1. Sửa như sau:\n“Điều 9. Trích\n1. Nội dung trích”\n2. Tiếp", {"article": ["1"], "clause": ["1", "2"]}),
    ("Điều 1. Sửa\n1. Như sau:\n“a) Một ‘hai\nb) ba’ bốn\nc) năm”\na) Sáu", {"article": ["1"], "clause": ["1"], "point": ["a"]}),
    ("Điều 1. Nêu\nĐiều 5 của Luật này\nChương trình mục tiêu\n1. Nội dung", {"article": ["1"], "clause": ["1"]}),
    ("Phần thứ nhất\nMục A. Tên\nĐiều thứ 1. Nội dung", {"part": ["thứ nhất"], "section": ["A"], "article": ["thứ 1"]}),
    ("<p>Điều 1. Tên</p><table><tr><td>1.</td><td>ô</td></tr></table><p>1. Khoản</p>", {"article": ["1"], "clause": ["1"]}),
    ("Điều 1. Tên\na. Một\nb. Hai", {"article": ["1"], "point": ["a", "b"]}),
    ("Điều 1. Tên\nk. Riêng", {"article": ["1"]}),
    ("Điều 1. Tên\nKhoản 301. Lớn\nKhoản 2. Vừa\n3) Tiếp", {"article": ["1"], "clause": ["2", "3"]}),
]


def test_golden(spark):
    t = parse_structure(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(GOLDEN)], "doc_id long, content string"))
    found = [{} for _ in GOLDEN]
    for n in sorted(t.nodes.collect(), key=lambda n: n.node_seq):
        if n.node_seq:
            found[n.doc_id].setdefault(n.element_type, []).append(n.number)
    assert found == [want for _, want in GOLDEN]


BASE = "Chương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\n1. Văn bản này nói về nước.\na) Nước mặt;\nb) Nước ngầm;\nđ) Nước mưa.\n2. Không áp dụng cho biển.\nĐiều 2. Từ ngữ\n1. Hồ là nơi chứa nước.\nChương II\nĐIỀU KHOẢN CUỐI\nĐiều 3. Hiệu lực\n1. Theo khoản 1 Điều 2."


def test_noise_in_layout_changes_nothing(spark):
    r = random.Random(8)
    noise = [
        lambda x: x.replace("\n", "\r\n"), lambda x: x.replace(" ", "\xa0", 3), lambda x: x.replace("\n", "\n\n"), lambda x: "\n".join("  " * r.randint(0, 3) + line for line in x.split("\n")),
        lambda x: "\n".join(("## " if line.startswith(("Chương", "Điều")) else "") + line for line in x.split("\n")), lambda x: "\ufeff" + x + " \n\n", lambda x: x.replace("Điều", "ĐIỀU").replace("Chương", "CHƯƠNG"),
        lambda x: "".join("".join(c + "\u200b" if r.random() < 0.02 else c) for c in x), lambda x: "<div>" + x.replace("\n", "</div>\n<div>") + "</div>", lambda x: __import__("unicodedata").normalize("NFD", x), lambda x: x.replace("1. ", "1)  ").replace("2. ", "2)\t"),
    ]
    texts = [BASE]
    for _ in range(200):
        x = BASE
        for f in r.sample(noise, r.randint(1, 3)):
            x = f(x)
        texts.append(x)
    rows = parse_structure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")).nodes.select("doc_id", "node_seq", "element_id").collect()
    ids = [[n.element_id for n in sorted((x for x in rows if x.doc_id == i), key=lambda n: n.node_seq)] for i in range(len(texts))]
    assert len(ids[0]) == 12 and all(x == ids[0] for x in ids)


def test_any_text_parses_with_unique_ids_unless_said(spark):
    r = random.Random(9)
    words = ["Điều 1.", "Điều 2", "Chương I", "Mục A", "Phụ lục I", "của Luật", "1.", "2.", "2a.", "3)", "a)", "b.", "đ)", "Nội dung", ".", ";", ":", "“", "”", '"', "'", "12.5", "5 triệu", "|", "\n", "\n", "Khoản 1.", "TÊN GỌI", "[TABLE]", "\x0b", "é", "<p>", "&lt;p&gt;", "c ủa", "#"]
    texts = ["".join(r.choice(words) + r.choice([" ", ""]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    t = parse_structure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"))
    twice = {(x.doc_id, x.element_id) for x in t.nodes.groupBy("doc_id", "element_id").count().filter("count > 1").collect()}
    assert {d for d, _ in twice} == {x.doc_id for x in t.diagnostics.filter("code = 'duplicate_element_id'").collect()}
    assert t.doc_stats.filter("confidence between 0 and 1").count() == len(texts)
    # the orders of reading: a node's parent comes before it, content is kept once
    assert t.nodes.filter("parent_seq >= node_seq and node_seq > 0").count() == 0


def test_empty_null_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, " \n ", "y"), (None, "Điều 1. A", "z"), (None, "Điều 1. A", "z"), (7, "Điều 1. B", None), (7, "Điều 2. C", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, content string, `a.b` string").withColumn("body", F.lit(1)).withColumn("nodes", F.lit(2))
    t = parse_structure(docs, keep=("a.b",))
    assert sorted((r["a.b"] or "", r.element_id) for r in t.nodes.collect()) == [("", "article-1"), ("q", "article-2"), ("z", "article-1"), ("z", "article-1")]
    assert {(r.doc_id, r.code) for r in t.diagnostics.collect()} == {(1, "empty_input"), (2, "empty_input")}
    assert sorted(r.confidence for r in t.doc_stats.collect()) == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    none = parse_structure(spark.createDataFrame([], "doc_id long, content string"))
    assert none.doc_stats.count() == none.nodes.count() == none.cross_references.count() == 0


def test_recovery():
    # a letter and a full stop read as a point, whatever its case
    assert recover.expand_line("1. A. 2. B. 3. C.") == ["1.", "A.", "2.", "B.", "3.", "C."]
    assert recover.expand_line("1. Chữ này. 2. Chữ kia. 3. Hết.") == ["1. Chữ này.", "2. Chữ kia.", "3. Hết."]
    assert recover.expand_line("1. Năm 2023. 2. Số 5. Hết.") == ["1. Năm 2023.", "2. Số 5. Hết."]
    assert recover.expand_line("[TABLE] 1. A. 2. B.") == ["[TABLE] 1. A. 2. B."]
    assert recover.expand_line("1. Nêu “Điều 2. Trích. 1. Trong.” hết. 2. Sau.") == ["1. Nêu “Điều 2. Trích. 1. Trong.” hết.", "2. Sau."]
    assert recover.split_flat("Chương I QUY ĐỊNH CHUNG Điều 1. Phạm vi 1. Một. 2. Hai: a) X; b) Y.") == ["Chương I QUY ĐỊNH CHUNG", "Điều 1. Phạm vi", "1. Một.", "2. Hai:", "a) X;", "b) Y."]
    assert recover.logical_lines("Một dòng Điều 5 của Luật.")[1] is True and recover.logical_lines("") == ([], False, 0, 0)


def test_both_forms_of_the_grammar_agree(spark):
    """Column expressions and the pass over lines read the same markers, numbers and transitions."""
    r = random.Random(10)
    heads = ["Phần thứ nhất", "CHƯƠNG ii.", "Mục A.", "Tiểu mục 1", "Tiết thứ hai", "Phụ lục số 2", "Phu luc này", "Điều 1.Phạm", "Dieu 12a.", "Khoản 3.", "2a)", "đ1)", "Chương trình", "2023.", "“Điều 5.", "'1.", "a.", "Điểm b)", "x", "", "12", "Điều thứ 7:", "ĐIỀU 9"]
    lines = sorted({(r.choice(["", " ", "“ "]) + h + r.choice(["", " Nội dung", " của Luật", ", khoản 1", " 5 triệu", "| ô"])) for h in heads for _ in range(12)})
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("kind", M.line_kind(F.col("line"))).withColumn("g", M.marker_groups(F.col("kind"), F.col("line"))).withColumn("n", M.canonical_number(F.col("kind"), F.col("g.number")))
    for x in df.collect():
        m = L.read_marker(x.line)
        assert (m and (m.kind, m.number, m.raw_number, m.marker, m.rest)) == (x.kind and (x.kind, x.n, x.g.number, x.g.marker, x.g.rest)), x.line
    numbers = [(n, k) for n in ("1", "12a", "2f", "thứ 1", "a", "đ2", "w", "IV", "iix", "thứ ba", "thu MUOI", "7.", "Đ", "", "0") for k in ("article", "clause", "point", "chapter", "part")]
    for x in spark.createDataFrame(numbers, "n string, k string").withColumn("v", Q.sequence_value(F.col("n"), F.col("k"))).collect():
        assert L.value(x.n, x.k) == (x.v and (x.v.base, x.v.suffix)), (x.n, x.k)
    from lexspark.operators.structure import heading_like

    texts = ["QUY ĐỊNH", "Phạm vi điều chỉnh", "Câu này có dấu chấm.", "", "12 34", "_TÊN_", "a " * 13, "Một: hai", "x" * 181]
    for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.heading_like(F.col("t")).alias("h"), T.slug(F.col("t")).alias("s")).collect():
        assert (heading_like(x.t), L.slug(x.t)) == (x.h, x.s), x.t


def test_normalising_only_where_needed_changes_nothing(spark):
    """The gate before the steps lets every text through that they would change."""
    r = random.Random(12)
    parts = ["a", "Luật", " ", "  ", "\n", "\n\n\n", "\r\n", "\t", "# ", "\n## x", "\ufeff", "\xa0", "c ủa", "C ỦA", "m\nục", "CÔNG BÁO/Số 1", "\n Công  Báo / Số 2\n", "\x0b", "\x0c", "\x85", "\u2028", "."]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 7))) for _ in range(2000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_composed(F.col("t")).alias("gated"), T.normalize_composed(F.concat(F.lit("\r\n"), F.col("t"))).alias("always")).collect()
    assert all(x.gated == x.always for x in got)


def test_both_forms_of_normalising_the_annex_cut_and_references_agree(spark):
    """The pass over documents and the column expressions prepare the same bodies and find the same references."""
    from lexspark.functions.references import cross_references
    from lexspark.operators import normal as N
    from lexspark.operators.prepare import split_annex

    r = random.Random(13)
    parts = ["a", "Luật", " ", "  ", "\n", "\n", "\n\n\n", "\r\n", "\t", "# ", "\n## x", "\ufeff", "\xa0", "c ủa", "C ỦA", "m\nục", "Đi ều", "CÔNG BÁO/Số 1", "\n Công  Báo / Số 2\n", "\x0b", "\x0c", "\x1f", "\x85", "\u2028", ".", "\u0323", "²", "_", "\nPhụ lục I", "\nPHỤ LỤC", "\n“Phụ lục 2", "Phụ lục số 3", "PHỤ LỤC IV (kèm theo)", "ban hành kèm theo", "DANH MỤC", "điểm a khoản 2 Điều 3", "Khoản 4 điều 5a", "Dieu thu 9", " ĐIỀU 7 ", "\x01", '"']
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.normalize_composed(F.col("t")).alias("n"), split_annex(F.col("t")).alias("x"), cross_references(F.col("t")).alias("r"), F.to_json(F.struct("t")).alias("j")).collect()
    for x in got:
        assert N.normalize_composed(x.t) == x.n, x.t
        assert N.references(x.t) == [(f.start, f.end, f.text, f.point, f.clause, f.article) for f in x.r], x.t
        assert f'{{"t":{N.quoted(x.t)}}}' == x.j
        p = N.cut_annex(x.t)
        assert (p and (*p,)) == (x.x.annex and (x.x.main, x.x.annex, x.x.line, x.x.heading, x.x.number)), x.t


def test_a_task_has_one_python_worker_and_its_batches_stay_small(spark):
    """One pass over a document, whatever is asked for, and lists in long documents aren't searched again per heading."""
    import time

    docs = spark.createDataFrame([(1, BASE)], "doc_id long, content string")
    t = parse_structure(docs)
    for df in (t.nodes, t.doc_stats, t.cross_references, t.annex_blocks, lexspark.parse_documents(docs.selectExpr("doc_id", "to_json(struct(content)) AS record"))):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    flat = lambda n: " ".join(f"Điều {i}. Tên. 1. Một. 2. Hai." for i in range(1, n))
    took = []
    for n in (1500, 12000):
        began = time.process_time()
        assert len(recover.split_flat(flat(n))) == 3 * (n - 1)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]  # eight times the text; it took over fifty times as long


def test_records_of_a_file_with_one_group_of_rows_are_dealt_to_all_cores(spark):
    df = queries.queries()["documents"](spark, SF)
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(StructField(document") == 1


def test_marker_columns_decide_a_line_once(spark):
    from lexspark.functions import patterns as P

    df = queries.queries()["marker_columns"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count(P.LINE["part"]) <= 1 + 3  # once for the kind, three times for its groups


def test_what_is_exported():
    assert lexspark.parse_structure is parse_structure and {"parse_documents", "extract_cross_references"} <= set(lexspark.__all__)
    with pytest.raises(AttributeError):
        lexspark.nothing  # noqa: B018
