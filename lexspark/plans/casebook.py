"""A second corpus: one document per order, its shape chosen by the order's key, its words holding the key.

``CASES`` are shapes that the corpus of ``synth`` doesn't have.  Beside each stands what parsing must give, from the rules of the
grammar; ``{k}`` is the order's key in texts and expectations alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Case:
    text: str
    #: (path id, number, title, content) of every node
    nodes: list[tuple[str, str, str, str]]
    #: (line, kind, number, code of a rejection or "", score in hundredths, reasons) of lines whose decision is of interest
    decided: list[tuple[int, str, str, str, int, str]] = field(default_factory=list)
    #: (code, severity, line) of all diagnostics in order
    said: list[tuple[str, str, int | None]] = field(default_factory=list)
    #: (node, text of a reference, point, clause, article)
    refs: list[tuple[str, str, str | None, str | None, str]] = field(default_factory=list)
    layout: tuple[int, int, int] = (0, 0, 0)  # flat, boundaries made, lines cut
    annex: tuple[str, str, int] | None = None  # number, heading, line


_FIRST = ("article-1", "1", "A {k}", "")
_ONE = ("article-1/clause-1", "1", "Khoản 1", "Một")

CASES = [
    Case(
        "Phần thứ nhất. Tên {k}\nChương IV: Tên {k}\nMục 2. Tên {k}\nTiểu mục B. Tên {k}\nTiết 3- Tên {k}\nĐiều 12a. Tên {k}\n1. Nội dung {k}\nđ1) Chữ {k}",
        [
            ("part-thu-nhat", "thứ nhất", "Tên {k}", ""), ("part-thu-nhat/chapter-IV", "IV", "Tên {k}", ""), ("part-thu-nhat/chapter-IV/section-2", "2", "Tên {k}", ""),
            ("part-thu-nhat/chapter-IV/section-2/subsection-B", "B", "Tên {k}", ""), ("part-thu-nhat/chapter-IV/section-2/subsection-B/division-3", "3", "Tên {k}", ""),
            ("part-thu-nhat/chapter-IV/section-2/subsection-B/division-3/article-12a", "12a", "Tên {k}", ""), ("part-thu-nhat/chapter-IV/section-2/subsection-B/division-3/article-12a/clause-1", "1", "Khoản 1", "Nội dung {k}"),
            ("part-thu-nhat/chapter-IV/section-2/subsection-B/division-3/article-12a/clause-1/point-dd1", "đ1", "Điểm đ1", "Chữ {k}"),
        ],
        [(1, "part", "thứ nhất", "", 98, "explicit_major_keyword"), (4, "subsection", "B", "", 98, "explicit_major_keyword"), (5, "division", "3", "", 98, "explicit_major_keyword")],
    ),
    Case(
        "Phan THU HAI\nTEN {k}\nchuong ii\nTEN {k}\nMuc a. Ten {k}\nDieu 3. Ten {k}\nKhoan 1. Noi dung\nDiem a) Chu {k}",
        [
            ("part-thu-hai", "thu hai", "TEN {k}", ""), ("part-thu-hai/chapter-II", "II", "TEN {k}", ""), ("part-thu-hai/chapter-II/section-A", "A", "Ten {k}", ""), ("part-thu-hai/chapter-II/section-A/article-3", "3", "Ten {k}", ""),
            ("part-thu-hai/chapter-II/section-A/article-3/clause-1", "1", "Khoản 1", "Noi dung"), ("part-thu-hai/chapter-II/section-A/article-3/clause-1/point-a", "a", "Điểm a", "Chu {k}"),
        ],
        [(7, "clause", "1", "", 98, "explicit_clause_keyword"), (8, "point", "a", "", 99, "explicit_point_keyword")],
    ),
    Case(
        "Điều 1. A {k}\n1. Như sau:\n“Điều 9. Trích {k}\n1. Trong\na) Trong”\n2. Sau",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Như sau:\n“Điều 9. Trích {k}\n1. Trong\na) Trong”"), ("article-1/clause-2", "2", "Khoản 2", "Sau")],
        [(3, "article", "9", "", -1, ""), (4, "clause", "1", "", -1, ""), (5, "point", "a", "", -1, ""), (6, "clause", "2", "", 93, "valid_bare_clause_sequence")],
        [("embedded_quoted_marker", "info", 3), ("embedded_quoted_marker", "info", 4), ("embedded_quoted_marker", "info", 5)],
        [("article-1/clause-1", "Điều 9", None, None, "9")],
    ),
    Case(
        "Điều 1. A {k}\na. Một\nb. Hai\nc. Ba",
        [_FIRST, ("article-1/point-a", "a", "Điểm a", "Một"), ("article-1/point-b", "b", "Điểm b", "Hai"), ("article-1/point-c", "c", "Điểm c", "Ba")],
        [(2, "point", "a", "", 88, "starts_point_sequence:next,ambiguous_dot_resolved_by_sequence"), (3, "point", "b", "", 88, "continues_point_sequence:next,ambiguous_dot_resolved_by_sequence"), (4, "point", "c", "", 88, "continues_point_sequence:next,ambiguous_dot_resolved_by_sequence")],
    ),
    Case(
        "Điều 1. A {k}\nĐiều 1. B {k}\n1. Một\n1. Lại",
        [_FIRST, ("article-1-2", "1", "B {k}", ""), ("article-1-2/clause-1", "1", "Khoản 1", "Một\n1. Lại")],
        [(4, "clause", "1", "nonsequential_bare_clause", 20, "clause_sequence:same")],
        [("article_sequence_same", "warning", 2), ("nonsequential_bare_clause", "info", 4)],
    ),
    Case(
        "Phần thứ nhất\nA {k}\nPhần thứ nhất\nB {k}\nPhần thứ nhất/2\nC {k}",
        [("part-thu-nhat", "thứ nhất", "A {k}", ""), ("part-thu-nhat-2", "thứ nhất", "B {k}", ""), ("part-thu-nhat-2", "thứ nhất/2", "C {k}", "")],
        [], [("part_sequence_same", "warning", 3), ("duplicate_element_id", "error", None)],
    ),
    Case(
        "Điều 1. A {k}\n1. Một\nPhụ lục I ban hành kèm theo {k}\n2. Hai",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Một\nPhụ lục I ban hành kèm theo {k}"), ("article-1/clause-2", "2", "Khoản 2", "Hai")],
        [(3, "annex", "I", "", 98, "explicit_major_keyword")], [("annex_reference_kept_as_text", "info", 3)],
    ),
    Case("Điều 1. A {k}\nPHỤ LỤC\nDANH MỤC {k}\nPHỤ LỤC III\n1. X", [_FIRST], annex=("III", "PHỤ LỤC", 2)),
    Case("Điều 1. A {k}\n1. Một\nPhụ lục số 2 (kèm theo {k})\n2. Hai", [_FIRST, _ONE], annex=("2", "Phụ lục số 2 (kèm theo {k})", 3)),
    Case("PHỤ LỤC IV\nDANH MỤC {k}", [], said=[("annex_tail_extracted", "info", None)], annex=("IV", "PHỤ LỤC IV", 1)),
    Case(
        "Chương I\nTÊN {k}\n1. Trước\na) Trước\nĐiều 1. A {k}",
        [("chapter-I", "I", "TÊN {k}", "1. Trước\na) Trước"), ("chapter-I/article-1", "1", "A {k}", "")],
        [(3, "clause", "1", "clause_without_article", 5, "no_article_scope"), (4, "point", "a", "point_without_article", 5, "no_article_scope")],
        [("clause_without_article", "info", 3), ("point_without_article", "info", 4)],
    ),
    Case(
        "Điều 1. A {k}\n3. Ba\n301. Số\n1. Một\n3. Ba\n2. Hai\n1. Lại",
        [("article-1", "1", "A {k}", "3. Ba\n301. Số"), ("article-1/clause-1", "1", "Khoản 1", "Một\n3. Ba"), ("article-1/clause-2", "2", "Khoản 2", "Hai\n1. Lại")],
        [(2, "clause", "3", "noninitial_bare_clause", 20, "bare_clause_does_not_start_at_1"), (3, "clause", "301", "implausible_clause_number", 5, "clause_number_gt_300"), (5, "clause", "3", "nonsequential_bare_clause", 20, "clause_sequence:jump"), (7, "clause", "1", "nonsequential_bare_clause", 20, "clause_sequence:backward")],
        [("noninitial_bare_clause", "info", 2), ("implausible_clause_number", "info", 3), ("nonsequential_bare_clause", "info", 5), ("nonsequential_bare_clause", "info", 7)],
    ),
    Case(
        "Điều 1. A {k}\nKhoản 5. Năm\n6. Sáu\nĐiểm c) Chữ {k}\nd) Chữ",
        [_FIRST, ("article-1/clause-5", "5", "Khoản 5", "Năm"), ("article-1/clause-6", "6", "Khoản 6", "Sáu"), ("article-1/clause-6/point-c", "c", "Điểm c", "Chữ {k}"), ("article-1/clause-6/point-d", "d", "Điểm d", "Chữ")],
        [(2, "clause", "5", "", 98, "explicit_clause_keyword"), (3, "clause", "6", "", 93, "valid_bare_clause_sequence"), (4, "point", "c", "", 99, "explicit_point_keyword"), (5, "point", "d", "", 96, "canonical_point_parenthesis")],
    ),
    Case(
        "Điều 1. A {k}\n1. Một\nk. Riêng {k}",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Một\nk. Riêng {k}")],
        [(3, "point", "k", "ambiguous_dotted_point", 35, "isolated_bare_letter_dot")], [("ambiguous_dotted_point", "info", 3)],
    ),
    Case(
        "Điều 1. A {k}\nĐiều 5 của Luật {k}\nĐiều 7, khoản 2 và {k}\nChương II được quy định tại {k}\n1. Một",
        [("article-1", "1", "A {k}", "Điều 5 của Luật {k}\nĐiều 7, khoản 2 và {k}\nChương II được quy định tại {k}"), _ONE],
        [(2, "article", "5", "structural_reference_kept_as_text", 5, "reference_lexical_cue"), (3, "article", "7", "structural_reference_kept_as_text", 5, "reference_lexical_cue"), (4, "chapter", "II", "structural_reference_kept_as_text", 5, "reference_lexical_cue")],
        [("structural_reference_kept_as_text", "info", n) for n in (2, 3, 4)],
        [("article-1", "Điều 5", None, None, "5"), ("article-1", "Điều 7", None, None, "7")],
    ),
    Case(
        "Điều 1. A {k}\n1. Một\n2.5 triệu đồng {k}\n2. | ô | {k}\n02. Ngày\n15. 20% của {k}\n2. Hai",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Một\n2.5 triệu đồng {k}\n2. | ô | {k}\n02. Ngày\n15. 20% của {k}"), ("article-1/clause-2", "2", "Khoản 2", "Hai")],
        [(n, "clause", x, "numeric_data_not_clause", 2, "numeric_payload_shape") for n, x in ((3, "2"), (4, "2"), (5, "02"), (6, "15"))],
        [("numeric_data_not_clause", "info", n) for n in (3, 4, 5, 6)],
    ),
    Case(
        "Điều 1. A {k}\n1. Một {k} chữ. 5. Năm chữ.\n2. Hai",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Một {k} chữ.\n5. Năm chữ."), ("article-1/clause-2", "2", "Khoản 2", "Hai")],
        [(3, "clause", "5", "nonsequential_bare_clause", 20, "clause_sequence:jump")], [("nonsequential_bare_clause", "warning", 3)], layout=(0, 1, 1),
    ),
    Case(
        "Điều 1. A {k}\n1. Một {k} x. 2. Hai x. 3. Ba x.\n4. Bốn: a) Chữ; b) Chữ.",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Một {k} x."), ("article-1/clause-2", "2", "Khoản 2", "Hai x."), ("article-1/clause-3", "3", "Khoản 3", "Ba x."), ("article-1/clause-4", "4", "Khoản 4", "Bốn:"), ("article-1/clause-4/point-a", "a", "Điểm a", "Chữ;"), ("article-1/clause-4/point-b", "b", "Điểm b", "Chữ.")],
        layout=(0, 4, 2),
    ),
    Case(
        "Chương I QUY ĐỊNH CHUNG Điều 1. Phạm vi {k} 1. Một chữ. 2. Hai chữ: a) Chữ; b) Chữ. 2a. Chèn chữ. Điều 2. Áp dụng {k} 1. Nội dung theo Điều 1 của Luật.",
        [
            ("chapter-I", "I", "QUY ĐỊNH CHUNG", ""), ("chapter-I/article-1", "1", "Phạm vi {k}", ""), ("chapter-I/article-1/clause-1", "1", "Khoản 1", "Một chữ."), ("chapter-I/article-1/clause-2", "2", "Khoản 2", "Hai chữ:"),
            ("chapter-I/article-1/clause-2/point-a", "a", "Điểm a", "Chữ;"), ("chapter-I/article-1/clause-2/point-b", "b", "Điểm b", "Chữ."), ("chapter-I/article-1/clause-2a", "2a", "Khoản 2a", "Chèn chữ."),
            ("chapter-I/article-2", "2", "Áp dụng {k}", ""), ("chapter-I/article-2/clause-1", "1", "Khoản 1", "Nội dung theo Điều 1 của Luật."),
        ],
        refs=[("chapter-I/article-2/clause-1", "Điều 1", None, None, "1")], layout=(1, 8, 1),
    ),
    Case("", [], said=[("empty_input", "error", None)]),
    Case("Văn bản thường {k}\nhai dòng", [("preamble", "", "Preamble", "Văn bản thường {k}\nhai dòng")], said=[("no_structural_markers", "warning", None)]),
    Case("Căn cứ luật {k}\nĐiều 1. A {k}\n1. Một", [("preamble", "", "Preamble", "Căn cứ luật {k}"), _FIRST, _ONE]),
    Case(
        "Điều 5\nPhạm vi điều chỉnh {k}\n1. Một\nĐiều 6\nCâu này kết thúc bằng dấu chấm {k}.\n1. Hai\nĐiều 7\nĐiều 9 của Luật {k}\nTên sau {k}",
        [("article-5", "5", "Phạm vi điều chỉnh {k}", ""), ("article-5/clause-1", "1", "Khoản 1", "Một"), ("article-6", "6", "", "Câu này kết thúc bằng dấu chấm {k}."), ("article-6/clause-1", "1", "Khoản 1", "Hai"), ("article-7", "7", "Tên sau {k}", "Điều 9 của Luật {k}")],
        [], [("structural_reference_kept_as_text", "info", 8)], [("article-7", "Điều 9", None, None, "9")],
    ),
    Case(
        "Điều 7. Một {k}\n1. A\nĐiều 2. Hai {k}\n1. B\nĐiều 9. Ba {k}\n1. C",
        [("article-7", "7", "Một {k}", ""), ("article-7/clause-1", "1", "Khoản 1", "A"), ("article-2", "2", "Hai {k}", ""), ("article-2/clause-1", "1", "Khoản 1", "B"), ("article-9", "9", "Ba {k}", ""), ("article-9/clause-1", "1", "Khoản 1", "C")],
        [], [("article_sequence_backward", "warning", 3), ("article_sequence_jump", "info", 5), ("article_number_reversal", "warning", None)],
    ),
    Case(
        "Điều 1. A {k}\n1. Một\na) x\nc) y\nc) z\nb) w\nb1) v",
        [_FIRST, _ONE, ("article-1/clause-1/point-a", "a", "Điểm a", "x"), ("article-1/clause-1/point-c", "c", "Điểm c", "y"), ("article-1/clause-1/point-c-2", "c", "Điểm c", "z"), ("article-1/clause-1/point-b", "b", "Điểm b", "w"), ("article-1/clause-1/point-b1", "b1", "Điểm b1", "v")],
        [], [("point_sequence_jump", "info", 4), ("point_sequence_same", "info", 5), ("point_sequence_backward", "info", 6)],
    ),
    Case(
        "Chương I. A {k}\nChương III. B {k}\nChương III. C {k}\nChương II. D {k}\nChương III. E {k}",
        [("chapter-I", "I", "A {k}", ""), ("chapter-III", "III", "B {k}", ""), ("chapter-III-2", "III", "C {k}", ""), ("chapter-II", "II", "D {k}", ""), ("chapter-III-3", "III", "E {k}", "")],
        [], [("chapter_sequence_jump", "info", 2), ("chapter_sequence_same", "warning", 3), ("chapter_sequence_backward", "warning", 4)],
    ),
    Case(
        "Điều 1. A {k}\n1. Một\n2. Hai\n2a. Chèn\n2b. Chèn\n3. Ba",
        [_FIRST, _ONE, *[(f"article-1/clause-{n}", n, f"Khoản {n}", t) for n, t in (("2", "Hai"), ("2a", "Chèn"), ("2b", "Chèn"), ("3", "Ba"))]],
        [(4, "clause", "2a", "", 93, "valid_bare_clause_sequence"), (6, "clause", "3", "", 93, "valid_bare_clause_sequence")],
    ),
    Case("Điều thứ 1. A {k}\n1. Một\nĐiều thứ 3. B {k}", [("article-thu-1", "thứ 1", "A {k}", ""), ("article-thu-1/clause-1", "1", "Khoản 1", "Một"), ("article-thu-3", "thứ 3", "B {k}", "")]),
    Case(
        "Điều 1. A {k}\n1. Theo \"khái niệm\n2. Trong {k}\nHết\" rồi\n2. Hai 'x y' d'z",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Theo \"khái niệm\n2. Trong {k}\nHết\" rồi"), ("article-1/clause-2", "2", "Khoản 2", "Hai 'x y' d'z")],
        [(3, "clause", "2", "", -1, "")], [("embedded_quoted_marker", "info", 3)],
    ),
    Case("Điều 1. A {k}\n[TABLE] 1. a. 2. b | {k}\n1. Một", [("article-1", "1", "A {k}", "[TABLE] 1. a. 2. b | {k}"), _ONE]),
    Case(
        "Điều 1. A {k}\na) x\n1. Một\na) y\nĐiều 2. B {k}\nc) z",
        [_FIRST, ("article-1/point-a", "a", "Điểm a", "x"), _ONE, ("article-1/clause-1/point-a", "a", "Điểm a", "y"), ("article-2", "2", "B {k}", ""), ("article-2/point-c", "c", "Điểm c", "z")],
    ),
    Case(
        "<p>Điều 1. A {k}</p><script>Điều 3. B</script><table><tr><td>1.</td><td>ô<br>&amp;amp; {k}</td></tr></table><p>1. Một</p>",
        [("article-1", "1", "A {k}", "[TABLE] 1. | ô & {k}"), _ONE],
    ),
    Case("\ufeff## Điều 1. A {k}\r\n\t1.  Nội \xa0 dung c ủa {k}\r\nCÔNG BÁO/Số 1\n\n\n\n", [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Nội dung của {k}")]),
    Case(
        "Điều 1. A {k}\n1. Theo điểm a khoản 2 Điều {k} và khoản 3 Điều 10a, Điều thứ 7\na) Khoản 3 Điều 8",
        [_FIRST, ("article-1/clause-1", "1", "Khoản 1", "Theo điểm a khoản 2 Điều {k} và khoản 3 Điều 10a, Điều thứ 7"), ("article-1/clause-1/point-a", "a", "Điểm a", "Khoản 3 Điều 8")],
        refs=[("article-1/clause-1", "điểm a khoản 2 Điều {k}", "a", "2", "{k}"), ("article-1/clause-1", "khoản 3 Điều 10a", None, "3", "10a"), ("article-1/clause-1", "Điều thứ 7", None, None, "thứ 7"), ("article-1/clause-1/point-a", "Điểm a Khoản 3 Điều 8", "a", "3", "8")],
    ),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, content``, and ``copy``: every order twice, the second time under a null id."""
    texts = spark.createDataFrame([(i, c.text) for i, c in enumerate(CASES)], "shape int, template string")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct()
    rows = orders.withColumn("shape", (F.col("k") % len(CASES)).cast("int")).join(F.broadcast(texts), "shape")
    return rows.select(F.col("k").alias("doc_id"), "shape", F.replace("template", F.lit("{k}"), F.col("k").cast("string")).alias("content"))


def quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) v({names}))"


#: source rows with the number of their shape; ``K`` puts the key into an expectation
ROWS = f"o AS (SELECT DISTINCT o_orderkey AS k, (o_orderkey % {len(CASES)})::INT AS shape FROM orders)"


def K(name: str) -> str:  # noqa: N802
    return f"replace({name}, '{{k}}', k::VARCHAR)"


def expected(of: str, names: str) -> str:
    """Rows (shape, place in the list, *names) of one field of every case."""
    return values([(i, j, *r) for i, c in enumerate(CASES) for j, r in enumerate(getattr(c, of), 1)], f"shape, place, {names}")
