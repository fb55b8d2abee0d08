"""Sources, sinks, the command line and micro-batches."""

import io
import json
import sys
import types
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspark import cli
from lexspark.plans.structure import parse_structure
from lexspark.sources import sinks
from lexspark.sources.readers import docx_text, read_json, read_jsonl, read_records
from lexspark.streaming.parse import stream_nodes


def content(df):
    return [json.loads(r.record)["content"] for r in df.collect()]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Điều 1. A\r\n1. B".encode() + b"\xff")
    (tmp_path / "b.md").write_text("# Điều 2. C\n", encoding="utf-8")
    (tmp_path / "t.html").write_text("<p>Điều 1. Tên</p><style>x</style><table><tr><td>a</td><td> </td><td>b<br>c</td></tr></table>&amp;lt;", encoding="utf-8")
    one = read_records(spark, str(tmp_path / "a.txt")).first()
    assert (one.doc_id, json.loads(one.record)["title"]) == ("a", "a") and json.loads(one.record)["source"].endswith("/a.txt")
    assert content(read_records(spark, str(tmp_path / "a.txt"))) == ["Điều 1. A\n1. B�"] and content(read_records(spark, str(tmp_path / "b.md"))) == ["# Điều 2. C\n"]
    assert content(read_records(spark, str(tmp_path / "t.html"))) == ["\nĐiều 1. Tên\n\n\n[TABLE] a | b c\n\n<"]
    with pytest.raises(ValueError, match="xyz"):
        read_records(spark, "x.xyz")


def test_json_files(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"id": "x", "content": "A"}')
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "x"}, {"content": null}]')
    (tmp_path / "n.json").write_text("3")
    (tmp_path / "i.json").write_text("[1]")
    assert [r.doc_id for r in read_json(spark, str(tmp_path / "o.json")).collect()] == ["x"] and read_json(spark, str(tmp_path / "a.json")).count() == 3
    for bad in ("n", "i"):
        with pytest.raises(Exception, match="object"):
            read_json(spark, str(tmp_path / f"{bad}.json")).collect()
    (tmp_path / "g.jsonl").write_text('{"id": 1}\n\n  \n{"id": 2}\n')
    assert sorted(r.doc_id for r in read_jsonl(spark, str(tmp_path / "g.jsonl")).collect()) == ["1", "2"]
    for bad, said in (('{"id": 1}\nbad\n', "Invalid JSONL"), ("[1]\n", "not an object")):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception, match=said):
            read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c.jsonl").write_text('{"id": 1}\r\n\n{"id": 2}\n{bad\n')
    with pytest.raises(Exception, match="Invalid JSONL in line 4 of .*c.jsonl"):
        read_jsonl(spark, str(tmp_path / "c.jsonl"), numbered=True).collect()
    assert sorted(r.doc_id for r in read_jsonl(spark, str(tmp_path / "g.jsonl"), numbered=True).collect()) == ["1", "2"]


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


def test_docx(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t, more="": f"<w:tc>{more}{p(t)}</w:tc>"
    table = f'<w:tbl><w:tr>{cell("b", "<w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>")}{cell("b")}{cell("")}{cell("c")}</w:tr><w:tr>{cell("")}</w:tr></w:tbl>'
    data = docx(p("A") + table + p("") + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>")
    assert docx_text(data) == "A\n[TABLE] b | c\nx\ty"
    (tmp_path / "d.docx").write_bytes(data)
    assert content(read_records(spark, str(tmp_path / "d.docx"))) == ["A\n[TABLE] b | c\nx\ty"] and docx_text(docx("")) == ""


def test_pdf_through_a_module_that_stands_in(monkeypatch):
    from lexspark.sources.readers import pdf_text

    monkeypatch.setitem(sys.modules, "pymupdf", None)
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="pymupdf or pypdf"):
        pdf_text(b"x")
    pages = [types.SimpleNamespace(extract_text=lambda: "A"), types.SimpleNamespace(extract_text=lambda: None)]
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda data: types.SimpleNamespace(pages=pages)))
    assert pdf_text(b"x") == "A\n"

    class Opened(list):
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    page = types.SimpleNamespace(get_text=lambda kind: f"B {kind}")
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda stream, filetype: Opened([page, page])))
    assert pdf_text(b"x") == "B text\nB text"


def test_single_files(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f'{{"k": "é{i}"}}',) for i in range(n)], "json string")
    out = tmp_path / "o.json"
    assert sinks.write_single(rows(1), str(out)) == 1 and json.loads(out.read_text()) == {"k": "é0"}
    assert sinks.write_single(rows(2), str(out), pretty=True) == 2 and "\n  {" in out.read_text() and "é1" in out.read_text()
    assert sinks.write_single(rows(0), str(out)) == 0 and json.loads(out.read_text()) == []
    before = out.read_text()
    bad = rows(1).withColumn("json", F.when(F.length("json") > 0, F.raise_error(F.lit("broken"))).otherwise(F.col("json")))
    for df, most in ((bad, 100), (rows(3), 5)):
        with pytest.raises(Exception):  # noqa: B017
            sinks.write_single(df, str(out), max_bytes=most)
    assert out.read_text() == before and not list(tmp_path.glob("*.tmp"))
    sinks.write_jsonl(rows(2), str(tmp_path / "parts"))
    assert read_jsonl(spark, str(tmp_path / "parts")).count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "content": "Điều 1. Tên\\n1. Nội dung"}\n\n{"id": "y", "content": ""}\n', encoding="utf-8")
    source, out = str(tmp_path / "a.jsonl"), tmp_path / "new" / "o.jsonl"
    assert cli.main(["-i", source, "-o", str(out)]) == 0
    assert cli.main(["-i", source, "-o", str(out), "--min-confidence", "0.5"]) == 2
    docs = {d["document"]["document_id"]: d for d in map(json.loads, out.read_text().splitlines())}
    assert docs["x"]["structure"][0]["children"][0]["element_id"] == "article-1/clause-1" and docs["y"]["structure"] == []
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nbad\n')
    assert cli.main(["-i", str(tmp_path / "b.jsonl"), "-o", str(tmp_path / "n.json")]) == 1 and not (tmp_path / "n.json").exists() and "line 2 of" in capsys.readouterr().err
    for wrong in (["-i", str(tmp_path / "none.jsonl"), "-o", str(out)], ["-i", source, "-o", "x.csv"], ["-i", source, "-o", str(out), "--min-confidence", "2"], ["-i", source]):
        with pytest.raises(SystemExit) as e:
            cli.main(wrong)
        assert e.value.code == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--version"])
    assert e.value.code == 0 and "lexspark" in capsys.readouterr().out


def test_micro_batches(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Điều {i}. Tên\n1. Một\na) Chữ") for i in range(1, 7)], "doc_id long, content string")
    for part in (docs.filter("doc_id <= 3"), docs.filter("doc_id > 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second start finds nothing new
        stream_nodes(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    key = lambda df: sorted((r.doc_id, r.element_id) for r in df.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2 and key(got) == key(parse_structure(docs).nodes)


def test_jsonl_in_gzip_is_smaller_and_read_back_whole(spark, tmp_path):
    rows = spark.range(2000).selectExpr("""concat('{"id": ', id, ', "content": "', repeat('x', 500), '"}') AS json""")
    for how in ("none", "gzip"):
        sinks.write_jsonl(rows, str(tmp_path / how), compression=how)
        assert {int(r.doc_id) for r in read_jsonl(spark, str(tmp_path / how)).collect()} == set(range(2000))
    plain, small = (sum(f.stat().st_size for f in (tmp_path / how).iterdir()) for how in ("none", "gzip"))
    assert small * 10 < plain
