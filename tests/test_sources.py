"""Files, chunks and text functions on small cases."""

import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quern import plans
from quern.functions import text as tx
from quern.operators import chunking
from quern.operators.evaluation import item_errors
from quern.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_length_overlap(spark):
    d = spark.createDataFrame([(1, "n", "a" * 250), (2, "n", "  "), (3, "n", None), (4, "n", "b" * 100)], "doc_id int, name string, text string")
    out = chunking.length_overlap(d, 100, 20).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.char_count) for r in out] == [(1, 100), (1, 100), (1, 90), (4, 100)]
    assert out[0].chunk_id == "1-c0000"


def test_structure_numbers_headings():
    out = chunking.structure_chunks("d.md", "# 总览\nx\n## 部署\ny\n## 6. RDB 与 AOF 的相互作用\nz", 800)
    assert [t for t, _, _ in out] == ["d.md > 1. 总览", "d.md > 1.1. 部署", "d.md > 1.2. RDB 与 AOF 的相互作用"]


def test_structure_packs_and_cuts():
    out = chunking.structure_chunks("d", "aaaa\nbbbb\n\ncccc", 10)
    assert [c for _, _, c in out] == ["aaaa\nbbbb", "cccc"]
    assert [len(c) for _, _, c in chunking.structure_chunks("d", "x" * 25, 10)] == [10, 10, 5]
    assert [(p, c) for _, p, c in chunking.structure_chunks("d", "ab\fcd", 2, True)] == [(1, "ab"), (2, "cd")]


def test_sheets():
    text = "## HikariCP\n| k | v |\n| --- | --- |\n| a | 1 |\n| b | 2 |\n| c | 3 |\n\n## Two\n| k |\n| --- |\n| z |"
    out = chunking.sheet_chunks("p.xlsx", text, 400)
    assert [t for t, _, _ in out] == ["p.xlsx > HikariCP > 概览", "p.xlsx > HikariCP > 数据行 1-3", "p.xlsx > Two > 概览", "p.xlsx > Two > 数据行 1-1"]
    small = [t.rpartition(" ")[2] for t, _, _ in chunking.sheet_chunks("p.xlsx", text, 70) if "HikariCP > 数据行" in t]
    assert small[0] == "1-2" and small[1] == "3-3"
    assert chunking.sheet_chunks("p", f"| k |\n| --- |\n| {'x' * 300} |", 200)[1][0].endswith("数据行 1-1")


def test_tables_are_always_sheets(spark):
    d = spark.createDataFrame([(1, "a.csv", "CSV", "| k |\n| --- |\n| z |"), (2, "b.md", "MD", "text")], "doc_id int, name string, file_type string, text string")
    assert sorted(r.title_path for r in chunking.route(d, "LENGTH_OVERLAP").collect()) == ["a.csv > 数据行 1-1", "a.csv > 概览", "b.md"]


def test_text_functions(spark):
    assert one(spark, tx.clean_text(F.lit("﻿a \t\r\nb\r\r\n\n\n c　"))) == "a\nb\n\n c"
    assert one(spark, tx.content_hash(F.lit("  "))) is None
    assert one(spark, tx.content_hash(F.lit(" a \n b "))) == one(spark, tx.content_hash(F.lit("a b")))
    assert one(spark, tx.enrich(F.lit("c"), F.lit("d.md > 1."), F.lit("d.md"))) == "章节：d.md > 1.\n\nc"
    assert one(spark, tx.enrich(F.lit("c"), F.lit(None), F.lit("d.md"))) == "文档：d.md\n\nc"
    assert one(spark, tx.enrich(F.lit("c"), F.lit(" "), F.lit(None))) == "c"
    assert one(spark, tx.extension(F.lit("a.B.MD"))) == "md" and one(spark, tx.extension(F.lit("x"))) == ""


def test_content_hash_of_odd_texts_against_its_sql(spark, tmp_path):
    signs = [chr(c) for c in (0, 9, 10, 11, 12, 13, 0x1C, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2007, 0x200B, 0x2028, 0x2029, 0x3000, 0xFEFF)]
    texts = [None, "", " ", "\n\t \x0b\f\r", "a", "\x0b a\x0b\x0bb \x0b c \x0b", "a\r\n\r\nb \n", "𝒳 \n é"]
    texts += [form.format(x) for x in signs for form in ("{0}", "a{0}b", "{0}a", "a{0}", "a {0}", "{0} {0} a{0} {0}b {0} {0}")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = dict(con.sql(plans.oracle_sql()["content_hash"]).fetchall())
    assert dict(map(tuple, plans.queries()["content_hash"](spark, str(tmp_path)).collect())) == want
    assert len(want) == len(texts) and want[0] is None and want[1] == "e3b0c44298fc1c14"


def test_strip(spark):
    """Only what the class has goes, before any last line end; the time is in proportion to the text."""
    assert one(spark, tx.strip(F.lit(" a \x85"))) == "a \x85" and one(spark, tx.strip(F.lit("\u3000 a \u2028\n"))) == "a"
    long = "a" + " " * 1_000_000 + "b"
    assert spark.createDataFrame([(f" {long} ",)], "t string").select(tx.strip("t").alias("x")).first().x == long


def test_csv():
    assert files.parse_csv('﻿a,b\n"x, ""y""",p|q\n\n1'.encode()) == '| a | b |\n| --- | --- |\n| x, "y" | p/q |\n| 1 |  |'
    # Only line feeds end lines, and only the CSV reader rewrites bars.
    assert files.parse_csv("a,b\nx\x0b\u2028y,\rz\r\nq,r".encode()) == "| a | b |\n| --- | --- |\n| x\x0b\u2028y | z |\n| q | r |"
    assert files.pipe_table([["a|b"], ["c"]]) == "| a|b |\n| --- |\n| c |"
    for bad in (b"", b"a,b"):
        with pytest.raises(ValueError):
            files.parse_csv(bad)


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2</v></c></row><row><c r="A2"/></row><row><c r="A3" t="inlineStr"><is><t>x\ny</t></is></c></row></sheetData></worksheet>'
    xlsx = office({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/worksheets/s.xml": sheet,
    })
    assert files.parse_xlsx(xlsx) == "## S\n\n| k | 2 |\n| --- | --- |\n| x y |  |"
    docx = office({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    assert files.parse_docx(docx) == "## T\nb\n| h |\n| --- |\n\n"
    for name, body in {"a.xlsx": xlsx, "b.docx": docx, "c.txt": b"\xff", "d.txt": "﻿hi".encode(), "e.exe": b"x", "f.xlsx": b"no"}.items():
        (tmp_path / name).write_bytes(body)
    out = {r.path[-5:]: (r.file_type, r.text is not None, r.error) for r in files.parse(files.read_files(spark, str(tmp_path))).collect()}
    assert out["d.txt"] == ("TXT", True, None) and out["c.txt"][2] == "SIGNATURE_MISMATCH" and out["e.exe"][2] == "UNSUPPORTED_FILE_TYPE"
    assert out[".xlsx"[-5:]] in (("XLSX", True, None), ("XLSX", False, "SIGNATURE_MISMATCH")) and out[".docx"[-5:]] == ("DOCX", True, None)


def test_numbers_as_sheets_show_them():
    shown = [("0.125", 10, None), ("1234.5", 4, None), ("45000", 14, None), ("3", 0, None), ("0.1", 0, "General"), ("2.5", 1, None), ("1234.567", 164, "#,##0.0"), ("0.5", 165, '0%" of all"'), ("45000.5", 166, "yyyy-mm-dd hh:mm"), ("x", 2, None)]
    assert [files.number_text(*x) for x in shown] == ["12.50%", "1,234.50", "3/15/23", "3", "0.1", "3", "1,234.6", "50%", "2023-03-15 12:00:00", "x"]


def test_every_rule_of_a_data_set(spark, tmp_path):
    e, bare = {"chunkId": "c"}, {"docName": "d"}
    rows = {
        "CATEGORY_MISSING": {"question": "q", "evidence": [e]}, "ANSWERABLE_NO_BOOLEAN": {"question": "q", "category": "DIRECT", "answerable": "maybe"},
        "EVIDENCE_NOT_ANCHORED": {"question": "q", "category": "DIRECT", "evidence": [e, bare]}, "EVIDENCE_MISSING": {"question": "q", "category": "DIRECT"},
        "FAILURE_MODE_UNKNOWN": {"question": "q", "category": "DIRECT", "answerable": " FALSE ", "failureMode": "BAD"}, "TEMPTING_NOT_ANCHORED": {"question": "q", "category": "DIRECT", "answerable": "false", "failureMode": "OUT_OF_KB", "temptingEvidence": [e, bare]},
        "NEGATIVE_FIELDS_NOT_ALLOWED": {"question": "q", "category": "DIRECT", "evidence": [e], "missingRequirement": "m"}, "EVIDENCE_MODE_UNKNOWN": {"question": "q", "category": "DIRECT", "evidence": [e], "evidenceMode": "NONE"},
        "MULTI_CHUNK_NEEDS_TWO": {"question": "q", "category": "DIRECT", "evidence": [e], "evidenceMode": "MULTI_CHUNK"}, "FOLLOW_UP_NEEDS_HISTORY": {"question": "q", "category": "DIRECT", "evidence": [e], "evidenceMode": "FOLLOW_UP"},
    }
    (tmp_path / "r.json").write_text(json.dumps(list(rows.values())))
    assert [r.errors for r in item_errors(files.read_eval_json(spark, str(tmp_path / "r.json"))).collect()] == [[k] for k in rows]


def test_growth_of_text_functions(spark):
    """Eight times the text takes about eight times as long, not sixty-four."""
    import time

    def took(work, n):
        d = spark.createDataFrame([(1, "n", ("word " * 40 + "\f") * n)], "doc_id long, name string, text string")
        began = time.time()
        work(d).write.format("noop").mode("overwrite").save()
        return time.time() - began

    for work in (chunking.length_overlap, files.pages, lambda d: chunking.structure(d, paged=True)):
        took(work, 100)
        assert took(work, 80_000) < 20 * max(0.5, took(work, 10_000)), work


def test_pdf_routes(spark):
    rows = [(1, "x" * 60), (2, "x" * 10), (3, "x" * 400 + "\f\f"), (4, "�" * 60), (5, "")]
    m = files.pdf_metrics(spark.createDataFrame(rows, "doc_id int, text string")).withColumn("r", files.pdf_route())
    assert {r.doc_id: r.r for r in m.collect()} == {1: "TEXT_PDF", 2: "LOW_TEXT_DENSITY", 3: "TOO_MANY_EMPTY_TEXT_PAGES", 4: "LOW_TEXT_QUALITY", 5: "LOW_TEXT_DENSITY"}


def test_evaluation_files(spark, tmp_path):
    good = {"question": "q", "category": "DIRECT", "evidence": [{"chunkId": "c"}], "history": [{"role": "USER", "content": "x"}]}
    bad = {"question": " ", "category": "X", "answerable": "false", "evidenceMode": "SINGLE_CHUNK", "history": [{"role": "bot", "content": ""}]}
    (tmp_path / "a.json").write_text(json.dumps([good, bad]))
    out = item_errors(files.read_eval_json(spark, str(tmp_path / "a.json"))).collect()
    assert out[0].errors == [] and out[1].errors == ["QUESTION_BLANK", "CATEGORY_UNKNOWN", "HISTORY_INVALID", "EVIDENCE_MODE_NOT_ALLOWED", "FAILURE_MODE_MISSING"]
    (tmp_path / "b.csv").write_text('question,answerable,category,evidence,history\nq,true,DIRECT,"[{""chunkId"": ""c""}]",zzz\n')
    row = item_errors(files.read_eval_csv(spark, str(tmp_path / "b.csv"))).first()
    assert row.errors == [] and row.history is None and row.evidence[0].chunk_id == "c"
    (tmp_path / "c.csv").write_text("question,category\nq,DIRECT\n")
    with pytest.raises(ValueError):
        files.read_eval_csv(spark, str(tmp_path / "c.csv"))


def test_chunks_keep_columns_of_their_documents(spark):
    d = spark.createDataFrame([(1, "n", "abcdefgh", "x", 3), (1, "n", "ab", None, 4), (2, "m", "\t \n", "y", 5)], "doc_id long, name string, text string, kb_id string, size int")
    got = [tuple(r) for r in chunking.length_overlap(d, 5, 1, keep=("kb_id", "size")).select("chunk_id", "content", "kb_id", "size").collect()]
    assert got == [("1-c0000", "abcde", "x", 3), ("1-c0001", "efgh", "x", 3), ("1-c0000", "ab", None, 4)]


def test_blank_is_what_stripping_leaves_empty(spark):
    texts = [None, "", " \t\r\n\x0b\x1c\x1f    　", " ", " ", "\u0085", " a ", "\n\nx", "﻿", "0", "\U0001f600 "]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.is_blank("t").alias("b"), F.coalesce(tx.strip("t") == "", F.lit(True)).alias("want"))
    rows = d.collect()
    assert all(r.b == r.want for r in rows) and sum(r.b for r in rows) == 3
