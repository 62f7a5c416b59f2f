"""Queries of parsers, restored texts, index checks, activation, admission and stages of evidence, and their SQL."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import answer, catalog, embedding, evaluation
from quern.plans.base import DOCUMENTS, Search, documents, questions, table
from quern.plans.library import _PAGED, _VERSIONS, _paged
from quern.plans.search import _REL, _TRACE, TO_FINAL, _evidence, chain
from quern.shared import new_path
from quern.sources import files

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _office(batches):
    """Small office documents of (id, kind, rows: arrays of name and number)."""
    for b in batches:
        out = []
        for kind, rows in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if kind == "XLSX":
                cells = "".join(f'<row><c r="A{i}" t="inlineStr"><is><t>{r["name"]}|x</t></is></c><c r="C{i}" s="1"><v>{r["n"] / 8}</v></c><c r="D{i}"><v>{r["n"]}</v></c></row>' for i, r in enumerate(rows, 1))
                out.append(_archive({
                    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
                    "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>', "xl/worksheets/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>",
                }))
            else:
                half = lambda t: f"<w:r><w:t>{t[:3]}</w:t></w:r><w:r><w:t>{t[3:]}</w:t></w:r>"
                table_ = "".join(f"<w:tr><w:tc><w:p>{half(r['name'])}</w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{r['n']}</w:t></w:r></w:p></w:tc></w:tr>" for r in rows)
                first = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{half("Nations")}</w:p><w:p/><w:p>{half("of a region")}</w:p>'
                out.append(_archive({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{first}<w:tbl>{table_}</w:tbl></w:body></w:document>'}))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([True] * len(out)), pa.array(out, pa.binary())], names=["path", "file_type", "ok", "content"])


_BY_REGION = "SELECT n_regionkey AS r, list({'name': n_name, 'n': n_nationkey} ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1"


@query(f"""WITH g AS ({_BY_REGION}), t AS (SELECT r, unnest(rows) AS x, generate_subscripts(rows, 1) AS k FROM g)
SELECT 'x' || r AS path, 'XLSX' AS file_type, '## S' || chr(10) || chr(10) || string_agg('| ' || x.name || '|x | ' || printf('%.2f', x.n * 12.5) || '% | ' || x.n || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY k) AS text, CAST(NULL AS VARCHAR) AS error FROM t GROUP BY r
UNION ALL SELECT 'd' || r, 'DOCX', '## Nations' || chr(10) || 'of a region' || chr(10) || string_agg('| ' || x.name || ' two | ' || x.n || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- |' ELSE '' END, chr(10) ORDER BY k) || chr(10) || chr(10), NULL FROM t GROUP BY r""")
def office_parse(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("name")))).alias("rows"))
    key = F.col("n_regionkey").cast("string")
    both = n.select(F.concat(F.lit("x"), key).alias("path"), F.lit("XLSX").alias("file_type"), "rows").unionByName(n.select(F.concat(F.lit("d"), key).alias("path"), F.lit("DOCX").alias("file_type"), "rows"))
    return files.parse(both.mapInArrow(_office, "path string, file_type string, ok boolean, content binary"))


@query("""SELECT 'c' || n_regionkey AS path, 'CSV' AS file_type, '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ', "x" | p/q |', chr(10) ORDER BY n_nationkey) AS text, CAST(NULL AS VARCHAR) AS error FROM nation GROUP BY n_regionkey
UNION ALL SELECT 't' || n_regionkey, 'TXT', string_agg(n_name, chr(13) ORDER BY n_nationkey), NULL FROM nation GROUP BY n_regionkey UNION ALL SELECT 'e' || r_regionkey, 'CSV', NULL, 'HEADER_ONLY' FROM region UNION ALL SELECT 'p' || r_regionkey, 'PDF', NULL, 'UNSUPPORTED_FILE_TYPE' FROM region""")
def text_parse(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    line = lambda x: F.concat(F.lit('"'), x["n_name"], F.lit(', ""x""",p|q\x0b'))
    csv = F.concat(F.lit("﻿k,v\r\n\n"), F.array_join(F.transform("r", line), "\n"))
    txt = F.concat(F.lit("﻿"), F.array_join(F.transform("r", lambda x: x["n_name"]), "\r"))
    key = F.col("n_regionkey").cast("string")
    rows = [("c", "CSV", csv), ("t", "TXT", txt), ("e", "CSV", F.lit("k,v\n")), ("p", "PDF", F.lit("%PDF-"))]
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(p), key).alias("path"), F.lit(k).alias("file_type"), F.lit(True).alias("ok"), c.cast("binary").alias("content")) for p, k, c in rows])).alias("f")
    return files.parse(n.select(each).select("f.*"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(string_split(text, chr(12))[1], '^\\s*$') THEN 'SCANNED_PDF_NOT_SUPPORTED' END AS error FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN '  ' || chr(12) ELSE '' END || text AS text FROM ({_PAGED}))")
def pdf_text_layer(spark, sf):
    d = _paged(spark, sf).withColumn("text", F.concat(F.when(F.col("doc_id") % 4 == 1, "  \f").otherwise(""), "text"))
    return files.text_layer(d).select("doc_id", "error")


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'PDF' WHEN 1 THEN 'MD' ELSE 'TXT' END AS k, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(12)) || chr(12) || chr(12) ELSE '# ' || source || chr(10) || text END AS text FROM documents)
SELECT doc_id, 'page' AS kind, len(string_split(text, chr(12))) AS n FROM p WHERE k = 'PDF' UNION ALL SELECT doc_id, 'heading', len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^(#{1,6})\\s+(.*\\S|\\S)\\s*$'))) FROM p WHERE k = 'MD'""")
def parsed_restore(spark, sf):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "PDF").when(i % 3 == 1, "MD").otherwise("TXT")
    text = F.when(i % 3 == 0, F.concat(F.translate("text", "\n", "\f"), F.lit("\f\f"))).otherwise(F.concat(F.lit("# "), "source", F.lit("\n"), "text"))
    path = new_path(spark, "parsed")
    files.write_parsed(table(spark, sf, "documents").select("doc_id", kind.alias("file_type"), text.alias("text")), path)
    pages, heads = files.restore_parsed(spark, path)
    n = lambda df, k: df.groupBy("doc_id").agg(F.lit(k).alias("kind"), F.count("*").alias("n"))
    return n(pages, "page").unionByName(n(heads, "heading"))


@query("SELECT vec_id % 50 AS doc_id, CASE WHEN bool_or(vec_id % 70 = 3) THEN 'COUNT_MISMATCH' ELSE 'DIMENSION_MISMATCH' END AS error FROM embeddings WHERE vec_id % 70 = 3 OR vec_id % 90 = 5 GROUP BY 1")
def index_check(spark, sf):
    i = F.col("vec_id")
    v = F.when(i % 70 == 3, None).when(i % 90 == 5, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return catalog.index_errors(table(spark, sf, "embeddings").select((i % 50).alias("doc_id"), i.cast("string").alias("chunk_id"), v.alias("vector")), 64)


_ASKED = f"{_VERSIONS}, vs AS (SELECT v.*, CASE WHEN doc_id % 11 = 0 THEN 'PROCESSING' ELSE status END AS st FROM v), asked AS (SELECT root_id, min(doc_id) AS doc_id FROM v GROUP BY 1)"


@query(f"WITH {_ASKED}, ok AS (SELECT a.* FROM asked a JOIN vs USING (doc_id) WHERE vs.st IN ('COMPLETED', 'FAILED')) SELECT vs.doc_id, vs.root_id, CASE WHEN ok.doc_id IS NULL THEN is_active ELSE vs.doc_id = ok.doc_id END AS is_active FROM vs LEFT JOIN ok ON ok.root_id = vs.root_id")
def version_activate(spark, sf):
    return catalog.activate(*_activation(spark, sf))[0].select("doc_id", "root_id", "is_active")


@query(f"WITH {_ASKED} SELECT a.doc_id, st AS status, 'STATUS_NOT_ACTIVATABLE' AS error FROM asked a JOIN vs USING (doc_id) WHERE st NOT IN ('COMPLETED', 'FAILED') UNION ALL SELECT -1, NULL, 'NOT_FOUND'")
def version_activate_errors(spark, sf):
    v, asked = _activation(spark, sf)
    return catalog.activate(v, asked.unionByName(spark.sql("SELECT -1L AS doc_id")))[1]


def _activation(spark, sf):
    d = documents(spark, sf)
    v = catalog.versions(d.withColumn("status", F.when(F.col("doc_id") % 11 == 0, "PROCESSING").otherwise(F.col("status"))))
    return v, v.groupBy("root_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query(f"WITH {DOCUMENTS} SELECT doc_id, status FROM document WHERE status IN ('FAILED', 'PROCESSING') ORDER BY doc_id DESC")
def status_union(spark, sf):
    return catalog.by_statuses(documents(spark, sf), "FAILED", "PROCESSING").select("doc_id", "status")


@query("SELECT user_id AS stream_id, coalesce(sum(CASE WHEN gap > 0 THEN (gap - 1) // 15000000 END), 0)::BIGINT AS beats FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY 1")
def heartbeats(spark, sf):
    return catalog.heartbeats(table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("id")))


def _requests(spark, sf):
    return table(spark, sf, "events").select((F.col("user_id") % 7).alias("server"), F.col("event_id").alias("id"), (F.col("event_id") * 13 % 20_000).alias("start_ms"), (F.col("event_id") % 900 + 100).alias("duration_ms"))


@query()
def stream_cap(spark, sf):
    """At most 32 streams at once: who comes beyond that is refused."""
    return catalog.admission(_requests(spark, sf), 32)


@query()
def bulkhead_admission(spark, sf):
    """Four permits, and half a second of waiting for one."""
    return catalog.admission(_requests(spark, sf), 4, 500)


@query("""SELECT n_nationkey, n_nationkey % 5 = 0 AS rewritten, CASE WHEN n_nationkey % 5 = 0 THEN 'what of ' || n_name END AS query, CASE WHEN n_nationkey % 5 > 1 THEN 'INVALID_RESPONSE' END AS failure FROM nation""")
def rewrite_parse(spark, sf):
    k = F.col("n_nationkey")
    good = F.format_string('```json\n{"rewritten": true, "query": " what of %s ", "reason": "r"}\n```', F.col("n_name"))
    raw = F.when(k % 5 == 0, good).when(k % 5 == 1, '{"rewritten": false, "query": "ignored"}').when(k % 5 == 2, '{"rewritten": "true", "query": "x"}').when(k % 5 == 3, F.format_string('{"rewritten": true, "query": "%s"}', F.repeat(F.lit("y"), F.lit(201)))).otherwise("no braces")
    r = answer.parse_rewrite(raw)
    return table(spark, sf, "nation").select(k, r["rewritten"].alias("rewritten"), r["query"].alias("query"), r["failure"].alias("failure"))


@query(chain(*TO_FINAL) + " SELECT query_id, id, final_rank FROM top")
def final_topk(spark, sf):
    return Search(spark, sf).top.select("query_id", "id", "final_rank")


@query(chain(*TO_FINAL) + " SELECT query_id, id, score, passed FROM top")
def threshold_mark(spark, sf):
    return Search(spark, sf).top.select("query_id", "id", "score", "passed")


def _relevant(spark, sf):
    return _evidence(spark, sf).select("query_id", F.col("evidence_id").alias("id"))


@query(chain(*TO_FINAL) + _TRACE + _REL + " SELECT e.query_id, e.id, coalesce(string_agg(stage || ':' || rank, ',' ORDER BY stage || ':' || rank), '') AS stages FROM e LEFT JOIN (SELECT * FROM trace WHERE rank IS NOT NULL) t ON t.query_id = e.query_id AND t.id = e.id GROUP BY ALL")
def evidence_snapshot(spark, sf):
    return evaluation.evidence_snapshot(_relevant(spark, sf), Search(spark, sf, reuse=True).trace)


@query(chain(*TO_FINAL) + _TRACE + _REL + " SELECT e.query_id, coalesce(array_to_string(list_sort(list(DISTINCT e.id) FILTER (t.id IS NOT NULL)), ','), '') AS ids FROM e LEFT JOIN (SELECT DISTINCT query_id, id FROM trace) t ON t.query_id = e.query_id AND t.id = e.id GROUP BY e.query_id")
def evidence_union(spark, sf):
    u = evaluation.evidence_union(_relevant(spark, sf), Search(spark, sf, reuse=True).trace)
    return u.select("query_id", F.coalesce(F.array_join(F.col("ids").cast("array<string>"), ","), F.lit("")).alias("ids"))


@query("""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark), c AS (SELECT item_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS place, count(*) AS n FROM w GROUP BY ALL)
SELECT item_id AS query_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS value FROM c""")
def text_embedding(spark, sf):
    v = embedding.embed(questions(spark, sf), "query_id", "text")
    return v.select("query_id", F.posexplode("vector").alias("place", "value")).where("value <> 0").select("query_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))
