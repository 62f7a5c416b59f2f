"""Queries of chunkers and of searches over chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import answer, chunking, embedding, retrieval
from quern.plans.base import _WORDS, DOCUMENTS, active, documents, questions, table
from quern.plans.library import _CHUNKS
from quern.shared import cut

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HEAD = r"'^(#{1,6})\s+(.*\S|\S)\s*$'"
_NUMBER = r"'^\s*\d+(?:\.\d+)*\.?\s*'"


def structure_sql(source: str, most: int = 800) -> str:
    """CTEs that end with structured (doc_id, seq, title_path, content) of source (doc_id, name, text): a fold over lines, all documents at once."""
    return rf"""src AS ({source}),
line AS (SELECT doc_id, name, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM src WHERE trim(text, chr(10) || chr(9) || chr(13) || ' ') <> ''),
line_ AS (SELECT doc_id, no, x, regexp_matches(x, {_HEAD}) AS head, trim(x, chr(9) || chr(13) || ' ') = '' AS blank FROM line UNION ALL SELECT doc_id, max(no) + 1, NULL, false, false FROM line GROUP BY doc_id),
fold AS (SELECT DISTINCT doc_id, name, 0::BIGINT AS no, '' AS body, false AS open, false AS gap, [0, 0, 0, 0, 0, 0] AS c, name AS title, CAST([] AS STRUCT(t VARCHAR, x VARCHAR)[]) AS out FROM line
  UNION ALL SELECT doc_id, name, no, CASE WHEN cuts > 0 THEN substr(next, cuts * {most} + 1) ELSE next END, CASE WHEN blank THEN open ELSE x IS NOT NULL END, blank AND (gap OR open),
    c2, CASE WHEN head THEN name || ' > ' || array_to_string(c2[1:level], '.') || '. ' || CASE WHEN regexp_replace(label, {_NUMBER}, '') = '' THEN label ELSE regexp_replace(label, {_NUMBER}, '') END ELSE title END,
    CASE WHEN closes AND trim(body, chr(10) || chr(9) || chr(13) || ' ') <> '' THEN [{{'t': title, 'x': body}}] ELSE [] END || list_transform(range(0, cuts), lambda i: {{'t': title, 'x': substr(next, i * {most} + 1, {most})}})
  FROM (SELECT *, CASE WHEN NOT head AND NOT blank AND x IS NOT NULL AND length(next) > {most} THEN CAST(ceil(length(next) / {most}) AS BIGINT) - 1 ELSE 0 END AS cuts,
      CASE WHEN head THEN list_transform(range(1, 7), lambda k: CASE WHEN k < level THEN c[k] WHEN k = level THEN c[k] + 1 ELSE 0 END) ELSE c END AS c2
    FROM (SELECT *, CASE WHEN blank THEN body WHEN x IS NULL THEN '' WHEN head OR closes OR NOT open THEN x ELSE body || joint || x END AS next
      FROM (SELECT *, open AND (head OR x IS NULL OR (NOT blank AND length(body) + length(joint) + length(x) > {most})) AS closes
        FROM (SELECT f.doc_id, f.name, l.no, f.body, f.open, f.gap, f.c, f.title, l.x, l.head, l.blank, CASE WHEN f.gap THEN chr(10) || chr(10) ELSE chr(10) END AS joint,
            length(regexp_extract(l.x, {_HEAD}, 1)) AS level, regexp_extract(l.x, {_HEAD}, 2) AS label FROM fold f JOIN line_ l ON l.doc_id = f.doc_id AND l.no = f.no + 1))))),
piece AS (SELECT doc_id, no, unnest(out) AS o, generate_subscripts(out, 1) AS k FROM fold),
structured AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no, k) - 1 AS seq, o.t AS title_path, o.x AS content FROM piece WHERE trim(o.x, chr(10) || chr(9) || chr(13) || ' ') <> '')"""


def sheet_sql(source: str, most: int = 800) -> str:
    """CTEs that end with sheeted (doc_id, seq, title_path, content) of source (doc_id, name, sheet, head: cells, rows: rows of cells), one sheet a document."""
    row = lambda cells: f"(array_to_string(list_transform({cells}, lambda c: '| ' || c || ' '), '') || '|')"
    return f"""sheet AS ({source}),
sh AS (SELECT doc_id, rows, len(rows) AS n, name || CASE WHEN sheet <> '' THEN ' > ' || sheet ELSE '' END AS path, CASE WHEN sheet <> '' THEN '## ' || sheet || chr(10) || chr(10) ELSE '' END AS title, head,
  {row("head")} || chr(10) || repeat('| --- ', CAST(len(head) AS INT)) || '|' AS top FROM sheet),
srow AS (SELECT doc_id, n, k, {row("(r || list_transform(range(len(head) - len(r)), lambda i: ''))")} AS x, '数据表：' || path || chr(10) || top AS fixed, path FROM (SELECT *, unnest(rows) AS r, generate_subscripts(rows, 1) AS k FROM sh)),
grp AS (SELECT doc_id, k, length(fixed) + 1 + length(x) AS size, 1 AS g FROM srow WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN p.size + 1 + length(s.x) > {most} THEN length(s.fixed) ELSE p.size END + 1 + length(s.x), p.g + CASE WHEN p.size + 1 + length(s.x) > {most} THEN 1 ELSE 0 END FROM grp p JOIN srow s ON s.doc_id = p.doc_id AND s.k = p.k + 1),
sheeted AS (SELECT doc_id, 0 AS seq, path || ' > 概览' AS title_path, title || '数据表：' || path || '，共 ' || n || ' 行数据。' || chr(10) || '字段：' || array_to_string(head, '、') || chr(10) || CASE WHEN n > 0 THEN '示例数据（前 ' || least(3, n) || ' 行）：' || chr(10) || top || chr(10)
    || (SELECT string_agg(x, chr(10) ORDER BY k) FROM srow s WHERE s.doc_id = sh.doc_id AND k <= 3) ELSE '' END AS content FROM sh
  UNION ALL SELECT doc_id, g, any_value(path) || ' > 数据行 ' || min(k) || '-' || max(k), any_value(fixed) || chr(10) || string_agg(x, chr(10) ORDER BY k) FROM grp JOIN srow USING (doc_id, k) GROUP BY doc_id, g)"""


_AS_CHUNKS = "SELECT doc_id, CAST(seq AS INT) AS seq, doc_id || '-c' || lpad(CAST(seq AS VARCHAR), 4, '0') AS chunk_id, title_path, CAST(NULL AS INT) AS page, CAST(length(content) AS INT) AS char_count, content FROM "
_SECTIONS = "SELECT doc_id, source || '.md' AS name, '# ' || source || chr(10) || replace(replace(text, '. ', '.' || chr(10) || chr(10)), ', ', CASE WHEN doc_id % 2 = 0 THEN chr(10) || '### 4.1. ' ELSE chr(10) END) AS text FROM documents"


@query("WITH RECURSIVE " + structure_sql(_SECTIONS) + _AS_CHUNKS.replace("SELECT", " SELECT", 1) + "structured")
def chunk_structure(spark, sf):
    mark = F.when(F.col("doc_id") % 2 == 0, "\n### 4.1. ").otherwise("\n")
    text = F.concat(F.lit("# "), "source", F.lit("\n"), F.replace(F.replace("text", F.lit(". "), F.lit(".\n\n")), F.lit(", "), mark))
    return chunking.structure(table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(".md")).alias("name"), text.alias("text")))


_PARTS = "SELECT p_partkey % 20 AS doc_id, 'parts-' || p_partkey % 20 || '.csv' AS name, 'parts' AS sheet, ['key', 'name'] AS head, list([CAST(p_partkey AS VARCHAR), p_name] ORDER BY '| ' || p_partkey || ' | ' || p_name || ' |') AS rows FROM part GROUP BY ALL"


@query("WITH RECURSIVE " + sheet_sql(_PARTS) + _AS_CHUNKS.replace("SELECT", " SELECT", 1) + "sheeted")
def chunk_spreadsheet(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("doc_id"), F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.lit(" |")).alias("row"))
    body = rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("row")), "\n").alias("b"))
    docs = body.select("doc_id", F.concat(F.lit("parts-"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"), F.concat(F.lit("## parts\n| key | name |\n| --- | --- |\n"), "b").alias("text"))
    return chunking.spreadsheet(docs)


_SHEETS = """SELECT doc_id, name, '' AS sheet, ['a', 'b'] AS head, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l || ' | x', '|'), lambda c: trim(c, chr(9) || chr(13) || ' '))) AS rows FROM document WHERE file_type = 'CSV'"""
_TEXTS = "SELECT doc_id, name, text FROM document WHERE file_type <> 'CSV'"


@query(f"WITH RECURSIVE {DOCUMENTS}, " + sheet_sql(_SHEETS) + ", " + structure_sql(_TEXTS) + _AS_CHUNKS.replace("SELECT", " SELECT", 1) + "(SELECT * FROM sheeted UNION ALL SELECT * FROM structured)")
def chunk_route(spark, sf):
    d = documents(spark, sf).withColumn("text", F.when(F.col("file_type") == "CSV", F.concat(F.lit("| a | b |\n| --- | --- |\n| "), F.replace("text", F.lit("\n"), F.lit(" | x |\n| ")), F.lit(" | x |"))).otherwise(F.col("text")))
    return chunking.route(d, "STRUCTURE")


def place_sql(word: str) -> str:
    return f"CAST('0x' || substr(md5({word}), 1, 8) AS BIGINT) % {embedding.DIMS}"


def _search_sql(asked: str) -> str:
    """Chunks, both channels over them, fusion, validity of their documents, rerank and the first six for asked (query_id, text)."""
    words = _WORDS.format
    return f"""{DOCUMENTS}, {_CHUNKS}, asked AS ({asked}),
passage AS (SELECT chunk_id AS id, doc_id, '章节：' || title_path || chr(10) || chr(10) || content AS text FROM chunk),
ptok AS (SELECT id, doc_id, {words("text")} AS ts FROM passage), qtok AS (SELECT query_id, {words("text")} AS ts FROM asked),
pv AS (SELECT id, place, count(*)::DOUBLE AS n FROM (SELECT id, {place_sql("w")} AS place FROM (SELECT id, unnest(ts) AS w FROM ptok)) GROUP BY ALL), qv AS (SELECT query_id, place, count(*)::DOUBLE AS n FROM (SELECT query_id, {place_sql("w")} AS place FROM (SELECT query_id, unnest(ts) AS w FROM qtok)) GROUP BY ALL),
pn AS (SELECT id, sqrt(sum(n * n)) AS norm FROM pv GROUP BY id), qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qv GROUP BY query_id),
dots AS (SELECT query_id, id, sum(q.n * p.n) AS d FROM qv q JOIN pv p USING (place) GROUP BY ALL),
vpairs AS (SELECT a.query_id, p.id, round((1 + coalesce(d / (qn.norm * pn.norm), 0)) / 2, 6) AS score FROM asked a CROSS JOIN passage p LEFT JOIN dots ON dots.query_id = a.query_id AND dots.id = p.id LEFT JOIN qn ON qn.query_id = a.query_id LEFT JOIN pn ON pn.id = p.id),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vpairs) WHERE rank <= 30),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM ptok), qterm AS (SELECT DISTINCT query_id, unnest(ts) AS term FROM qtok),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM ptok) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
lscore AS (SELECT q.query_id, p.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / s.avgdl))), 6) AS score FROM qterm q JOIN dfs d USING (term) JOIN post p USING (term) CROSS JOIN stats s GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lscore) WHERE rank <= 30),
both_ AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, v.rank AS vector_rank, l.rank AS bm25_rank, round(coalesce(1 / (60.0::DOUBLE + v.rank), 0) + coalesce(1 / (60.0::DOUBLE + l.rank), 0), 9) AS fused_score FROM vec v FULL OUTER JOIN lex l ON v.query_id = l.query_id AND v.id = l.id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(vector_rank, bm25_rank + 1000000000), id) AS fused_rank FROM both_),
pre AS (SELECT f.*, p.text, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS pre_rank FROM fused f JOIN passage p USING (id) WHERE fused_rank <= 30 AND p.doc_id % 3 <> 0),
scored AS (SELECT p.* EXCLUDE (text), round(coalesce(len(list_intersect(qw, list_distinct({words("substr(text, 1, 800)")}))) / len(qw), 0), 6) AS score FROM (SELECT pre.*, list_distinct(q.ts) AS qw FROM pre JOIN qtok q USING (query_id)) p),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pre_rank) AS final_rank FROM scored)
SELECT query_id, id AS chunk_id, vector_rank, bm25_rank, fused_rank, final_rank, score, score >= 0.30 AS passed FROM top WHERE final_rank <= 6"""


def _search(spark, sf, asked):
    """Both channels, fusion, validity, rerank and final hits over chunks; every step uses the same question."""
    chunks = chunking.length_overlap(documents(spark, sf))
    # What is searched is the chunk with its metadata, what is answered from is the content alone.
    passages = cut(chunks.select(F.col("chunk_id").alias("id"), "doc_id", tx.enrich("content", "title_path", "title_path").alias("text")), "passages")
    vec = retrieval.vector(embedding.embed(passages, "id", "text"), embedding.embed(asked, "query_id", "text"))
    texts = passages.select(F.col("id").alias("doc_id"), "text")
    fused = cut(retrieval.fuse(vec, retrieval.bm25(texts, asked)), "fused")
    alive = passages.select(F.col("id").alias("chunk"), "doc_id").join(active(spark, sf), "doc_id").select(F.col("chunk").alias("doc_id"), "is_active")
    top = retrieval.final(retrieval.rerank(retrieval.valid(retrieval.candidates(fused), alive), asked, texts))
    return top.select("query_id", F.col("id").alias("chunk_id"), "vector_rank", "bm25_rank", "fused_rank", "final_rank", "score", "passed")


@query("WITH " + _search_sql("SELECT item_id AS query_id, text FROM benchmark"))
def chunk_search(spark, sf):
    return _search(spark, sf, questions(spark, sf))


@query("WITH " + _search_sql("SELECT item_id AS query_id, CASE WHEN item_id % 4 > 1 AND item_id % 3 <> 0 THEN 'again: ' || substr(text, 1, 50) ELSE text END AS text FROM benchmark"))
def chunk_search_rewritten(spark, sf):
    i = F.col("query_id")
    text = F.when(i % 4 == 0, "").when(i % 4 == 1, F.repeat(F.lit("x"), F.lit(201))).otherwise(F.concat(F.lit("again: "), F.substring("text", 1, 50)))
    asked, _ = answer.effective_query(F.col("text"), F.when(i % 3 == 0, 0).otherwise(2), F.lit(True), F.lit(True), text)
    return _search(spark, sf, questions(spark, sf).select("query_id", asked.alias("text")))
