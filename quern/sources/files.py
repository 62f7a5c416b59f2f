"""Files as sources: types by name and signature, texts, tables, office documents, pages, evaluation data."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from decimal import ROUND_HALF_UP, Decimal
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import HEADING, extension, is_blank

#: Types by extension, and what their files start with.
TYPES = {"txt": "TXT", "md": "MD", "csv": "CSV", "pdf": "PDF", "docx": "DOCX", "xlsx": "XLSX"}
MAGIC = {"PDF": b"%PDF-", "DOCX": b"PK\x03\x04", "XLSX": b"PK\x03\x04"}
PARSERS = {"TXT": "TextReader", "MD": "MarkdownParser", "CSV": "CsvParser", "PDF": "PdfParser", "DOCX": "DocxParser", "XLSX": "XlsxParser"}
#: Thresholds of the quality of a PDF's text: characters a page, share of empty pages, share of printable characters, share of U+FFFD; and the characters
#: below which a page is empty.
MIN_CHARS, MAX_EMPTY, MIN_PRINTABLE, MAX_GARBLED, EMPTY_PAGE = 50.0, 0.5, 0.85, 0.05, 10


def file_type(name: str | Column) -> Column:
    """The type by extension, null for others."""
    e = extension(name)
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(e == k, v).otherwise(out)
    return out


def signature_ok(kind: Column, content: Column) -> Column:
    """Whether binary content starts as its type does, or, for texts, is UTF-8."""
    out = F.is_valid_utf8(content.cast("string"))
    for k, v in MAGIC.items():
        out = F.when(kind == k, F.startswith(content, F.lit(v))).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, ok, content) of all files below a path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = file_type("path")
    return f.select("path", kind.alias("file_type"), F.coalesce(signature_ok(kind, F.col("content")), F.lit(False)).alias("ok"), "content")


def text_of(content: Column) -> Column:
    """UTF-8 without a leading byte order mark."""
    return F.regexp_replace(content.cast("string"), "^﻿", "")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, heading) of texts (doc_id, text)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(HEADING))
    return lines.select("doc_id", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("heading"))


def csv_rows(text: str) -> list[list[str]]:
    """Rows of stripped cells; quotes open only at a cell's start and hold no line ends; blank lines are none. Lines end with a line feed, before
    which a carriage return may stand, and with nothing else."""
    rows = []
    for line in re.split(r"\r?\n", text):
        if not line.strip():
            continue
        cells, at = [], 0
        while at <= len(line):
            m = re.compile(r'"((?:[^"]|"")*)("|$)([^,]*)|([^,]*)').match(line, at)
            cells.append(((m[1].replace('""', '"') + m[3]) if m[1] is not None else m[4]).strip())
            at = m.end() + 1
        rows.append(cells)
    return rows


def pipe_table(rows: list[list[str]]) -> str:
    """A pipe table of rows, the first as its head, all as wide as the widest."""
    width = max(map(len, rows))
    line = lambda r: "".join(f"| {c} " for c in r + [""] * (width - len(r))) + "|"
    return "\n".join([line(rows[0]), "| --- " * width + "|", *map(line, rows[1:])])


def parse_csv(content: bytes) -> str:
    rows = csv_rows(content.decode("utf-8").removeprefix("﻿"))
    if len(rows) < 2:
        raise ValueError("EMPTY_TABLE" if not rows else "HEADER_ONLY")
    return pipe_table([[c.replace("|", "/").strip() for c in r] for r in rows])  # a bar would end its cell


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(node, name: str):
    return [x for x in node.iter() if _local(x.tag) == name] if node is not None else []


#: Number formats that a workbook names by number only, as (decimals, thousands, percent), or a date.
FORMATS = {1: (0, False, False), 2: (2, False, False), 3: (0, True, False), 4: (2, True, False), 9: (0, False, True), 10: (2, False, True)}
DATES = {14: "%-m/%-d/%y", 15: "%-d-%b-%y", 16: "%-d-%b", 17: "%b-%y", 22: "%-m/%-d/%y %-H:%M"}


def number_text(value: str, number: int, code: str | None) -> str:
    """A stored number as a sheet shows it: by its format's decimals, thousands, percent or date; without a format, at most ten decimals."""
    try:
        x = float(value)
    except ValueError:
        return value
    shape, date = FORMATS.get(number), DATES.get(number)
    if code and code.lower() not in ("general", "@"):
        plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\\\.', "", code.split(";")[0])
        if re.search(r"[ymdhs]", plain.lower()):
            date = "%Y-%m-%d %H:%M:%S" if "h" in plain.lower() else "%Y-%m-%d"
        elif m := re.search(r"[#0][#0,]*(?:\.([#0]+))?", plain):
            shape = len(m[1] or ""), "," in m[0], "%" in plain
    if date:  # days since the end of 1899
        return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=x)).strftime(date)
    if shape:
        decimals, thousands, percent = shape
        scaled = (Decimal(value) * (100 if percent else 1)).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)
        return f"{scaled:{',' if thousands else ''}.{decimals}f}{'%' if percent else ''}"
    shown = f"{x:.10f}".rstrip("0").rstrip(".")
    return shown if abs(x) < 1e11 else f"{x:.5E}"


def parse_xlsx(content: bytes) -> str:
    """Each sheet with cells as a heading and a pipe table, cells as they are shown; formulas give the results that the file holds. Empty rows and columns
    are skipped, line ends within cells become blanks; bars stay."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in _named(s, "t")) for s in _named(_xml(z, "xl/sharedStrings.xml"), "si")]
        targets = {r.get("Id"): r.get("Target") for r in _named(_xml(z, "xl/_rels/workbook.xml.rels"), "Relationship")}
        styles = _xml(z, "xl/styles.xml")
        codes = {int(f.get("numFmtId")): f.get("formatCode") for f in _named(styles, "numFmt")}
        formats = [int(x.get("numFmtId", 0)) for g in _named(styles, "cellXfs")[:1] for x in g]
        parts = []
        for sheet in _named(_xml(z, "xl/workbook.xml"), "sheet"):
            rid = next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None)
            path = targets.get(rid, "").lstrip("/")
            root = _xml(z, path if path.startswith("xl/") else f"xl/{path}")
            rows = []
            for row in _named(root, "row"):
                cells: dict[int, str] = {}
                for c in _named(row, "c"):
                    column = 0
                    for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        column = column * 26 + ord(ch) - 64
                    kind, style = c.get("t", "n"), int(c.get("s", 0))
                    value = "".join(x.text or "" for x in c.iter() if _local(x.tag) == ("t" if kind == "inlineStr" else "v"))
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind == "n" and value:
                        number = formats[style] if style < len(formats) else 0
                        value = number_text(value, number, codes.get(number))
                    cells[column or len(cells) + 1] = value.replace("\n", " ").replace("\r", " ").strip()
                rows.append(cells)
            used = sorted({k for r in rows for k, v in r.items() if v})
            grid = [[r.get(k, "") for k in used] for r in rows if any(r.values())]
            if grid:
                parts.append(f"## {sheet.get('name')}\n\n{pipe_table(grid)}")
    if not parts:
        raise ValueError("EMPTY_WORKBOOK")
    return "\n\n".join(parts)


def _paragraph(node) -> str:
    """The text of a paragraph's runs, joined as they are; breaks and tabs between them become blanks."""
    return "".join((x.text or "") if _local(x.tag) == "t" else " " if _local(x.tag) in ("br", "cr", "tab") else "" for x in node.iter()).strip()


def parse_docx(content: bytes) -> str:
    """Paragraphs with text, a line each, those of a heading style as headings; tables as pipe tables with an empty line after them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _named(_xml(z, "word/document.xml"), "body")[0]
        out = ""
        for node in body:
            if _local(node.tag) == "tbl":
                rows = [[" ".join(filter(None, map(_paragraph, _named(c, "p")))) for c in _named(r, "tc")] for r in _named(node, "tr")]
                if rows and max(map(len, rows)):
                    out += pipe_table(rows) + "\n\n"
            elif _local(node.tag) == "p" and (text := _paragraph(node)):
                style = next((next(iter(s.attrib.values()), "") for s in _named(node, "pStyle")), "")
                m = re.fullmatch(r"(?:heading|标题)\s*([1-6])", style, re.IGNORECASE)
                out += (f"{'#' * int(m[1])} {text}" if m else text) + "\n"
    if not out.strip():
        raise ValueError("EMPTY_DOCUMENT")
    return out


def parse(files: DataFrame) -> DataFrame:
    """(path, file_type, text, error) of files (path, file_type, ok, content): each type has one parser, and one that fails is an error, never another's work.

    PDF bytes need a parser from outside; their pages come as texts with form feeds.
    """
    work = {"CSV": parse_csv, "XLSX": parse_xlsx, "DOCX": parse_docx, "TXT": lambda b: b.decode("utf-8").removeprefix("﻿"), "MD": lambda b: b.decode("utf-8").removeprefix("﻿")}

    def run(batches):
        for b in batches:
            text, error = [], []
            for kind, ok, content in zip(b["file_type"], b["ok"], b["content"], strict=True):
                try:
                    if kind not in work:
                        raise ValueError("UNSUPPORTED_FILE_TYPE")
                    if not ok:
                        raise ValueError("SIGNATURE_MISMATCH")
                    text.append(work[kind](bytes(content)))
                    error.append(None)
                except Exception as e:  # the error is the row's result
                    text.append(None)
                    error.append(str(e) or type(e).__name__)
            yield b[["path", "file_type"]].assign(text=text, error=error)

    return files.mapInPandas(run, "path string, file_type string, text string, error string")


def ocr_text(body: str | Column) -> Column:
    """The non-blank md_content members of a remote parser's JSON answer, an empty line between them; null for a malformed one."""
    c = F.col(body) if isinstance(body, str) else body
    found = F.from_json(c, "results array<struct<md_content:string>>")["results"]
    return F.array_join(F.filter(F.transform(found, lambda x: x["md_content"]), lambda t: ~is_blank(t)), "\n\n")


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text, start) of texts with form feeds; pages count from 1, and empty ones at the end count.

    Starts are running sums over a text's pages, taken in one pass where the text is.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, page, text, start = [], [], [], []
                for i, t in enumerate(b.column(1).slice(lo, 256).to_pylist(), lo):
                    if t is not None:
                        parts = t.split("\f")
                        ids += [i] * len(parts)
                        page += range(1, len(parts) + 1)
                        text += parts
                        start += accumulate((len(p) + 1 for p in parts[:-1]), initial=0)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(page, pa.int32()), pa.array(text, pa.string()), pa.array(start, pa.int32())], names=["doc_id", "page", "text", "start"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, page int, text string, start int")


def page_at(starts: Column, offset: Column) -> Column:
    """The page, from 1, with the largest start that is not beyond the offset."""
    return F.greatest(F.lit(1), F.size(F.filter(starts, lambda s: s <= offset)))


def text_layer(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with error: a paged text whose first page is blank, or none, comes from a scan and is not supported."""
    first = F.substring_index(F.col("text"), "\f", 1)
    return docs.withColumn("error", F.when(is_blank(first), "SCANNED_PDF_NOT_SUPPORTED"))


def write_parsed(docs: DataFrame, path: str) -> None:
    """Parsed texts (doc_id, file_type, text) as Parquet, for restoring without parsing again."""
    docs.select("doc_id", "file_type", "text").write.mode("overwrite").parquet(path)


def restore_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_parsed wrote: the pages of PDFs (empty ones at the end, too), and the headings of all texts but PDF and TXT."""
    back = spark.read.schema("doc_id long, file_type string, text string").parquet(path)
    return pages(back.where("file_type = 'PDF'")), headings(back.where("file_type not in ('PDF', 'TXT')"))


def pdf_metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, chars_per_page, empty_ratio, printable_ratio, garbled_ratio) of paged texts."""
    bare = F.regexp_replace("text", r"\s+", "")
    shown = F.regexp_replace(bare, r"[\p{Cc}\p{Co}\p{Cs}\p{Cf}]", "")
    p = pages(docs).select("doc_id", F.length(bare).alias("c"), F.length(F.regexp_replace(shown, "�", "")).alias("s"), (F.length(bare) - F.length(F.regexp_replace(bare, "�", ""))).alias("g"))
    m = p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("c").alias("chars"), F.count_if(F.col("c") < EMPTY_PAGE).alias("e"), F.sum("s").alias("s"), F.sum("g").alias("g"))
    # A text without ink has nothing that could not be printed.
    share = lambda x, none: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col("chars")), F.lit(none))
    return m.select("doc_id", "pages", "chars", (F.col("chars") / F.col("pages")).alias("chars_per_page"), (F.col("e") / F.col("pages")).alias("empty_ratio"), share("s", 1.0).alias("printable_ratio"), share("g", 0.0).alias("garbled_ratio"))


def pdf_route() -> Column:
    """The first reason that holds for parsing a PDF otherwise; TEXT_PDF if none does. Bounds themselves are fine."""
    return (
        F.when(F.col("chars_per_page") < MIN_CHARS, "LOW_TEXT_DENSITY").when(F.col("empty_ratio") > MAX_EMPTY, "TOO_MANY_EMPTY_TEXT_PAGES")
        .when(F.col("printable_ratio") < MIN_PRINTABLE, "LOW_TEXT_QUALITY").when(F.col("garbled_ratio") > MAX_GARBLED, "GARBLED_TEXT").otherwise("TEXT_PDF")
    )


#: The schema of an evaluation data set.
ANCHORED = "array<struct<doc_name:string,title_path:string,page:int,snippet:string,chunk_id:string,content_hash:string,anchor_path:string>>"
RAW = "question string, referenceAnswer string, answerable string, category string, evidence {a}, history array<struct<role:string,content:string>>, failureMode string, evidenceMode string, temptingEvidence {a}, missingRequirement string".format(
    a="array<struct<docName:string,titlePath:string,page:int,snippet:string,chunkId:string,contentHash:string,anchorPath:string>>"
)


def _items(raw: DataFrame) -> DataFrame:
    yes = F.lower(F.trim("answerable"))
    known = F.when(yes.isNull() | (yes == "true"), True).when(yes == "false", False)  # null for what is no Boolean: item_errors names it
    return raw.select(
        "question", F.col("referenceAnswer").alias("reference_answer"), known.alias("answerable"), "category", F.col("evidence").cast(ANCHORED).alias("evidence"), "history",
        F.col("failureMode").alias("failure_mode"), F.col("evidenceMode").alias("evidence_mode"), F.col("temptingEvidence").cast(ANCHORED).alias("tempting"), F.col("missingRequirement").alias("missing_requirement"),
    )


def read_eval_json(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array."""
    return _items(spark.read.schema(RAW).option("multiLine", "true").json(path))


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Items of a CSV with a header; evidence columns hold JSON, and history is not read."""
    f = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    if missing := {"question", "answerable", "category"} - set(f.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    have = lambda c: F.col(c) if c in f.columns else F.lit(None).cast("string")
    kind = RAW.split("evidence ")[1].split(", history")[0]
    return _items(
        f.select(
            *[have(c).alias(c) for c in ("question", "referenceAnswer", "answerable", "category", "failureMode", "evidenceMode", "missingRequirement")],
            *[F.from_json(have(c), kind).alias(c) for c in ("evidence", "temptingEvidence")], F.lit(None).cast("array<struct<role:string,content:string>>").alias("history"),
        )
    )
