"""Documents into chunks: (doc_id, seq, chunk_id, title_path, page, char_count, content)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import HEADING, HEADING_NUMBER, is_blank

#: Bounds and defaults of a chunk's length and overlap.
LENGTHS, OVERLAPS, DEFAULT = (200, 4000), (0, 500), (800, 100)
CHUNK = "doc_id {id}, seq int, chunk_id string, title_path string, page int, char_count int, content string"


def config_error(strategy, max_length, overlap):
    """Why a configuration is refused, or null. Null members take the defaults."""
    s, m, o = F.coalesce(strategy, F.lit("LENGTH_OVERLAP")), F.coalesce(max_length, F.lit(DEFAULT[0])), F.coalesce(overlap, F.lit(DEFAULT[1]))
    return (
        F.when(~s.isin("LENGTH_OVERLAP", "STRUCTURE"), "strategy")
        .when(~m.between(*LENGTHS), "max_length")
        .when(~o.between(*OVERLAPS), "overlap")
        .when(o >= m, "overlap_not_below_max_length")
    )


def length_overlap(docs: DataFrame, max_length: int = DEFAULT[0], overlap: int = DEFAULT[1], keep: tuple[str, ...] = ()) -> DataFrame:
    """Windows of max_length characters, each starting max_length - overlap after the last; the first that reaches the end is the last. A chunk has the
    columns `keep` of its document, too."""
    step = max_length - overlap
    if not 0 <= overlap < max_length:
        raise ValueError("overlap must be at least 0 and below the length")

    def windows(name: str, text: str) -> Iterator[tuple]:
        for at in range(0, max(1, len(text) - overlap), step):
            yield name, None, text[at : at + max_length]

    return _cut(docs, windows, keep)


_HEADING, _NUMBER = re.compile(HEADING), re.compile(HEADING_NUMBER)


class _Packer:
    """Gathers pieces of a block and gives them out as chunks."""

    def __init__(self):
        self.out: list[tuple] = []
        self.open = False
        self.start("", None)
        self.open = False

    def start(self, title, page, text=""):
        self.title, self.page, self.text, self.open = title, page, text, True

    def close(self):
        if self.open and self.text.strip():
            self.out.append((self.title, self.page, self.text))
        self.open = False


def structure_chunks(name: str, text: str, max_length: int, paged: bool = False) -> list[tuple]:
    """(title, page, content) of the chunks of a text with headings.

    A heading opens a block; lines join the open one, after an empty line if one
    stood between, as long as it stays within max_length, else they open another
    under the same title. A longer line is cut hard; the pages of its pieces are
    those of a length after the line's start. Form feeds separate pages.
    """
    starts = [0] + [m.end() for m in re.finditer("\f", text)] if paged else []
    page_of = (lambda at: max(1, bisect_right(starts, at))) if starts else (lambda at: None)
    counts, title, at, gap = [0] * 7, name, 0, False
    pack = _Packer()
    for line in text.replace("\f", "\n").split("\n"):
        here, at = at, at + len(line) + 1
        if not line.strip():
            gap = gap or pack.open
            continue
        if m := _HEADING.fullmatch(line):
            pack.close()
            level = len(m[1])
            counts = counts[:level] + [counts[level] + 1] + [0] * (6 - level)
            label = _NUMBER.sub("", m[2], count=1)
            title = f"{name} > {'.'.join(map(str, counts[1 : level + 1]))}. {label if label.strip() else m[2]}"
            pack.start(title, page_of(here), line)
        else:
            joint = ("\n\n" if gap else "\n") if pack.open else ""
            if pack.open and len(pack.text) + len(joint) + len(line) > max_length:
                pack.close()
            if not pack.open:
                pack.start(title, page_of(here))
                joint = ""
            pack.text += joint + line
            while len(pack.text) > max_length:
                rest, pack.text = pack.text[max_length:], pack.text[:max_length]
                pack.close()
                pack.start(pack.title, page_of(here + max_length), rest)
        gap = False
    pack.close()
    return pack.out


def _cells(line: str) -> list[str]:
    line = line.strip()
    return [c.strip() for c in line[line.startswith("|") : len(line) - (line.endswith("|") and len(line) > 1)].split("|")]


def _row(cells: list[str]) -> str:
    return "".join(f"| {c} " for c in cells) + "|"


#: The texts of a sheet's chunks.
CONTEXT, ROWS_OF, FIELDS, SAMPLE, SUMMARY, RANGE = "数据表：", "，共 {} 行数据。\n", "字段：", "示例数据（前 {} 行）：\n", "概览", "数据行 "


def sheet_chunks(name: str, text: str, max_length: int) -> list[tuple]:
    """(title, page, content) of pipe tables: for each sheet a summary, then its rows in groups that fit in max_length with the repeated head. A longer
    row is a group of its own."""
    sheets: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if m := _HEADING.fullmatch(line):
            sheets.append((m[2].strip(), []))
        elif line.strip().startswith("|"):
            sheets[-1][1].append(line)
    out = []
    for sheet, lines in sheets:
        if not lines:
            continue
        head, rows = _cells(lines[0]), [_cells(x) for x in lines[2:]]
        rows = [r + [""] * (len(head) - len(r)) for r in rows]
        path = f"{name} > {sheet}" if sheet else name
        top = f"{_row(head)}\n{'| --- ' * len(head)}|"
        body = (f"## {sheet}\n\n" if sheet else "") + CONTEXT + path + ROWS_OF.format(len(rows)) + FIELDS + "、".join(head) + "\n"
        if rows:
            few = rows[:3]
            body += SAMPLE.format(len(few)) + "\n".join([top, *map(_row, few)])
        out.append((f"{path} > {SUMMARY}", None, body))
        fixed = f"{CONTEXT}{path}\n{top}"
        first, group, size = 1, [], len(fixed)
        for number, row in enumerate(map(_row, rows), 1):
            if group and size + 1 + len(row) > max_length:
                out.append((f"{path} > {RANGE}{first}-{number - 1}", None, "\n".join([fixed, *group])))
                first, group, size = number, [], len(fixed)
            group.append(row)
            size += 1 + len(row)
        if group:
            out.append((f"{path} > {RANGE}{first}-{len(rows)}", None, "\n".join([fixed, *group])))
    return out


def _cut(docs: DataFrame, cut: Callable[[str, str], Iterable[tuple]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of each text that is not blank, in one pass over it. What follows a line depends on all lines before it, which is no window or join, so
    this runs on Arrow batches; few texts' chunks are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(k, i, f"{doc}-c{i:04d}", t, p, len(c), c) for k, (doc, name, text) in enumerate(zip(*(x.to_pylist() for x in part.columns[:3]), strict=True)) for i, (t, p, c) in enumerate(cut(name, text))]
                owner, *columns = zip(*rows, strict=True) if rows else [()] * 7
                types = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                first, *rest = (part.column(i).take(pa.array(owner, pa.int64())) for i in (0, *range(3, part.num_columns)))
                yield pa.RecordBatch.from_arrays([first, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)], *rest], names=names)

    names = ["doc_id", "seq", "chunk_id", "title_path", "page", "char_count", "content", *keep]
    source = docs.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), "text", *keep).where(~is_blank("text"))
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, CHUNK.format(id=docs.schema["doc_id"].dataType.simpleString()) + kept)


def structure(docs: DataFrame, max_length: int = DEFAULT[0], paged: bool = False) -> DataFrame:
    return _cut(docs, lambda name, text: structure_chunks(name, text, max_length, paged))


def spreadsheet(docs: DataFrame, max_length: int = DEFAULT[0]) -> DataFrame:
    return _cut(docs, lambda name, text: sheet_chunks(name, text, max_length))


def route(docs: DataFrame, strategy: str = "LENGTH_OVERLAP", max_length: int = DEFAULT[0], overlap: int = DEFAULT[1]) -> DataFrame:
    """Chunks by type: tables (file_type XLSX or CSV) always as sheets, everything else by the strategy."""
    table = F.coalesce(F.col("file_type").isin("XLSX", "CSV"), F.lit(False))
    rest = docs.where(~table)
    text = structure(rest, max_length) if strategy == "STRUCTURE" else length_overlap(rest, max_length, overlap)
    return spreadsheet(docs.where(table), max_length).unionByName(text)
