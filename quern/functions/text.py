"""Text functions, Column to Column. Lengths and places count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that stripping removes, beyond what trim() does.
SPACE = r"[\s\x0B\x1C-\x1F\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
#: The start of a word-free line that numbers a heading, such as "2.1. ".
HEADING_NUMBER = r"^\s*\d+(?:\.\d+)*\.?\s*"
#: A heading of one to six number signs.
HEADING = r"^(#{1,6})\s+(.*\S|\S)\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return strip_of(c, SPACE)


def strip_of(c: str | Column, space: str) -> Column:
    """A text without what a class of characters has at its ends. A dollar would also hold before a last line end outside the class, and without the look behind a run inside a text were searched from each of its places."""
    return F.regexp_replace(col(c), rf"^{space}+|(?<!{space}){space}+\z", "")


def is_blank(c: str | Column) -> Column:
    """Whether nothing is left of a text that is stripped; the search ends at its first sign."""
    return F.coalesce(~F.rlike(col(c), F.lit(f"[^{SPACE[1:]}")), F.lit(True))


def clean_text(c: str | Column) -> Column:
    """Byte order marks gone, line ends as line feeds, no blanks at ends of lines, at most one empty line, stripped; null gives an empty text."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), "﻿", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    text = F.regexp_replace(text, "[ \t]+(?=\n|$)", "")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def content_hash(c: str | Column, edge: str = SPACE, inner: str = r"\s", of_blank: bool = False) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the stripped text with runs of white space as one blank; null for a blank text, unless told to hash it.

    edge and inner are the classes of what is stripped and of what makes such a run.
    """
    digits = F.substring(F.sha2(F.regexp_replace(strip_of(c, edge), f"{inner}+", " ").cast("binary"), 256), 1, 16)
    return digits if of_blank else F.when(~is_blank(c), digits)


def strip_heading_number(c: str | Column) -> Column:
    bare = F.regexp_replace(col(c), HEADING_NUMBER, "")
    return F.when(col(c).isNull(), F.lit("")).when(is_blank(bare), col(c)).otherwise(bare)


def extension(name: str | Column) -> Column:
    """What follows the last full stop, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(col(name), F.lit("")), r"\.([^.]*)$", 1))


def chunk_id(doc: str | Column, seq: str | Column) -> Column:
    return F.format_string("%s-c%04d", col(doc).cast("string"), col(seq).cast("int"))


def enrich(content: str | Column, title: str | Column, document: str | Column) -> Column:
    """The content after lines that name its document, unless the title does, and its section."""
    named = ~is_blank(document)
    titled = ~is_blank(title)
    covered = F.coalesce(titled & named & F.startswith(col(title), col(document)), F.lit(False))
    head = F.concat(
        F.when(named & ~covered, F.concat(F.lit("文档："), col(document), F.lit("\n"))).otherwise(""),
        F.when(titled, F.concat(F.lit("章节："), col(title), F.lit("\n"))).otherwise(""),
    )
    return F.when(col(content).isNull(), "").otherwise(F.concat(head, F.when(head != "", "\n").otherwise(""), col(content)))


def pipe_cells(line: str | Column) -> Column:
    """The stripped cells of a line of a pipe table."""
    inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
    return F.transform(F.split(inner, r"\|", -1), strip)


def pipe_line(cells: str | Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(col(cells), " | "), F.lit(" |"))


def tokens(c: str | Column) -> Column:
    """Words in lower case: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def preview(c: str | Column, most: int) -> tuple[Column, Column]:
    """The first `most` characters, and whether there are more."""
    return F.substring(col(c), 1, most), F.coalesce(F.length(col(c)) > most, F.lit(False))
