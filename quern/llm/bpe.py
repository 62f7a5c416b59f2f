"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import slices, utf8

#: Characters of a text that are handed to the library at once, about.
PIECE = 1 << 16
#: White space in one run that is taken as the pattern would, without the pattern.
RUN = 1 << 12
_CODERS: dict = {}


def coder(path: str, pattern: str):
    """The encoding of a rank file, loaded once a process."""
    import tiktoken

    if (path, pattern) not in _CODERS:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _CODERS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path, pattern]


def safe_pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of about size characters that encode apart as they do together.

    The splitting pattern has white space only at the start of a match or
    throughout it, and never a letter beside a digit. So no match goes on from
    ink to white space, from letter to digit or from digit to letter, and what
    follows such a place is matched as at the start of a text. A run without
    such a place stays whole.
    """
    import regex

    at = 0
    safe = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
    while len(text) - at > size:
        if not (found := safe.search(text, at + size)):
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def parts(text: str, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """text in pieces that encode apart, and whether a piece is one match: all of a long run of white space but a last one before ink.

    The pattern takes these as one match, by looking ahead and back again,
    which the library does in as many nested calls as the run has characters.
    """
    import regex

    at = 0
    for found in regex.finditer(rf"\s{{{run},}}+", text):
        end = found.end() - (found.end() < len(text))
        if found.start() > at:
            yield from ((p, False) for p in safe_pieces(text[at : found.start()]))
        yield text[found.start() : end], True
        at = end
    if at < len(text):
        yield from ((p, False) for p in safe_pieces(text[at:]))


def encode_text(text: str, enc) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [token for piece, match in parts(text) for token in (enc._encode_single_piece(piece) if match else enc.encode_ordinary(piece))]


def _run(fn, df: DataFrame, id_col: str, in_col, out_fields: list[T.StructField]) -> DataFrame:
    source = df.select(F.col(id_col), utf8(in_col).alias("__in"))
    schema = T.StructType([source.schema[0], *out_fields])

    def over(batches):
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                columns = fn(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

    return source.mapInArrow(over, schema)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """One row for each row of df: its id, `ids` (token ids as little-endian unsigned 32-bit integers, packed) and, if asked for, `decoded`, the bytes that the ids stand for.

    Null and empty texts have no ids. Bytes that are no UTF-8 are read as
    U+FFFD. Special tokens are never made. Rows with equal or null ids are rows
    of their own; an empty table gives an empty table. Texts of any length are
    cut only where the pattern always splits (parts, safe_pieces), so ids are
    those of the whole text; a run of white space of any length is one piece.
    """
    import numpy as np

    fields = [T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * with_decoded]

    def run(texts):
        enc = coder(path, pattern)
        ids = [encode_text(t.decode("utf-8", "replace"), enc) for t in texts.to_pylist()]
        out = [pa.array([np.asarray(x, "<u4").tobytes() for x in ids], pa.binary())]
        if with_decoded:
            out.append(pa.array([enc.decode_bytes(x) for x in ids], pa.binary()))
        return out

    return _run(run, df, id_col, text_col, fields)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row for each row of df: its id and `decoded`, the raw bytes of its packed ids; null and empty ids give no bytes.

    Bytes are joined before anything reads them as text, so ids that split a
    code point decode to the bytes they came from. An id without a token is an
    error, as in the library.
    """
    import numpy as np

    def run(packed):
        enc = coder(path, pattern)
        return [pa.array([enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in packed.to_pylist()], pa.binary())]

    return _run(run, df, id_col, ids_col, [T.StructField("decoded", T.BinaryType())])
