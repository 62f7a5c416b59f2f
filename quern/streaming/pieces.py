"""Event streams that arrive in pieces: what a piece leaves unfinished is state, kept until the next one."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Of a stream: the piece that is due, events so far, an unfinished line, the name and data lines of an unfinished event, and pieces that came too early.
STATE = "due long, events long, line string, name string, data string, early string"


def _read(held: dict, text: str, end: bool) -> Iterator[tuple[str, str]]:
    """The events (name, data) that the text finishes; held is brought up to date."""
    *lines, held["line"] = (held["line"] + text).split("\n")
    if end:
        # The last line counts without a line feed, and the event without an empty line.
        lines += [held["line"], ""]
        held["line"] = ""
    for line in (x.removesuffix("\r") for x in lines):
        field, _, value = line.partition(":")
        if field == "data":
            held["data"].append(value.removeprefix(" "))
        elif field == "event":
            held["name"] = value.removeprefix(" ")
        elif line == "":
            if held["data"]:
                yield held["name"] or "message", "\n".join(held["data"])
            held["name"], held["data"] = "", []


def parse_pieces(pieces: DataFrame) -> DataFrame:
    """(stream_id, i, event, data) of a stream of pieces (stream_id, seq, piece): the events of the pieces joined in the order of seq, from 0.

    However a body is cut, the events are those of the whole one, and each comes
    out in the micro-batch that finishes it; i counts them from 0. A piece that
    comes before its turn waits in the state, one that repeats a seq is
    ignored. A null piece ends its stream: what is unfinished then counts as
    finished, and the state goes but for a mark. Pieces without a stream_id or
    seq are left out; an empty stream gives no rows.
    """
    id_type = pieces.schema["stream_id"].dataType.simpleString()

    def step(key, frames, state: GroupState):
        held = dict(zip(("due", "events", "line", "name", "data", "early"), state.get if state.exists else (0, 0, "", "", "[]", "{}"), strict=True))
        held["data"], early = json.loads(held["data"]), json.loads(held["early"])
        for frame in frames:
            for seq, piece in zip(frame["seq"], frame["piece"], strict=True):
                if seq >= held["due"] >= 0:
                    early.setdefault(str(seq), piece)
        out = []
        while (at := str(held["due"])) in early:
            piece = early.pop(at)
            for name, data in _read(held, piece or "", piece is None):
                out.append((*key, held["events"], name, data))
                held["events"] += 1
            held["due"] = -1 if piece is None else held["due"] + 1  # after the end nothing is due
        if held["due"] < 0:
            early = {}
        state.update((held["due"], held["events"], held["line"], held["name"], json.dumps(held["data"]), json.dumps(early)))
        yield pd.DataFrame(out, columns=["stream_id", "i", "event", "data"])

    source = pieces.select("stream_id", "seq", "piece").where("stream_id is not null and seq is not null")
    return source.groupBy("stream_id").applyInPandasWithState(step, f"stream_id {id_type}, i long, event string, data string", STATE, "append", GroupStateTimeout.NoTimeout)
