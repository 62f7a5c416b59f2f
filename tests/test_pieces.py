"""Event streams in pieces: any cut gives the events of the whole body, state outlives a restart, and outputs of streams are known to `shared.clean`."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern import shared
from quern.operators import catalog
from quern.streaming import events as ev
from quern.streaming import pieces

BODY = ": ping\n\nevent: stage\ndata: a\r\ndata:  b\r\n\r\ndata\nevent:\n\nevent: lost\n\nid: 7\ndata:c:d\rx\n\n\n\nevent: done\ndata: end"
WANT = [("stage", "a\n b"), ("message", ""), ("message", "c:d\rx"), ("done", "end")]


def read(parts):
    held = {"line": "", "name": "", "data": []}
    return [e for k, p in enumerate([*parts, ""]) for e in pieces._read(held, p, k == len(parts))]


def test_every_cut_gives_the_same_events():
    assert read([BODY]) == WANT
    for a, b in itertools.combinations(range(len(BODY) + 1), 2):
        assert read([BODY[:a], BODY[a:b], BODY[b:]]) == WANT
    assert read(list(BODY)) == WANT


@settings(max_examples=200, deadline=None)
@given(st.text("ab:\n\r e", max_size=40).flatmap(lambda t: st.tuples(st.just(t), st.lists(st.integers(0, len(t)), max_size=5))))
def test_any_text_and_cut(case):
    text, cuts = case
    at = [0, *sorted(cuts), len(text)]
    assert read([text[a:b] for a, b in itertools.pairwise(at)]) == read([text])


def test_the_batch_parser_agrees(spark):
    b = spark.createDataFrame([(1, BODY + "\n\n"), (2, ""), (3, "data: x\n\n")], "stream_id int, body string")
    got = [(r.stream_id, r.event, r.data) for r in catalog.parse_events(b).orderBy("stream_id", "i").collect()]
    assert got == [*((1, *w) for w in WANT), (3, "message", "x")]


def write(spark, path, rows):
    spark.createDataFrame(rows, "stream_id string, seq long, piece string, event string").coalesce(1).write.mode("append").parquet(path)


def run(spark, path, name):
    stream = spark.readStream.schema("stream_id string, seq long, piece string, event string").option("maxFilesPerTrigger", 1).parquet(path)
    return sorted(tuple(r) for r in ev.run_once(pieces.parse_pieces(stream), f"{path}-out", "append", name).collect())


def test_state_outlives_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    write(spark, path, [("a", 0, "data: on", "x"), ("b", 1, "late\n\n", "x"), ("a", 2, "x\n\nevent: e\n", "x"), (None, 0, "data: n\n\n", "x"), ("c", 0, None, "x")])
    assert run(spark, path, "s") == []
    write(spark, path, [("a", 1, "e\ndata: ", "x"), ("b", 0, "data: ", "x"), ("a", 1, "again", "x"), ("c", 1, "data: after the end\n\n", "x")])
    assert run(spark, path, "s") == [("a", 0, "message", "one\nx"), ("b", 0, "message", "late")]
    write(spark, path, [("a", 3, "data: y", "x"), ("a", 4, None, "x")])
    assert run(spark, path, "s") == [("a", 0, "message", "one\nx"), ("a", 1, "e", "y"), ("b", 0, "message", "late")]
    assert run(spark, path, "s") == [("a", 0, "message", "one\nx"), ("a", 1, "e", "y"), ("b", 0, "message", "late")]


def test_outputs_of_streams_go_with_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    write(spark, path, [("a", 0, "data: x\n\n", "x")])
    before = len(shared.WRITTEN)
    assert run(spark, path, None) == [("a", 0, "message", "x")]
    made = shared.WRITTEN[before:]
    assert len(made) == 2 and list(tmp_path.glob("in-out/stream-*"))
    shared.delete(spark, made)
    assert not list(tmp_path.glob("in-out/stream-*"))


@pytest.mark.parametrize("rows", [[], [("a", 0, None, "x")], [("a", 5, "data: early\n\n", "x")]])
def test_nothing_comes_of_it(spark, tmp_path, rows):
    path = f"file://{tmp_path}/in"
    write(spark, path, rows)
    assert run(spark, path, None) == []
