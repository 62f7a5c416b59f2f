"""Operator 13 against plain loops over all anchors and rows, with small blocks and chunks."""

import math

import numpy as np
import pytest

from quern.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA)


def plain(rows, scale=256, positives=5, negatives=3):
    taking = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = [math.floor(scale * float(np.float32(c))) for c in v]
        taking[i] = min(taking.get(i, (str(label), x)), (str(label), x))
    out = []
    for a in taking:
        if a % 50:
            continue
        label, x = taking[a]
        scores = {b: sum(p * q for p, q in zip(x, y, strict=True)) for b, (_, y) in taking.items() if b != a and len(x) == len(y)}
        order = sorted(scores, key=lambda b: (-scores[b], b))
        for p in [b for b in order if taking[b][0] == label][:positives]:
            inside = [b for b in order if taking[b][0] != label and 50 * scores[p] <= 100 * scores[b] <= 95 * scores[p]]
            out += [(a, p, r, b, scores[p], scores[b]) for r, b in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", [(128, 2048, 32, 4), (3, 7, 2, 1), (2, 5, 3, 2)])
def test_against_loops(spark, monkeypatch, shape):
    for name, value in zip(("ANCHORS", "ROWS", "CHUNK", "CELL"), shape, strict=True):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 9))
    rows = [(i * 5, [float(c) for c in centres[i % 4] + rng.normal(size=9)], int(i % 11 > 3)) for i in range(120)]
    rows += [(1000 + 50 * i, [0.5] * 9, i % 2) for i in range(8)]  # ties
    rows += [(1, rows[0][1], 0), (1, rows[0][1], 0), (1, [9.0] * 9, 3), (50, [0.1] * 9, 7)]  # repeats
    rows += [(2, None, 1), (3, [1.0] * 9, None), (None, [1.0] * 9, 1), (4, [float("nan")] + [1.0] * 8, 1), (6, [None] * 9, 1), (7, [float("inf")] * 9, 1), (5000, [1.0, 2.0], 1), (5001, [1.0, 3.0], 1), (5002, [1.0, 1.0], 2), (5050, [], 1), (5051, [], 1), (5052, [], 2)]
    out = hardneg.hard_negatives(frame(spark, rows).repartition(3), "vec_id % 50 = 0")
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, out.collect())) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [1.0], 1)], [(50, [1.0], 1), (51, [-1.0], 1), (52, [1.0], 2)], [(1, [1.0], 1), (2, [0.9], 2)]])
def test_nothing_found(spark, rows):
    assert hardneg.hard_negatives(frame(spark, rows), "vec_id % 50 = 0").collect() == plain(rows) == []


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (1, 300, 1 << 24):
        a, b = rng.integers(-most, most + 1, (5, 33)).astype(np.int32), rng.integers(-most, most + 1, (4, 33)).astype(np.int32)
        want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
        tile = hardneg.product(a, b, most * most)
        assert tile.tolist() == want and hardneg.wide(hardneg.narrow(tile), tile.shape).tolist() == want


def test_a_label_of_any_size_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS", 4)
    rows = spark.range(400).selectExpr("id", "'a' as label", "array(1, 2) as x")
    made = hardneg.blocks(rows, 4, True).collect()
    assert sum(r.m for r in made) == 400 and max(r.m for r in made) == 4 and len({r.block >> 32 for r in made}) >= 20


@pytest.mark.parametrize("same_label", [True, False])
def test_no_side_goes_through_the_driver(spark, same_label):
    """However small the files of both sides are, the copies of a block for each column or row of the grid are not."""
    rows = spark.range(60).selectExpr("id", "'a' as label", "array(1, 2) as x")
    made = hardneg.tiles(hardneg.blocks(rows, 4, same_label), hardneg.blocks(rows, 4, same_label), same_label)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sum(r.a_m * r.b_m for r in made.select("a_m", "b_m").collect()) == 3600


def test_anchors_by_turns(spark, monkeypatch):
    for name, value in (("ANCHORS", 2), ("ROWS", 16), ("ROUND", 400)):
        monkeypatch.setattr(hardneg, name, value)
    begun, whole = [], hardneg.tiles
    monkeypatch.setattr(hardneg, "tiles", lambda *a: begun.append(1) or whole(*a))
    rng = np.random.default_rng(5)
    rows = [(i * 10, [float(c) for c in rng.normal(size=4)], int(i % 3)) for i in range(60)]
    assert sorted(map(tuple, hardneg.hard_negatives(frame(spark, rows), "vec_id % 50 = 0").collect())) == plain(rows)
    assert len(begun) >= 4


def test_a_tile_takes_16_bits_a_cell():
    """A few cells that need more, of near copies, go beside it."""
    tile = np.random.default_rng(2).integers(-(1 << 15), 1 << 15, (20, 50))
    assert len(hardneg.narrow(tile)) == 2000
    tile[3, 7], tile[19, 49] = 1 << 40, -(1 << 15) - 1
    assert len(hardneg.narrow(tile)) == 2032 and (hardneg.wide(hardneg.narrow(tile), tile.shape) == tile).all()
