"""Numbers within skewed groups against a window over each group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import numbering


def frame(spark, rows):
    return spark.createDataFrame(rows, "a string, b int, o long, x string, number string")


@pytest.mark.parametrize("ranges", [1, 2, 64])
def test_against_one_window_a_group(spark, ranges):
    r = random.Random(ranges)
    ids = r.sample(range(-5000, 5000), 3000)
    rows = [("hot" if r.random() < 0.6 else r.choice(["u", "v", None]), r.choice([1, None]), i, f"x{i}", "n") for i in ids] + [("lone", 1, None, "null", "n")]
    df = frame(spark, rows).drop("number").repartition(5)
    w = Window.partitionBy("a", "b")
    want = df.select("x", F.row_number().over(w.orderBy("o")).alias("n"), F.min("o").over(w).alias("f"), F.max("o").over(w).alias("l"))
    got = numbering.numbered(df, ["a", "b"], "o", "n", "f", "l", ranges).select("x", "n", "f", "l")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_task_has_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("a"), (F.col("id") * 7).alias("o"))
    cuts = numbering.borders(df, "o")
    sizes = [r["count"] for r in df.groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda b: b < F.col("o")))).count().collect()]
    assert len(sizes) == numbering.RANGES and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    plan = numbering.numbered(df, ["a"], "o")._jdf.queryExecution().optimizedPlan().toString()
    assert "__range#" in plan.split("row_number() windowspecdefinition(", 1)[1][:20]


@pytest.mark.parametrize("rows", [[], [("a", 1, 5, "x", "n")], [("a", 1, 5, "x", "n"), ("a", 1, 5, "y", "n")]])
def test_few_rows(spark, rows):
    out = numbering.numbered(frame(spark, rows).drop("number"), ["a"], "o")
    assert sorted(r.number for r in out.collect()) == list(range(1, len(rows) + 1)) and out.columns == ["a", "b", "o", "x", "number"]
