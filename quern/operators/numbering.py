"""Numbers within groups of any size: a group is dealt into ranges of its order, and the sizes of earlier ranges are added up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the rows are dealt into, at most, and the rank error of their borders, of all rows.
RANGES, ACCURACY = 64, 10_000


def borders(df: DataFrame, order: str, ranges: int = RANGES) -> list:
    """Values of `order` that cut all rows into ranges of about one size: one sketch, of which at most `ranges` - 1 numbers return."""
    shares = [k / ranges for k in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("b")).first().b if shares else None
    return sorted({b for b in found or [] if b is not None})


def numbered(df: DataFrame, by: list[str], order: str, name: str = "number", first: str | None = None, last: str | None = None, ranges: int = RANGES) -> DataFrame:
    """df with `name`, the place of a row in its group by a numeric column, from 1, and, if told, the group's smallest and largest value of it.

    No task has more of a group than one range of the order, so a group may hold
    most rows; what the ranges add up to is a table of at most `ranges` rows a
    group. Nulls of `by` make a group, and a null order comes first. Rows of
    equal order stand in one range, in no order among themselves; a group all of one
    value is one task's. Other columns stay; an empty table stays empty.
    """
    cuts = F.array(*map(F.lit, borders(df, order, ranges)))
    place = F.size(F.filter(cuts, lambda b: b < F.col(order)))
    rows = df.withColumn("__range", F.when(F.col(order).isNull(), -1).otherwise(place))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"), F.min(order).alias("__min"), F.max(order).alias("__max"))
    sizes = sizes.select(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)], F.col("__range").alias("__in"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.min("__min").over(group).alias("__min"), F.max("__max").over(group).alias("__max"))
    here = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order)))
    same = F.col("__range") == F.col("__in")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    more = [F.col(x).alias(y) for x, y in (("__min", first), ("__max", last)) if y]
    return here.join(sizes, same).select(*df.columns, (F.col("__place") + F.col("__before")).cast("int").alias(name), *more)
