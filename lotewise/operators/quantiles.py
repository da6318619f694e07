"""Exact quantiles of groups by selection: ranges that hold the wanted ranks are narrowed until one value is left.

A pass counts a group's values in ``PARTS`` equal ranges between the least and the greatest that can still be the
wanted one, summed before the shuffle; the range that holds the rank is the next pass's, its bounds being the least
and greatest values found in it. So no value list of a group is ever gathered: a pass keeps ``PARTS`` counters for each
open rank. One or two passes end it for prices.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a pass.
PARTS = 1 << 16


def exact_quantiles(rows: DataFrame, by: list[str], value: str, at: list[float], store: Callable[[DataFrame], DataFrame], parts: int = PARTS) -> DataFrame:
    """(by, n, p, q): for each group its number of values, and for each share the value there, between two ranks the point on the line between theirs.

    Null and NaN values are no values; groups without any have no rows; ``by`` columns are not null. ``store`` writes a
    DataFrame where it survives lost executors.
    """
    base = store(rows.select(*by, F.col(value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)"))
    facts = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    place = F.col("p") * (F.col("n") - 1)
    wanted = facts.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in at]))).withColumn("below", F.floor(place)).withColumn("part", place - F.floor(place))
    ranks = wanted.select(*by, "lo", "hi", F.explode(F.array("below", F.least(F.col("below") + 1, F.col("n") - 1))).alias("rank")).distinct()
    ranks = store(ranks.withColumn("rest", F.col("rank")))
    ends = ["lo", "hi"]
    while not (left := ranks.where("lo < hi")).isEmpty():
        spans = left.select(*by, *ends).distinct()
        inside = base.join(spans, by).where("x BETWEEN lo AND hi")
        # halves, as the difference of two doubles may be beyond the greatest
        cell = F.least(F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * parts), F.lit(parts - 1))
        cells = inside.groupBy(*by, *ends, cell.alias("cell")).agg(F.count(F.lit(1)).alias("held"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = Window.partitionBy(*by, *ends).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        found = left.join(cells, [*by, *ends]).where("rest >= before AND rest < before + held")
        narrowed = found.select(*by, F.col("least").alias("lo"), F.col("most").alias("hi"), "rank", (F.col("rest") - F.col("before")).alias("rest"))
        ranks = store(ranks.where("lo >= hi").select(*by, *ends, "rank", "rest").unionByName(narrowed))
    values = ranks.select(*by, "rank", F.col("lo").alias("v"))
    low = wanted.join(values.withColumnRenamed("rank", "below").withColumnRenamed("v", "a"), [*by, "below"])
    both = low.join(values.withColumnRenamed("v", "b"), by).where(F.col("rank") == F.least(F.col("below") + 1, F.col("n") - 1))
    return both.select(*by, "n", "p", ((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("q"))


def quantile(values: list[float], p: float) -> float:
    """The same of a list."""
    v = sorted(values)
    at = p * (len(v) - 1)
    i = math.floor(at)
    return (1 - (at - i)) * v[i] + (at - i) * v[min(i + 1, len(v) - 1)]
