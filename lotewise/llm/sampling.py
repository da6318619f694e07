"""Samples of a bounded number of rows, chosen by what the rows hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PARTS = 1_000_003
#: Times the wanted number that goes on to be ranked, on average, so that hardly ever too few do.
SPARE = 1.25


def bounded(rows: DataFrame, content: list[str], by: str, most: dict, counts: dict) -> DataFrame:
    """At most ``most[x]`` of the ``counts[x]`` rows of each value x of ``by``, those with the least hash of ``content``.

    Rows without an id, or with one that many have, are told apart by the rest of their content; only equal rows
    share a hash, and those are cut like others. Tasks drop what is above a share of all hashes, then all but
    their first ``most[x]``, before rows meet; where ``content`` is one side's of a join, the share is taken below the join. Values that ``most`` lacks have no rows.
    """
    if not most:
        return rows.limit(0)
    below = F.create_map(*[F.lit(v) for x, n in most.items() for v in (x, int(_PARTS * min(1.0, SPARE * n / max(counts[x], 1))) + 1)])
    limit = F.create_map(*[F.lit(v) for x, n in most.items() for v in (x, n)])
    hashed = rows.withColumn("_h", F.xxhash64(*content)).where(F.pmod("_h", F.lit(_PARTS)) < F.try_element_at(below, F.col(by)))
    first = Window.partitionBy(by).orderBy(F.pmod("_h", F.lit(_PARTS)), "_h", *[c for c in rows.columns if c not in content])
    ranked = hashed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(most.values()))
    return ranked.where(F.col("_n") <= F.try_element_at(limit, F.col(by))).drop("_h", "_n")
