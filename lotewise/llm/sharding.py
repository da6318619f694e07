"""Sharding through fixed virtual slots, with DataFrame functions only.

Records are hashed into ``slots`` virtual slots, a number fixed for the life of a dataset.
Bytes are aggregated per slot; a slot-to-shard map is packed from those sums (largest slot
first into the lightest shard) and kept as a versioned table. Rebalancing (``rebalance_table``) reads the
latest version, moves as few slots as the present sums ask for and writes the next one: a record's
slot never changes, only slots move. ``assign`` places rows through the latest version of a path.

The map has one row for each slot, so what the driver packs and what is broadcast is bounded by
the ``slots`` parameter, not by the data. Within a shard rows are numbered without gaps: each
slot begins at the sum of the counts of the shard's earlier slots, and a window inside one
slot numbers its rows, so no task ever holds a whole shard.

Defined cases: null text has no bytes (size 1) and the CRC of no bytes; the slot is a hash of id and
text's CRC, so rows without an id, or with one that many have, spread by their text; rows with equal
ids and texts are separate rows of one slot; an empty table gives an empty result and an all-zero map;
other columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Virtual slots of a dataset.
SLOTS = 4096
SHARDS = 8


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32) of each row."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def virtual_slot(slots: int = SLOTS) -> Column:
    """The slot of a record of ``sizes``: a hash of its id and its text's CRC."""
    return F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows), at most one row a slot; summed before the shuffle."""
    return records.groupBy(virtual_slot(slots).alias("virtual_slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def pack(weights: dict[int, int], shards: int, slots: int) -> dict[int, int]:
    """A first map: slots by falling weight (ties: lower slot), each into the lightest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int) -> dict[int, int]:
    """The next version of a map: slots move until no two shards differ by more than the heaviest slot.

    Shards beyond ``shards`` are emptied; then slots leave the heaviest shard for the lightest.
    Slots that need not move stay, so a new shard only takes slots.
    """
    bound = max(weights.values(), default=0)
    new, load = dict(old), dict.fromkeys(range(shards), 0)
    homeless = []
    for slot, shard in old.items():
        if shard < shards:
            load[shard] += weights.get(slot, 0)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: (-weights.get(s, 0), s)):
        new[slot] = min(load, key=lambda s: (load[s], s))
        load[new[slot]] += weights.get(slot, 0)
    while True:
        heavy = max(load, key=lambda s: (load[s], -s))
        light = min(load, key=lambda s: (load[s], s))
        gap = load[heavy] - load[light]
        fit = [s for s, shard in new.items() if shard == heavy and 0 < weights.get(s, 0) < gap]
        if gap <= bound or not fit:
            return new
        best = min(fit, key=lambda s: (abs(gap - 2 * weights[s]), s))
        new[best] = light
        load[heavy] -= weights[best]
        load[light] += weights[best]


def store_map(spark, mapping: dict[int, int], weights: dict[int, tuple[int, int]], version: int, path: str) -> DataFrame:
    """Write version ``version`` of the map under ``path``, with the sums that it was made from; a version is never overwritten."""
    rows = [(s, mapping[s], *weights.get(s, (0, 0))) for s in sorted(mapping)]
    values = ",".join(map(str, rows))
    kinds = {"virtual_slot": "int", "shard": "int", "bytes": "long", "rows": "long"}
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(kinds)})").selectExpr(*[f"cast({c} AS {k}) {c}" for c, k in kinds.items()])
    table.coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(spark, path, version)


def load_map(spark, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def latest(spark, path: str) -> int:
    """The last version of the map under ``path``, 0 for none."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # no such folder yet
        return 0


def rebalance_table(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """The next version of the map under ``path``, for the rows there are now and ``shards`` shards: only slots that must move do."""
    spark = docs.sparkSession
    at = latest(spark, path)
    old = {r["virtual_slot"]: r["shard"] for r in load_map(spark, path, at).select("virtual_slot", "shard").collect()}  # a row for each slot
    got = _sums(slot_bytes(sizes(docs), len(old)))
    return store_map(spark, rebalance(old, {s: b for s, (b, _) in got.items()}, shards), got, at + 1, path)


def _sums(table: DataFrame) -> dict[int, tuple[int, int]]:
    return {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in table.collect()}  # at most a row for each slot


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every row with its size, CRC, virtual slot, shard, place in the shard and map version.

    Rows are placed through the latest map under ``path``; where there is none, a first one is packed and stored.
    """
    spark = docs.sparkSession
    records = sizes(docs)
    path = path or shared_dir(spark, "slots")
    at = latest(spark, path)
    if at:
        table = load_map(spark, path, at)
        slots = table.count()
        sums = slot_bytes(records, slots).select("virtual_slot", F.col("rows").alias("n"))
        table = table.join(sums, "virtual_slot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    else:
        got = _sums(slot_bytes(records, slots))
        table = store_map(spark, pack({s: b for s, (b, _) in got.items()}, shards, slots), got, 1, path).withColumn("n", F.col("rows"))
    # where each slot begins in its shard: a sum over a row for each slot
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    table = table.select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.col("version").alias("map_version"))
    placed = records.withColumn("virtual_slot", virtual_slot(slots))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("own", F.row_number().over(order))
    joined = numbered.join(F.broadcast(table), "virtual_slot")  # ``slots`` rows
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("own") - 1).alias("slot"), "virtual_slot", "map_version")
