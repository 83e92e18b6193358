"""Placement of rows on shards by a permutation-filled lookup table.

Each shard has a preference order of all slots of a prime-sized table (a start and a
step drawn from its name), and shards take turns claiming the next slot they prefer
that is free. Shards then hold nearly equal numbers of slots, and when a shard
comes or goes few other slots change hands. A row's slot is its key's hash modulo the
size; the table has a fixed number of rows, so a broadcast join places rows in constant time.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots; a prime far above the number of shards. Bounds the broadcast table (1 MB).
TABLE_SLOTS = 65_537


def lookup_table(shards: list[str], slots: int = TABLE_SLOTS) -> np.ndarray:
    """Number (place in shards) of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and one at least")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    start, step = np.zeros(len(shards), np.int64), np.zeros(len(shards), np.int64)
    for k, name in enumerate(shards):
        digest = hashlib.sha256(name.encode()).digest()
        start[k] = int.from_bytes(digest[:8], "big") % slots
        step[k] = int.from_bytes(digest[8:16], "big") % (slots - 1) + 1
    owner = [-1] * slots
    at = start.tolist()
    steps = step.tolist()
    left = slots
    while True:
        for k in range(len(shards)):
            slot = at[k]
            while owner[slot] >= 0:
                slot = (slot + steps[k]) % slots
            owner[slot] = k
            at[k] = (slot + steps[k]) % slots
            left -= 1
            if not left:
                return np.array(owner, np.int32)


def table_frame(spark: SparkSession, shards: list[str], slots: int = TABLE_SLOTS) -> DataFrame:
    owner = lookup_table(shards, slots).tolist()
    return spark.createDataFrame(list(enumerate(owner)), "slot int, shard int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = TABLE_SLOTS) -> DataFrame:
    """df with slot and shard (number in shards) of each row, by key.

    Old columns of these names are replaced. Equal keys get the same shard; null
    keys share a slot. An empty table stays empty.
    """
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    kept = df.select(*(c for c in df.columns if c not in ("slot", "shard") or c == key))
    return kept.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")).join(table, "slot").select(*kept.columns, "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, *, file_rows: int = 1_000_000) -> None:
    """Write df as Parquet with a folder per shard.

    Rows of a shard are dealt to as many files as their number needs, so that a hot
    shard is not one task.
    """
    placed = place(df, key, shards)
    # One row per shard: bounded by the number of shards.
    parts = placed.groupBy("shard").agg(F.ceil(F.count("*") / file_rows).alias("_parts"))
    dealt = placed.join(F.broadcast(parts), "shard").withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
    dealt.repartition("shard", "_part").drop("_parts", "_part").write.partitionBy("shard").parquet(path)
