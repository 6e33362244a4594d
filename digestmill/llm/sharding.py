"""Placing rows on shards by a permutation-filled lookup table.

Every shard orders the slots of a table of prime size by a permutation of its own. Shards take turns: each
claims the first slot of its order that is still free, until all slots are taken. Slots per shard differ by
one at most, and adding or removing a shard moves little more than that shard's share. The table depends on
the shard names alone, has ``slots`` entries whatever the data, and is broadcast: placing a row is one hash
and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 4099
# The broadcast table has a row per slot; this bounds it.
MOST_SLOTS = 1_000_003


def is_prime(number: int) -> bool:
    return number > 1 and all(number % part for part in range(2, int(number**0.5) + 1))


def preferences(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's order; any step below a prime visits every slot."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a list of different names")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    orders = [preferences(shard, slots) for shard in shards]
    at = [first for first, _ in orders]
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for place, shard in enumerate(shards):
            if not free:
                break
            step = orders[place][1]
            while table[at[place]] is not None:
                at[place] = (at[place] + step) % slots
            table[at[place]] = shard
            free -= 1
    return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: 60 bits of its MD5, modulo the table size; a null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, slot, shard`` for every row: equal ids always share a shard.

    A null id is placed like an empty one; repeated rows are placed alike; an empty table gives none; other
    columns are left out.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot long, shard string")
    rows = docs.select(docs[id_col].alias("doc_id"), slot_of(docs[id_col], slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")


def write_shards(docs: DataFrame, path: str, shards: list[str], slots: int = SLOTS, id_col: str = "doc_id", name: str = "shard") -> None:
    """Write ``docs`` as Parquet, a folder per shard, each shard's rows from several tasks where it is large."""
    if name in docs.columns:
        raise ValueError(f"the table has a column {name} already")
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), f"_slot long, {name} string")
    placed = docs.withColumn("_slot", slot_of(docs[id_col], slots)).join(F.broadcast(table), "_slot").drop("_slot")
    placed.hint("rebalance", name).write.partitionBy(name).parquet(path)
