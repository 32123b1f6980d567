"""Sharding by a permutation-filled lookup table."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Slots of the table: a prime, about a hundred for each shard.
SLOTS = 6553
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Shard number of each slot.

    Every shard prefers the slots in an order of its own, ``offset + j * skip`` modulo the
    prime ``slots``; the shards take turns and claim the next free slot of their order.
    Counts of slots differ by one at most, and removing a shard moves few other slots.
    """
    if not shards or len(set(shards)) != len(shards) or not is_prime(slots) or slots < len(shards):
        raise ValueError("shards must be distinct, slots a prime and no smaller than their number")
    seeds = [md5(name.encode()).hexdigest() for name in shards]
    offsets = [int(s[:15], 16) % slots for s in seeds]
    skips = [int(s[15:30], 16) % (slots - 1) + 1 for s in seeds]
    turn = [0] * len(shards)
    table, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            if not free:
                break
            while table[slot := (offsets[k] + turn[k] * skips[k]) % slots] >= 0:
                turn[k] += 1
            table[slot] = k
            free -= 1
    return table


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Slot and shard of every row: doc_id, slot, shard.

    The key is hashed to a slot, and a broadcast table of exactly ``slots`` rows (a
    parameter, not a data size) turns the slot into a shard. No row is shuffled, so hot
    sources or groups of copies do not matter. A NULL key hashes as the text ``null``;
    repeated keys share a shard; an empty table gives an empty result. Only the key is read.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, _k int")
    names = F.array(*[F.lit(s) for s in shards])
    digest = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 1, 15)
    slot = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")
    keyed = docs.select(F.col(key), slot.alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(key, "slot", F.element_at(names, F.col("_k") + 1).alias("shard"))


def sql(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> str:
    owners = ", ".join(str(k) for k in lookup_table(shards, slots))
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
WITH d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot FROM documents),
t AS (SELECT [{owners}] AS owners, [{names}] AS names)
SELECT doc_id, slot, names[owners[slot + 1] + 1] AS shard FROM d, t
"""
