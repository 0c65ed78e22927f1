"""Sharding by a permutation-filled lookup table.

Shards take turns in a fixed order; at each turn a shard claims the next free slot of its own preference list, a
permutation of the slots of a prime-sized table, so every shard ends with within one of the same number of slots and
adding or removing a shard moves few others. A row is placed by one hash and one look into the broadcast table.

Defined cases: a null key is placed like the empty string; keys of any type and length are placed by their text; repeated keys
and rows go to the same shard, each as a row; empty tables give no rows; columns of the input named slot or shard, in whatever
case, are replaced by the result's, but for the key, beside which the result's gets another name (slot_1 or shard_1).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Slots of the table. A prime, and far more than the shards; it bounds what is broadcast (65,537 pairs of integers).
SLOTS = 65_537
#: Names of the shards that the query uses.
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """slot -> index of its shard. The work is bounded by the table, whatever the data."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    start = [_number(f"{s}/offset") % slots for s in shards]
    step = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            at = start[i]
            while owner[at] >= 0:
                at = (at + step[i]) % slots
            owner[at], start[i] = i, (at + step[i]) % slots
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: 60 bits of the md5 of its text, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def lookup_table(spark, shards: tuple[str, ...], slots: int = SLOTS) -> DataFrame:
    """(slot, shard), made from literals inside Spark."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "owner")).select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard. The table has at most MAX_SLOTS rows, so it is broadcast; df itself is not shuffled."""
    kept = df.select(*[df[c] for c in df.columns if c.lower() not in ("slot", "shard") or c.lower() == key.lower()])
    slot, shard = common.free_name(kept, "slot"), common.free_name(kept, "shard")
    table = lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return kept.withColumn(slot, slot_of(kept[key], slots)).join(F.broadcast(table), slot).select(*[F.col(f"`{c}`") for c in kept.columns], slot, shard)
