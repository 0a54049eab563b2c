"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, made from
two hashes of its name. The shards take turns; at its turn a shard claims the
first slot of its permutation that is still free. A row's key is hashed to a
slot, and the broadcast table gives the shard in constant time. When a shard
goes, most keys of the others stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The table is broadcast; with 4 bytes a slot this bounds it to 4 MB.
MAX_SLOTS = 1 << 20
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))
SLOTS = 65_537


def _is_prime(m: int) -> bool:
    return m > 1 and all(m % k for k in range(2, int(m**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot; its length is bounded by ``MAX_SLOTS``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    seed = [hashlib.md5(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in seed]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in seed]
    taken, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while taken[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            taken[at[i]] = i
            left -= 1
            if not left:
                break
    return taken


def lookup_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``(slot, shard)``: the table as rows that the JVM cuts out of one binary literal."""
    packed = b"".join(n.to_bytes(4, "big") for n in lookup_table(shards, slots))
    number = F.conv(F.hex(F.substring(F.lit(packed), F.col("id") * 4 + 1, F.lit(4))), 16, 10).cast("int")
    return spark.range(slots).select(F.col("id").alias("slot"), number.alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot from the first 60 bits of the key's MD5; a null key counts as the empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (int): no shuffle, one broadcast join.

    Null keys go where the empty key goes; repeated rows go to one shard; an
    empty table gives an empty result. Columns of ``df`` that are called
    ``slot`` or ``shard`` are replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(*kept, slot_of(F.col(key), slots).alias("slot"))
    return rows.join(F.broadcast(lookup_frame(df.sparkSession, shards, slots)), "slot", "left").select(*kept, "slot", "shard")
