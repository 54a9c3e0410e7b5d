"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own (an offset and a step derived from its
name); shards take turns claiming their next free slot until the table is full. A key's slot is a hash modulo the
size, so placement is one look-up, shards get equal shares to within one slot, and adding or removing a shard moves
few keys. The table's size is a parameter and does not depend on the data, so it is broadcast.

Null keys take slot 0. Repeated keys go to one shard; all rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65537  # prime


def number(text: str) -> int:
    """The first 60 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def number_column(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than the slots")
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime of at least 3")
    offsets = [number(f"{s}/offset") % slots for s in shards]
    steps = [number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i, step in enumerate(steps):
            while table[offsets[i]] >= 0:
                offsets[i] = (offsets[i] + step) % slots
            table[offsets[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """key, slot long, shard string for every row; other columns are left out. A key column that is itself called slot
    or shard keeps its name and the new column gets an underscore behind its own."""
    table = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, slots))], "_slot long, _shard string")
    keyed = df.select(F.col(key).alias("_key")).withColumn("_slot", F.coalesce(number_column(F.col("_key")) % slots, F.lit(0).cast("long")))
    names = [n + "_" * (n == key) for n in ("slot", "shard")]
    return keyed.join(F.broadcast(table), "_slot").select(F.col("_key").alias(key), F.col("_slot").alias(names[0]), F.col("_shard").alias(names[1]))
