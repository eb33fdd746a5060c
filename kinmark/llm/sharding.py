"""Sharding by a permutation-filled lookup table: shards take turns claiming slots of a prime-sized table.

Each shard has a preference order of all slots (an offset and a step, both from its name), and takes the first slot
of it that is still free when its turn comes; a shard of weight w gets w turns a round. The table has `size` slots
whatever the data, so it is broadcast safely; a row's shard is one look-up at its key's hash. When a shard is
added or removed, few slots besides its own change hands.

Null keys hash like any other value, rows that repeat a key go to one shard, an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SIZE = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str] | dict[str, int], size: int = SIZE) -> np.ndarray:
    """The index of the owning shard for each of `size` slots."""
    weights = shards if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or not is_prime(size) or size < sum(weights.values()) or min(weights.values()) < 1:
        raise ValueError("need shards of weight 1 or more and a prime size of at least their sum")
    digests = [int.from_bytes(hashlib.md5(name.encode()).digest(), "big") for name in weights]
    orders = [((d >> 64) % size, (d & (1 << 64) - 1) % (size - 1) + 1) for d in digests]
    table, turn, left = [-1] * size, [0] * len(orders), size
    while left:
        for i, ((offset, step), weight) in enumerate(zip(orders, weights.values(), strict=True)):
            for _ in range(min(weight, left)):
                while table[slot := (offset + turn[i] * step) % size] >= 0:
                    turn[i] += 1
                table[slot] = i
                left -= 1
    return np.array(table, np.int32)


def slot(key: Column, size: int = SIZE) -> Column:
    """A key's slot: 60 bits of the MD5 of its text, modulo the size. Null has the slot of the empty text."""
    hexed = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(hexed, 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] | dict[str, int] | int = SHARDS, size: int = SIZE, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """df with the slot and the shard of each row's key; no shuffle. Columns that already have these names are replaced."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else shards
    own, at, place = (C.unused(df, x) for x in ("key", "at", "place"))
    table = df.sparkSession.createDataFrame(pa.table({at: np.arange(size, dtype=np.int32), place: lookup_table(names, size)}))
    keyed = df.withColumn(own, slot(df[f"`{key}`"], size)).drop(slot_col, shard_col)
    placed = keyed.join(F.broadcast(table), keyed[own] == table[at])  # the table has `size` rows, whatever df has
    return placed.withColumns({slot_col: F.col(own), shard_col: F.col(place)}).drop(own, at, place)
