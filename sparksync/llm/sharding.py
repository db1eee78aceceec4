"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table, given by an offset and a skip. The shards take turns and claim the first
slot of their order that is still free, until the table is full. Shares differ
by at most one slot, and taking a shard away moves few rows besides its own.
The table has ``SIZE`` slots whatever the data size, so it is broadcast; a row's
shard is one lookup by its key's hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from sparksync.llm.decontaminate import free_name

SIZE = 65_537


def fill_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """The shard number of each slot; ``size`` must be a prime above the number of shards."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if size <= len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table needs a prime number of slots, more than shards")
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    table = np.full(size, -1, np.int32)
    free = size
    while free:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int = SIZE) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of its text, modulo the size. A null key counts as empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``df`` with the columns slot and shard; equal keys go to the same shard.

    Rows with a null key share one slot. A column of ``df`` that is called slot
    or shard is replaced; an empty table gives no rows.
    """
    table = fill_table(shards, size)
    rows = [(slot, shards[s]) for slot, s in enumerate(table.tolist())]
    lookup = df.sparkSession.createDataFrame(rows, "slot int, shard string")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard") or c == key]
    slot, shard = free_name(df, "slot_of_row"), free_name(df, "shard_of_row")
    placed = df.select(*(F.col(f"`{c}`") for c in kept), slot_of(F.col(f"`{key}`"), size).alias(slot))
    joined = placed.join(F.broadcast(lookup.withColumnRenamed("slot", slot).withColumnRenamed("shard", shard)), slot)
    out = [F.col(f"`{c}`") for c in kept if c.lower() not in ("slot", "shard")]
    return joined.select(*out, F.col(slot).alias("slot"), F.col(shard).alias("shard"))
