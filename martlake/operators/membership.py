"""Marking the rows whose key is in a set of keys, exactly, without shuffling the rows that can't be.

A set of at most ``BROADCAST_KEYS`` keys (counted) is broadcast. Of a larger one a blocked Bloom filter is: a key's hash
selects a block of 32,768 bits and ``BITS`` bits of it. Tasks set bits in blocks of their own, blocks are united by a
second aggregation, and there are at most ``MOST_BLOCKS`` of 4 KB, so a set beyond what they're made for only lets more
rows pass. Rows that the filter lets pass are joined to the set, which decides; all others go by without an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlake.functions.staging import fixed

#: Keys that may be broadcast as they are.
BROADCAST_KEYS = 1 << 17
#: Bits set for a key, bits of the filter for a key, and blocks (4 KB each) at most: 16 MB.
BITS, BITS_A_KEY, MOST_BLOCKS = 4, 12, 4096
_BLOCK = 1 << 15


def blocks_for(keys: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-keys * BITS_A_KEY // _BLOCK)))


def _block(key: Sequence[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *key), F.lit(blocks)).cast("int")


def _places(key: Sequence[Column]) -> list[Column]:
    """The bits of a key within its block: four times 15 bits of a second hash."""
    h = F.xxhash64(F.lit(1), *key)
    return [F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(_BLOCK - 1)) for k in range(BITS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """block, bits: a blocked Bloom filter of all columns of ``keys``."""
    own = [F.col(f"`{c}`") for c in keys.columns]
    placed = keys.select(_block(own, blocks).alias("block"), F.explode(F.array(*_places(own))).alias("place"))
    return placed.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def might_hold(bits: Column, key: Sequence[Column]) -> Column:
    """Whether a block (null: empty) has all bits of a key."""
    held = F.lit(True)
    for place in _places(key):
        byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = held & (F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(held, F.lit(False))


def passing(df: DataFrame, key: Sequence[str], bloom: DataFrame, blocks: int, name: str) -> DataFrame:
    """``df`` with the column ``name``: whether the filter lets the row pass."""
    own = [F.col(f"`{c}`") for c in key]
    joined = df.withColumn("__block", _block(own, blocks)).join(F.broadcast(bloom.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block", "left")
    return joined.withColumn(name, might_hold(F.col("__bits"), own)).drop("__block", "__bits")


def mark_members(df: DataFrame, key: Sequence[str], members: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name``: whether the row's key is a row of ``members``; null is a value like any other.

    ``members`` has the key's columns in the same order, and each key once. It's written first, as its size is measured.
    """
    own, kept = df.columns, fixed(members.toDF(*(f"__m{i}" for i in range(len(key)))))
    n = kept.count()
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"__m{i}"))
    marked = kept.withColumn("__found", F.lit(True))
    columns = [F.col(f"`{c}`") for c in own]
    if n <= BROADCAST_KEYS:
        return df.join(F.broadcast(marked), same, "left").select(*columns, F.col("__found").isNotNull().alias(name))
    blocks = blocks_for(n)
    passed = passing(df, key, bloom_filter(kept, blocks), blocks, "__passed")
    found = passed.where("__passed").join(marked, same, "left").select(*columns, F.col("__found").isNotNull().alias(name))
    return found.unionByName(passed.where("NOT __passed").select(*columns, F.lit(False).alias(name)))
