"""A filter of fixed size for "is this key in that table?".

The bits are set by an aggregate in Spark and are ``1 << BITS`` at most, however long the
table is, so the filter can be sent to every task. It never misses a key that is there; keys
it passes wrongly have to be dropped by a join that follows. A table too long for it makes it
pass more, which costs time in that join and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 26


def _places(key: Column, bits: int) -> list[Column]:
    """Two bit numbers of a 64-bit key: its lowest and its highest digits."""
    return [key.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(key, 64 - bits)]


def build(keys: DataFrame, column: str, bits: int = BITS) -> Broadcast:
    """Filter over ``column`` (well mixed longs)."""
    spots = keys.select(F.explode(F.array(*_places(F.col(column), bits))).alias("spot"))
    one = F.expr("shiftleft(1L, cast(spot & 31 as int))")
    words = spots.groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(one).alias("mask"))
    found = words.select(F.col("word").cast("int"), F.col("mask").cast("long")).toArrow()
    table = np.zeros(1 << (bits - 5), np.uint32)
    table[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.uint32)
    return keys.sparkSession.sparkContext.broadcast(table)


def contains(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys may be in the table."""
    bits = int(len(table)).bit_length() + 4
    out = np.ones(len(keys), bool)
    for spot in (keys & np.uint64((1 << bits) - 1), keys >> np.uint64(64 - bits)):
        out &= (table[spot >> np.uint64(5)] >> (spot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return out


def passes(filter_: Broadcast, key: Column) -> Column:
    """Whether the filter passes a long key, for use in ``where``."""
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(contains(filter_.value, keys.to_numpy().view(np.uint64)))
    return F.arrow_udf(run, "boolean")(key)
