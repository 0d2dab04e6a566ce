"""Blocked Bloom filters as tables (native): built by an aggregation, probed by a lookup of a row's block.

A filter has one block of 32,768 bits for each 2,048 keys; a key sets two bits of its block, so about one key of 60 that isn't in the filter passes. A
filter is broadcast up to BROADCAST_BYTES; a larger one meets the probing rows in a join by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, unused

BLOCK_BITS = 1 << 15
KEYS_PER_BLOCK = 1 << 11
BROADCAST_BYTES = 32 << 20


class BlockFilter:
    """A filter of the 64-bit hashes in ``hashes`` (one column)."""

    def __init__(self, hashes: DataFrame, keys: int):
        """keys: the number of rows of ``hashes``, or more."""
        self.blocks = keys // KEYS_PER_BLOCK + 1
        h = F.col(f"`{hashes.columns[0]}`")
        bits = hashes.select(self._block(h).alias("block"), F.explode(F.array(*self._bits(h))).alias("bit"))
        self.table = materialise(bits.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")

    def _block(self, h: Column) -> Column:
        return F.pmod(h, F.lit(self.blocks))

    @staticmethod
    def _bits(h: Column) -> list[Column]:
        mixed = F.xxhash64(h)
        return [F.shiftrightunsigned(mixed, k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in (3, 33)]

    def probe(self, rows: DataFrame, h: Column, flag: str) -> DataFrame:
        """``rows`` with the boolean ``flag``: false where h isn't among the keys, true where it is or may be."""
        block, bits = unused(rows, "_block"), unused(rows, "_bits")
        side = self.table.select(F.col("block").alias(block), F.col("bits").alias(bits))
        if self.blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
            side = F.broadcast(side)
        byte = lambda bit: F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(bit, 3) + 1).cast("int"), 1)), 16, 10).cast("int")
        held = [F.getbit(byte(bit), bit.bitwiseAND(F.lit(7)).cast("int")) == 1 for bit in self._bits(h)]
        out = rows.withColumn(block, self._block(h)).join(side, block, "left")
        return out.withColumn(flag, F.coalesce(held[0] & held[1], F.lit(False))).drop(block, bits)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (see common.stable) without the rows whose monotonically_increasing_id is in ``gone`` (one column, no repeats). Rows that a filter of ``gone`` lets
    through never cross the network."""
    row, flag = unused(docs, "_row"), unused(docs, "_gone")
    gone = materialise(gone.toDF(row), "gone")
    kept = BlockFilter(gone.select(F.xxhash64(row)), gone.count())
    probed = kept.probe(docs.withColumn(row, F.monotonically_increasing_id()), F.xxhash64(row), flag)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return probed.where(~F.col(flag)).select(*columns).unionByName(probed.where(flag).join(gone, row, "left_anti").select(*columns))
