"""A filter of fixed size over the keys of a batch, for scans of a much larger table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key is given, and the least and greatest size of a filter; the greatest is 64 MB.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 29
#: Bytes and bits of a word, and words of a block.
_BYTES, _BITS, _WORDS = 8, 64, 512


def filter_bits(keys: int) -> int:
    """Size of the filter for a number of keys: a power of two, never above the greatest."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (keys * BITS_PER_KEY).bit_length()))


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(block, held): the keys' places in a set of ``bits`` bits, 32,768 of them a row as 512 words."""
    places = keys.select(_place(F.col(key), bits).alias("place"))
    blocks = places.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("held")
    )

    def word(i: Column) -> Column:
        return F.conv(F.hex(F.substring("held", i * _BYTES + 1, F.lit(_BYTES))), 16, -10).cast("long")

    # A row that is tested then reads a number, and makes no text of a byte.
    return blocks.select("block", F.transform(F.sequence(F.lit(0), F.lit(_WORDS - 1)), word).alias("held"))


def may_hold(stored: DataFrame, key: str, held: DataFrame, bits: int) -> DataFrame:
    """Rows of ``stored`` whose key is in the filter: all that match, and a few others.

    The filter is broadcast, its size being bounded, so ``stored`` is neither
    shuffled nor sorted to be cut down.
    """
    place = _place(F.col(key), bits)
    near = stored.withColumn("_place", place).withColumn("_block", F.bitmap_bucket_number("_place"))
    found = near.join(F.broadcast(held.withColumnRenamed("block", "_block")), "_block")
    at = F.bitmap_bit_position("_place").cast("int")
    word = F.get("held", F.shiftright(at, 6))
    # A word's first byte is its highest, a byte's first bit its lowest.
    last = _BITS - _BYTES
    bit = F.lit(last) - at.bitwiseAND(F.lit(last)) + at.bitwiseAND(F.lit(_BYTES - 1))
    return found.where(F.getbit(word, bit) == 1).select(*stored.columns)
