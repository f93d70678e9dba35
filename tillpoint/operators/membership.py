"""Membership filter of a set of keys: a Bloom filter in native expressions.

The keys' bit positions are OR-ed into 64-bit words by one small aggregate, and the words
(one row, ``bits`` / 64 longs, a stated bound) reach the other table's scan as an uncorrelated
scalar subquery: no join, no exchange of that table. A row that passes may still lack
a partner (a false positive costs time, never a result); a row that fails has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
MIN_BITS, MAX_BITS = 1 << 16, 1 << 26  # 8 KB to 8 MB of words
BITS_PER_KEY = 10


def filter_bits(keys: int) -> int:
    """Bits for a number of keys: a power of two between the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(0, keys * BITS_PER_KEY - 1).bit_length()))


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def key_words(keys: DataFrame, bits: int) -> DataFrame:
    """One row, one column ``words``: the filter of the first column of ``keys``."""
    spark = keys.sparkSession
    bit = keys.select(F.explode(F.array(*_positions(keys[keys.columns[0]], bits))).alias("p"))
    words = bit.select(F.expr("cast(p div 64 AS int)").alias("w"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("b"))
    none = spark.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    whole = words.unionByName(none).groupBy("w").agg(F.bit_or("b").alias("b"))
    return whole.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))


def may_hold(words: DataFrame, key: Column, bits: int) -> Column:
    """Whether the filter may hold a key (never false for one that it holds)."""
    held = words.scalar()
    hits = [F.call_function("shiftrightunsigned", F.get(held, F.call_function("div", p, F.lit(64)).cast("int")),
                            F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in _positions(key, bits)]
    passed = hits[0]
    for hit in hits[1:]:
        passed = passed & hit
    return passed


def only_wanted(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``key`` may be in the first column of ``wanted``, a smaller table
    (counted once, to size the filter)."""
    column = wanted.columns[0]
    known = wanted.filter(F.col(column).isNotNull())
    bits = filter_bits(known.agg(F.approx_count_distinct(column)).first()[0])
    return table.filter(may_hold(key_words(known, bits), F.col(key), bits))
