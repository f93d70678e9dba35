"""Exact distinct counts that can be rolled up: bitmaps of dense integer ids.

Ids are cut into buckets of 32768; a bitmap (4096 bytes) holds which ids of a bucket occur in a
group. Bitmaps of fine groups (days) merge into those of coarser ones (months, years) by OR,
which a distinct count cannot do, and several measures need no copies of the rows. The
aggregates sort and hold one bitmap at a time, so memory does not grow with groups or ids; a
hot group is spread over its buckets and reduced before the exchange.

A bitmap pays off where a group holds many ids of a bucket. Sparse or text ids are numbered first
(``dense_numbers``). NULL ids are not counted, as in COUNT(DISTINCT). Negative ids and zero are
allowed. A group without any id has no bitmap, so no row here: join counts to the groups
and read a missing one as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.operators.rank import global_row_number

BUCKET, BITMAP = "id_bucket", "ids"


def id_bitmaps(df: DataFrame, by: dict[str, F.Column], id_col: str) -> DataFrame:
    """One bitmap per group and bucket of ids. ``by``: output names and their expressions."""
    known = df.filter(F.col(id_col).isNotNull())
    return (known.select(*[c.alias(n) for n, c in by.items()], F.bitmap_bucket_number(id_col).alias(BUCKET),
                         F.bitmap_bit_position(id_col).alias("_bit"))
            .groupBy(*by, BUCKET).agg(F.bitmap_construct_agg("_bit").alias(BITMAP)))


def merge(bitmaps: DataFrame, by: dict[str, F.Column]) -> DataFrame:
    """Bitmaps of coarser groups: ``by`` are expressions over the groups of ``bitmaps``."""
    return (bitmaps.select(*[c.alias(n) for n, c in by.items()], BUCKET, BITMAP)
            .groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP)))


def count_ids(bitmaps: DataFrame, by: list[str], out: str) -> DataFrame:
    """Number of ids of each group of ``bitmaps`` (their own groups, no coarser ones: see ``merge``)."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count(BITMAP)).alias(out))


def dense_numbers(df: DataFrame, id_col: str, out: str) -> DataFrame:
    """``id_col`` and ``out``, the numbers 1 to n of its distinct values in ascending order, given out in
    range partitions."""
    ids = df.filter(F.col(id_col).isNotNull()).select(id_col).distinct()
    return global_row_number(ids, [F.col(id_col).asc()], out=out)
