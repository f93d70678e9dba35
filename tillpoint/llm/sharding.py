"""Weighted rendezvous sharding.

Every shard scores every key, ``-weight / ln(u)`` with ``u`` a uniform draw from a
hash of (key, shard), and the key goes to the best score. Each shard's share is
proportional to its weight; a new shard only wins rows for itself, a removed one
only gives its own rows away. Built from native expressions, no shuffle.

Edge cases: a null key is hashed as the text ``null`` (all null keys share one
shard); null text has size 1 and crc32 0; an empty table gives an empty result;
repeated rows get the same shard and different slots; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import id_text, rank_in_class, staged, text_bytes


def shard_score(key: Column, shard: int, weight: float, seed: str = "shard") -> Column:
    """Score of one shard for a key; the highest score owns the key."""
    name = F.coalesce(key.cast("string"), F.lit("null"))
    draw = F.shiftrightunsigned(F.xxhash64(name, F.lit(f"{seed}:{shard}")), 11)
    u = (draw.cast("double") + 0.5) / float(1 << 53)
    return -F.lit(float(weight)) / F.log(u)


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(score, shard) of the owning shard among ``first .. first+len(weights)-1``.
    Weights must be positive; equal scores go to the higher shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    scored = [F.struct(shard_score(key, first + i, w).alias("score"), F.lit(first + i).alias("shard"))
              for i, w in enumerate(weights)]
    return F.greatest(*scored) if len(scored) > 1 else scored[0]


def assign_shards(df: DataFrame, weights: Sequence[float], new_weight: float = 1.0,
                  id_col: str = "doc_id", text_col: str = "text", lanes: int = 256) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot
    (gapless from 0 inside the shard), grown_shard (owner once a shard of weight
    ``new_weight`` joins). The text is read once and never shuffled."""
    docs = id_text(df, id_col, text_col)
    best = rendezvous(F.col("doc_id"), weights)
    extra = shard_score(F.col("doc_id"), len(weights), new_weight)
    rows = (docs.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"),
                        F.crc32(text_bytes()).alias("text_crc32"), best.alias("_best"),
                        extra.alias("_extra"))
            .select("doc_id", "size", "text_crc32", F.col("_best.shard").alias("shard"),
                    F.when(F.col("_extra") >= F.col("_best.score"), F.lit(len(weights)))
                     .otherwise(F.col("_best.shard")).cast("int").alias("grown_shard")))
    return rank_in_class(staged(rows, "shards"), ["shard"], ["doc_id", "text_crc32", "size"], "slot", lanes)


def write_shards(df: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id") -> None:
    """Write all columns of ``df`` as one folder ``_shard=k`` per shard. A shard is
    written by many tasks: rows are not gathered per shard."""
    owner = rendezvous(F.col(id_col), weights)["shard"]
    df.withColumn("_shard", owner).write.mode("overwrite").partitionBy("_shard").parquet(path)
