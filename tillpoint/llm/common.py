"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.tokens import few_rows
from tillpoint.session import staging_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{staging_root(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so
    a lost executor re-reads files. Returns a scan of the written table."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text becomes the
    empty text. Other columns of the input are not read, so they cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def text_bytes(text: Column | str = "text") -> Column:
    return F.encode(text, "UTF-8")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def rank_in_class(df: DataFrame, classes: list[str], key: list[str], out: str,
                  lanes: int = 256) -> DataFrame:
    """Add ``out``: a gapless 0-based number of each row inside its class.

    A class may hold any share of the rows, so it is split over ``lanes`` by a
    hash of ``key``: rows are numbered inside (lane, class) and shifted by the
    sizes of the lanes before. The lane sizes (at most lanes x classes rows) are
    joined on the partitioning that the numbering already has. ``df`` is read
    twice: pass a staged table. Rows with equal keys are interchangeable."""
    laned = df.withColumn("_lane", F.pmod(F.xxhash64(*key), F.lit(lanes)).cast("int"))
    sizes = laned.groupBy("_lane", *classes).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*classes).orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_lane", *classes, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy("_lane", *classes).orderBy(*key)
    numbered = laned.withColumn("_rn", F.row_number().over(local))
    return (numbered.join(offsets, ["_lane", *classes])
            .withColumn(out, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_lane", "_rn", "_off"))


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Rows of ``df`` whose text is kept, with all columns, without a shuffle. ``keep()`` is
    called once a task and gives a function from texts (null: empty) to a mask."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask_of = keep()
        for batch in few_rows(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask_of(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def drop_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``keep`` (a null id matches a null id)."""
    ids = keep.select(F.col("doc_id").alias("_keep_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_keep_id"]), "left_semi")
