"""Load and publish the canonical tables as CSV (header) or Parquet.

CSV is always read with the declared schema (no inference pass over the
data, dates parsed on read); Parquet keeps its own schema. Writes produce a
folder of part files per table — one task per partition, nothing funnelled
through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tillpoint.sources.schemas import SCHEMAS, fill_defaults

ALIASES = {"clean_transactions": "fact_transactions"}


def schema_of(name: str):
    return SCHEMAS[ALIASES.get(name, name)]


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        path = os.path.join(out_dir, name)
        if fmt == "csv":
            w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
        else:
            w.parquet(path)


def load_tables(spark: SparkSession, in_dir: str, names, fmt: str = "csv") -> dict[str, DataFrame]:
    out = {}
    for name in names:
        path = os.path.join(in_dir, name)
        if fmt == "csv":
            out[name] = (spark.read.schema(schema_of(name)).option("header", True)
                         .option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path))
        else:
            out[name] = spark.read.parquet(path)
        out[name] = fill_defaults(out[name], ALIASES.get(name, name))
    return out
