"""Helpers shared by the text operators: settings, Arrow maps that keep other columns, table access."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import cut_lineage

# Texts may be long, so a batch handed to Python holds few rows, and few bytes if its rows are large.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20

SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the session options the registered queries rely on: small Arrow batches, skew splitting."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


_ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_array(values, field: T.StructField) -> pa.Array:
    return pa.array(values, type=_ARROW[field.dataType.simpleString()])


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
    added: T.StructType,
    keep: list[str],
) -> DataFrame:
    """Add columns computed batch by batch; ``keep`` names the input columns that stay.

    ``make`` is called once per task and returns a function from a batch to the added columns. Rows
    stay in their partition: there is no shuffle, and a lost task is simply run again.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = compute(batch)
            columns = [batch.column(c) for c in keep]
            columns += [arrow_array(new[f.name], f) for f in added]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def bounded_parts(rows: DataFrame, unit: list[str], weight: str, limit: int) -> Iterator[list]:
    """The rows on the driver, part by part, units whole; no part weighs more than ``limit``.

    Only a unit that is heavier by itself is a part of its own. Weights are summed by Spark before any row
    is fetched, and parts are halved until they are light enough. There is one empty part at least.
    """
    units = cut_lineage(rows)
    total = units.agg(F.sum(weight)).first()[0] or 0
    parts = max(1, -(-total // limit))
    single = units.groupBy(*unit).agg(F.sum(weight).alias("w"))
    while True:
        part = F.pmod(F.xxhash64(*unit), F.lit(parts))
        heavy = single.groupBy(part.alias("p")).agg(F.sum("w").alias("w"), F.count("*").alias("n"))
        if heavy.filter((F.col("w") > limit) & (F.col("n") > 1)).isEmpty():
            break
        parts *= 2
    for k in range(parts):
        yield units.filter(part == k).collect()
