"""Warehouse, delimited-text and SQL-file sources, and the CSV sink."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS_SCHEMA = T.StructType(
    [
        T.StructField("userID", T.IntegerType()),
        T.StructField("ISBN", T.StringType()),
        T.StructField("bookRating", T.IntegerType()),
    ]
)


class Tables:
    """Lazy access to ``<root>/<name>.parquet``; every attribute is a DataFrame scan, opened once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        setattr(self, name, frame)
        return frame


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Run a query text on a warehouse.

    With ``partition_column`` the result is fetched as ``partitions`` parallel range queries; without
    it one connection fetches everything. The driver jar and the credentials come from the caller.
    """
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if partition_column:
        lower, upper = bounds
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
        )
    return reader.load()


def run_sql_file(spark: SparkSession, path: str | Path, views: dict[str, DataFrame]) -> DataFrame:
    """Run the query kept in a ``.sql`` file over the given frames, named as in the text."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(Path(path).read_text())


def masked_scan(table: DataFrame, columns: list[str], id_column: str) -> DataFrame:
    """Explicit column list with the identifier as text."""
    return table.select(
        *[F.col(c).cast("string").alias(c) if c == id_column else F.col(c) for c in columns]
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    names: list[str] | None = None,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
) -> DataFrame:
    """Delimited text with a header. Lines with too few fields are filled up with nulls; only lines with
    too many are skipped, whatever the surplus fields hold.

    All fields are read as text and cast afterwards, and column pruning is off, so which lines are
    skipped does not depend on the columns a query selects. An empty field is null, a quoted empty one is
    the empty text, and a field that does not parse is null.
    """
    surplus, missing, quoted = "_surplus", "\x00", "\x01"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    lines = (
        spark.read.schema(text.add(surplus, T.StringType()))
        .options(
            sep=sep,
            encoding=encoding,
            mode="PERMISSIVE",
            quote='"',
            escape="\\",
            header="true",
            columnPruning="false",
            # Markers, so that a surplus field that is empty still differs from one that is not there.
            nullValue=missing,
            emptyValue=quoted,
        )
        .csv(path)
        .filter(F.col(surplus).isNull())
    )
    value = {
        f.name: F.when(F.col(f.name) == quoted, "").otherwise(F.nullif(F.col(f.name), F.lit("")))
        for f in schema
    }
    frame = lines.select(*[value[f.name].try_cast(f.dataType).alias(f.name) for f in schema])
    return frame.toDF(*names) if names else frame


def write_delimited(df: DataFrame, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> str:
    df.write.mode("errorifexists").options(
        sep=sep, encoding=encoding, header="true", quote='"', escape="\\"
    ).csv(path)
    return path


def ratings_dataset(df: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """Triples (user, item, rating). Every row is kept; ``outside_scale`` reports odd ratings."""
    return df.select(
        F.col(user).alias("user"), F.col(item).alias("item"), F.col(rating).alias("rating")
    )


def outside_scale(ratings: DataFrame, scale: tuple[int, int] = (1, 10)) -> DataFrame:
    """The rows whose rating is missing or not on the declared scale."""
    return ratings.filter(~F.coalesce(F.col("rating").between(*scale), F.lit(False)))
