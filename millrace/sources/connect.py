"""Tables by format: columnar files, databases and queues, read through Spark's own sources so that filters and columns reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

FILES = ("parquet", "orc", "json", "csv", "text", "avro")


def read_table(spark: SparkSession, kind: str, at: str, columns: list[str] | None = None, where: str | Column | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, JSON, CSV, text or (if its package is there) Avro files below a path, with only the wanted columns and rows.

    The source prunes what it can: whole folders and row groups by where, columns by columns."""
    if kind not in FILES:
        raise ValueError(f"{kind}: one of {', '.join(FILES)} is expected")
    df = spark.read.options(**options).format(kind).load(at)
    df = df if where is None else df.filter(where)
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def read_database(spark: SparkSession, url: str, table: str, split: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database with a JDBC driver on the class path; filters, columns and limits are pushed into its query.

    split: a whole-number column whose range (bounds) is read in parts at the same time."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownPredicate="true", pushDownAggregate="true", pushDownLimit="true", **options)
    if split:
        if not bounds:
            raise ValueError("a split column needs bounds")
        reader = reader.options(partitionColumn=split, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def read_queue(spark: SparkSession, servers: str, topic: str, start: str = "earliest", **options: str) -> DataFrame:
    """A stream of (key, value, partition, offset, timestamp) of a Kafka topic, if the connector is on the class path."""
    stream = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start}, **options).load()
    return stream.selectExpr("cast(key AS string) AS key", "cast(value AS string) AS value", "partition", "offset", "timestamp")


def write_table(df: DataFrame, kind: str, at: str, by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """df as files of a kind below a path, in folders by the values of some columns; rows of a folder meet in a few tasks."""
    if kind not in FILES:
        raise ValueError(f"{kind}: one of {', '.join(FILES)} is expected")
    writer = df.write.options(**options).format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(at)
