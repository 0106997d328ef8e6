"""Reading from queries, files, databases and Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from millrace.functions.columns import field
from millrace.sources import json_arrays

TIMEOUT_SECONDS = 300
CORRUPT = "_corrupt_record"

# JDBC driver classes of the supported database kinds.
DRIVERS = {
    "SqlServer": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "PostgreSql": "org.postgresql.Driver",
    "MySql": "com.mysql.cj.jdbc.Driver",
}


def query(spark: SparkSession, sql: str, params: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of a SQL text with named parameters (``:name``) over the given views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params or {})


def jdbc_options(kind: str, url: str, sql: str | None = None, table: str | None = None, partition_column: str | None = None,
                 lower=None, upper=None, partitions: int = 32, fetch_rows: int = 10_000, **extra: str) -> dict[str, str]:
    """Reader options for a relational source; a partition column splits the read into parallel ranges.

    The range bounds only place the splits, they do not filter. A partitioned read needs ``dbtable``, so a query
    is wrapped as a derived table.
    """
    if kind not in DRIVERS:
        raise NotImplementedError(f"source kind {kind!r} is not supported")
    if (sql is None) == (table is None):
        raise ValueError("give either a query or a table")
    options = {"url": url, "driver": DRIVERS[kind], "fetchsize": str(fetch_rows), "queryTimeout": str(TIMEOUT_SECONDS)}
    if partition_column is None:
        options["query" if sql else "dbtable"] = sql or table
    else:
        if lower is None or upper is None:
            raise ValueError("a partitioned read needs lower and upper bounds")
        options |= {"dbtable": f"({sql}) q" if sql else table, "partitionColumn": partition_column,
                    "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return {**options, **extra}


def jdbc(spark: SparkSession, kind: str, url: str, **spec) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(kind, url, **spec)).load()


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return schema if CORRUPT in schema.names else T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])


def _split_corrupt(df: DataFrame, keep: bool) -> DataFrame:
    return df if keep else df.filter(field(CORRUPT).isNull()).drop(CORRUPT)


def csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True, keep_corrupt: bool = False,
        **options: str) -> DataFrame:
    """CSV with a declared schema; rows that do not fit are dropped, or kept with their text."""
    reader = spark.read.schema(_with_corrupt(schema)).options(
        header=header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options)
    return _split_corrupt(reader.csv(path), keep_corrupt)


def json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = True,
         keep_corrupt: bool = False, split: bool = False) -> DataFrame:
    """JSON arrays of objects (``multi_line``) or one object per line.

    Items that are not objects are dropped; a null document gives no rows. A whole-document array is read by one
    task per file; with ``split`` and a schema a large one is read by many (``json_arrays``).
    """
    if split:
        if schema is None:
            raise ValueError("reading an array in splits needs a schema")
        return _split_corrupt(json_arrays.read(spark, path, _with_corrupt(schema), CORRUPT), keep_corrupt)
    reader = spark.read.options(multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    df = reader.schema(_with_corrupt(schema)).json(path) if schema is not None else reader.json(path)
    if CORRUPT not in df.columns:
        return df
    if schema is None and df.columns == [CORRUPT]:
        return df if keep_corrupt else df.drop(CORRUPT).filter(F.lit(False))
    return _split_corrupt(df, keep_corrupt)


def xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).xml(path)


def stream_files(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream over files that arrive in a folder."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def kafka_options(servers: str, topics: list[str], **extra: str) -> dict[str, str]:
    """Subscription options: earliest offsets, headers on. Offsets live in the query's checkpoint."""
    return {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": "earliest",
            "includeHeaders": "true", "kafka.session.timeout.ms": "30000", "kafka.max.poll.interval.ms": "300000", **extra}


def kafka(spark: SparkSession, servers: str, topics: list[str], schema: T.StructType, **extra: str) -> DataFrame:
    stream = spark.readStream.format("kafka").options(**kafka_options(servers, topics, **extra)).load()
    return parse_kafka(stream, schema)


def parse_kafka(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Kafka records (key, value, headers) to typed columns, ``key`` and text ``headers``; null messages are skipped."""
    text = F.col("value").cast("string")
    parsed = records.filter(F.col("value").isNotNull()).select(
        F.col("key").cast("string").alias("key"), F.from_json(text, schema).alias("message"),
        F.map_from_entries(F.transform(
            F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")),
            lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8")))).alias("headers"))
    return parsed.filter(F.col("message").isNotNull()).select("key", "headers", "message.*")
