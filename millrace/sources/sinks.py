"""Loading DataFrames into tables, files, databases and Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.columns import field
from millrace.session import new_folder

BATCH_ROWS = 1000


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows while they are written, without a second pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_files(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", metadata: bool = False,
                partition_by: list[str] | None = None) -> int:
    """Write files and return the row count. ``metadata`` adds a one-row JSON sidecar at ``<path>.metadata``."""
    counted, seen = _counted(df)
    writer = counted.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    rows = seen.get["rows"]
    if metadata:
        sidecar = df.sparkSession.range(1).select(
            F.lit(path).alias("path"), F.lit(fmt).alias("format"), F.lit(rows).alias("rows"),
            F.current_timestamp().alias("written_at"))
        sidecar.coalesce(1).write.mode("overwrite" if mode == "overwrite" else "append").json(f"{path}.metadata")
    return rows


def create_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create the table from the DataFrame's schema unless it exists; ``path`` places it outside the warehouse."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        options = {"path": path} if path else {}
        df.limit(0).write.mode("ignore").options(**options).saveAsTable(name)


def load_table(df: DataFrame, name: str, create: bool = False, truncate: bool = False,
               path: str | None = None) -> int:
    """Load rows into a catalog table and return their number.

    A missing table is created when ``create`` is set and is an error otherwise; an existing one is emptied
    first when ``truncate`` is set. Columns are matched by name.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        if not create:
            raise ValueError(f"table {name!r} does not exist")
        create_table(df, name, path)
    columns = spark.table(name).columns
    missing = [c for c in df.columns if c not in columns]
    if missing:
        raise ValueError(f"table {name!r} has no column {', '.join(missing)}")
    target = spark.table(name).schema
    aligned = df.select(*[
        (field(c) if c in df.columns else F.lit(None).cast(target[c].dataType)).alias(c) for c in columns])
    counted, seen = _counted(aligned)
    counted.write.mode("overwrite" if truncate else "append").insertInto(name)
    return seen.get["rows"]


def swap_table(df: DataFrame, name: str) -> int:
    """Replace a table's content by rows that may be computed from it: write beside it, then switch location."""
    spark = df.sparkSession
    path = new_folder(spark, name.replace(".", "-"))
    rows = write_files(df, path)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=path, source="parquet")
    return rows


# Column types used when a load creates a database table; anything else is stored as text.
COLUMN_TYPES = {
    "SqlServer": {"string": "NVARCHAR(MAX)", "int": "INT", "long": "BIGINT", "double": "FLOAT", "decimal": "DECIMAL(18, 6)",
                  "bool": "BIT", "datetime": "DATETIME2", "date": "DATE", "time": "TIME", "guid": "UNIQUEIDENTIFIER",
                  "binary": "VARBINARY(MAX)"},
    "PostgreSql": {"string": "TEXT", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE PRECISION",
                   "decimal": "NUMERIC(18, 6)", "bool": "BOOLEAN", "datetime": "TIMESTAMP", "date": "DATE", "time": "TIME",
                   "guid": "UUID", "binary": "BYTEA"},
    "MySql": {"string": "TEXT", "int": "INT", "long": "BIGINT", "double": "DOUBLE", "decimal": "DECIMAL(18, 6)",
              "bool": "TINYINT(1)", "datetime": "DATETIME", "date": "DATE", "time": "TIME", "guid": "CHAR(36)",
              "binary": "BLOB"},
}
_KINDS = {T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "double",
          T.DoubleType: "double", T.DecimalType: "decimal", T.BooleanType: "bool", T.TimestampType: "datetime",
          T.TimestampNTZType: "datetime", T.DateType: "date", T.BinaryType: "binary"}


def jdbc_column_types(kind: str, schema: T.StructType) -> dict[str, str]:
    """Database column types for a schema; types without a counterpart become text."""
    types = COLUMN_TYPES[kind]
    return {f.name: types[_KINDS.get(type(f.dataType), "string")] for f in schema.fields}


def create_statement(kind: str, table: str, schema: T.StructType) -> str:
    """CREATE TABLE text for a database of the given kind."""
    opening, closing = {"SqlServer": "[]", "PostgreSql": '""', "MySql": "``"}[kind]
    columns = ", ".join(f"{opening}{name}{closing} {sql_type}" for name, sql_type in jdbc_column_types(kind, schema).items())
    return f"CREATE TABLE {table} ({columns})"


def jdbc_write_options(url: str, table: str, options: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a JDBC load; ``truncate`` keeps an existing table's own column types."""
    return {"url": url, "dbtable": table, "batchsize": str(BATCH_ROWS), "truncate": "true", **(options or {})}


def _driver_connection(spark, url: str, options: dict[str, str] | None):
    properties = spark._jvm.java.util.Properties()
    for key, value in (options or {}).items():
        properties.setProperty(key, value)
    return spark._jvm.java.sql.DriverManager.getConnection(url, properties)


def ensure_jdbc_table(connection, kind: str, table: str, schema: T.StructType, create: bool) -> None:
    """Create a missing table with the database's own column types if asked; otherwise a missing table is an error."""
    *place, name = table.split(".")
    found = connection.getMetaData().getTables(None, place[-1] if place else None, name, None)
    if found.next():
        return
    if not create:
        raise ValueError(f"table {table!r} does not exist")
    connection.createStatement().executeUpdate(create_statement(kind, table, schema))


def load_jdbc(df: DataFrame, url: str, table: str, kind: str, options: dict[str, str] | None = None, create: bool = False,
              truncate: bool = False, partitions: int | None = None) -> int:
    """Insert rows over JDBC in batches. Each partition is one transaction, so the load as a whole is not."""
    connection = _driver_connection(df.sparkSession, url, options)
    try:
        ensure_jdbc_table(connection, kind, table, df.schema, create)
    finally:
        connection.close()
    counted, seen = _counted(df if partitions is None else df.coalesce(partitions))
    counted.write.format("jdbc").options(**jdbc_write_options(url, table, options)) \
        .mode("overwrite" if truncate else "append").save()
    return seen.get["rows"]


def load_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                available_now: bool = True) -> StreamingQuery:
    """Append a stream to files exactly once: the file sink's log names each batch, so a retried batch adds nothing."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def kafka_records(df: DataFrame, key: str | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """key, value (JSON) and headers as the Kafka sink expects them; a missing key becomes a random one."""
    value = F.to_json(F.struct(*[field(c) for c in df.columns]))
    key_column = field(key).cast("string") if key else F.expr("uuid()")
    columns = [key_column.alias("key"), value.alias("value")]
    if headers:
        columns.append(F.array(*[
            F.struct(F.lit(k).alias("key"), F.encode(F.lit(v), "UTF-8").alias("value")) for k, v in headers.items()
        ]).alias("headers"))
    return df.select(*columns)


def publish_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None,
                  headers: dict[str, str] | None = None, checkpoint: str | None = None):
    """Write to Kafka with full acknowledgement; a stream needs ``checkpoint``."""
    records = kafka_records(df, key, headers)
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if df.isStreaming:
        return records.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return records.write.format("kafka").options(**options).save()
