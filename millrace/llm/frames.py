"""Small helpers: Arrow passes that add columns, and folders for written intermediate tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.functions.columns import field
from millrace.session import new_folder

SLICE_ROWS = 128       # rows held as Python objects at a time
SLICE_BYTES = 1 << 24  # and about so many bytes of them


def ready(spark: SparkSession) -> None:
    """Make the package importable in the Python workers of a local session, whatever folder it was started in."""
    context = spark.sparkContext
    if context.master.startswith("local") and "cluster" not in context.master and not hasattr(context, "_llm_ready"):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addFile(f"file://{package}", recursive=True)
        context._llm_ready = True


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns of these names in any case, so that new columns replace them."""
    taken = {n.lower() for n in names}
    return df.select(*[field(c) for c in df.columns if c.lower() not in taken])


def add_columns(df: DataFrame, inputs: Sequence[str], fields: str, make: Callable[[], Callable]) -> DataFrame:
    """Add the columns ``fields`` (a DDL string), computed in Arrow batches without a shuffle.

    ``make`` runs once per task and returns a function from the lists of a slice of the ``inputs`` columns to one
    list or Arrow array per new column. Columns of the same names are replaced.
    """
    ready(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    if any("." in c or "`" in c or c.lower().startswith("__in_") for c in df.columns):  # names that an Arrow pass cannot take
        names = {f"column_{i}": c for i, c in enumerate(df.columns)}
        plain = {c: n for n, c in names.items()}
        made = add_columns(df.toDF(*names), [plain[c] for c in inputs], fields, make)
        taken = {n.lower() for n in new.names}
        return made.select(*[F.col(n).alias(c) for n, c in names.items() if c.lower() not in taken], *[f"`{n}`" for n in new.names])
    read = df.select(*[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(inputs)],
                     *[f"`{c}`" for c in without(df, new.names).columns])
    kept = read.columns[len(inputs):]
    schema = T.StructType([read.schema[len(inputs) + i] for i in range(len(kept))] + list(new))
    types, n = [f.type for f in to_arrow_schema(new)], len(inputs)

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch):
                made = compute(*[part.column(i).to_pylist() for i in range(n)])
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, types)]
                yield pa.RecordBatch.from_arrays([part.column(n + i) for i in range(len(kept))] + arrays,
                                                 [*kept, *new.names])

    return read.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch):
    """A batch in parts of at most SLICE_ROWS rows and, but for single rows, about SLICE_BYTES bytes."""
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, SLICE_ROWS)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: the rows go to a table in the shared folder and are read back from it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
