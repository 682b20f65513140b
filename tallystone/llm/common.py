"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def add_from_text(
    df: DataFrame,
    text_col: str,
    name: str,
    fields: str,
    maker: Callable[[], Callable[[list], list[dict]]],
) -> DataFrame:
    """Append a struct column computed from the text column, one Arrow batch at a time.

    `maker` runs once in a task and returns a function from a list of texts to a list of dicts.
    All columns pass through; nothing moves between tasks.
    """
    added = T.StructField(name, T.StructType.fromDDL(fields), False)
    schema = T.StructType([*df.schema.fields, added])
    at = df.columns.index(text_col)
    kind = arrow_struct(added.dataType)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = maker()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                values = pa.array(work(part.column(at).to_pylist()), type=kind)
                yield pa.RecordBatch.from_arrays([*part.columns, values], names=names)

    return df.mapInArrow(run, schema)


def arrow_struct(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_struct(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", arrow_struct(kind.elementType)))
    return {
        "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "boolean": pa.bool_(), "binary": pa.binary(),
    }[kind.simpleString()]


def crc32_of_id(col: str) -> F.Column:
    return F.crc32(F.col(col).cast("string").cast("binary"))
