"""Shared pieces of the text operators: written intermediate tables and Arrow mapping.

Executors share no local folder with the driver, so every intermediate table is
written below the folder that the session names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations


from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.sources.tables import cut, fresh_path, shared_dir  # noqa: F401

#: The ASCII white space of the contracts: words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str | T.StructType,
    make: Callable[[], Callable[[list[list]], list[list]]],
    chunk_chars: int = 4_000_000,
    sized: int = 1,
) -> DataFrame:
    """Map ``columns`` of ``df`` to rows of ``schema`` in Python, chunk by chunk.

    ``make()`` runs once in each task and returns the chunk function, which gets
    the columns as lists and returns columns as lists (or Arrow arrays).  A chunk
    holds about ``chunk_chars`` bytes of the column at index ``sized``, so
    memory follows the longest text and not the batch.
    """
    parsed = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    out = arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            column = batch.column(sized)
            textual = pa.types.is_string(column.type) or pa.types.is_binary(column.type)
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist() if textual else [1] * batch.num_rows
            start = total = 0
            for i, n in enumerate(sizes):
                total += n
                if total >= chunk_chars or i == len(sizes) - 1:
                    part = batch.slice(start, i + 1 - start)
                    got = work([part.column(k).to_pylist() for k in range(part.num_columns)])
                    start, total = i + 1, 0
                    yield pa.RecordBatch.from_arrays([g if isinstance(g, pa.Array) else pa.array(g, type=f.type) for g, f in zip(got, out, strict=True)], schema=out)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, parsed)
