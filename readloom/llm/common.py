"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.cuts import cut, remove, shared_folder

__all__ = ["WORD", "crc_mod", "crc_sql", "cut", "documents", "estimated_bytes", "freed", "id_type", "map_rows", "release", "remove", "shared_folder", "sliced", "text_or_empty"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents`."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def estimated_bytes(docs: DataFrame) -> int:
    """Bytes of a table with a column text as the optimizer estimates them, from the sizes of files: nothing is read. Only where it knows nothing the texts are measured."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0


def text_or_empty(name: str = "text") -> Column:
    """The text, where a null counts as an empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_sql(text: str) -> str:
    """DuckDB SQL of the crc32 of an expression's UTF-8 bytes, bit by bit, as DuckDB has none."""
    digits = f"hex(encode({text}))"
    codes = f"list_transform(range(0, length({digits}) // 2), lambda k: ('0x' || substr({digits}, k * 2 + 1, 2))::bigint)"
    byte = "list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda z, k: case when z % 2 = 1 then xor(z >> 1, 3988292384) else z >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: {byte}), 4294967295)"


def release() -> None:
    """Give freed memory back to the system. Python workers serve one task after another, and would keep the most that any of them had."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def freed(run):
    """The function `run` for mapInArrow, with release() once its rows have gone."""

    def each(batches):
        yield from run(batches)
        release()

    return each


def sliced(batches, rows: int = 512):
    """The Arrow batches in slices of so many rows, so that plain values and results are made of few at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, columns: list[str], schema: str, fn, rows: int = 512) -> DataFrame:
    """fn(list per column) -> list per output column, over slices of Arrow batches. fn gets plain Python values."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for part in sliced(batches, rows):
            out = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, to, strict=True)], schema=to)

    return df.select(*columns).mapInArrow(freed(run), schema)


def id_type(docs: DataFrame, name: str = "doc_id") -> str:
    return docs.schema[name].dataType.simpleString()
