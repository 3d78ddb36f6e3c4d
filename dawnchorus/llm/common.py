"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnchorus.session import dropped, ship_package, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_SPARK = {"long": T.LongType, "double": T.DoubleType, "int": T.IntegerType, "string": T.StringType,
          "boolean": T.BooleanType}
_ARROW = {"long": pa.int64, "double": pa.float64, "int": pa.int32, "string": pa.string, "boolean": pa.bool_}
#: ASCII white space, as a regular-expression class body (space, tab to carriage return).
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage: what a lost executor had computed is read again from the
    shared files, and row ids given before stay as they are.
    """
    return written(df, name)


def drop_table(*tables: DataFrame) -> None:
    """Delete materialized tables whose last reader has run; nothing lazy may read them any more."""
    dropped(*tables)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` whose workers have the package, and give back the memory of a task when it has ended."""
    ship_package(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(whole, schema)


def release_memory() -> None:
    """Return what is free in this process to the system: a worker waits for tasks of other stages with it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


#: Rows whose texts a task takes out of a batch at a time.
SLICE_ROWS = 500


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """A batch's rows, some at a time: their Python objects never exist all at once."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees on the result."""
    return F.translate(text, UPPER, LOWER)


def fast_lower(text: Column) -> Column:
    """Lower case whose ASCII letters come from A-Z alone; other letters may change too.

    Several times faster than ``ascii_lower``.  For matching ASCII words it is the
    same: the one other character whose lower case is ASCII (U+212A) is put aside first.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def spaced(text: Column) -> Column:
    """ASCII white space (tab to carriage return) turned into spaces, one for one."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def space_words(text: Column) -> Column:
    """The words between ASCII white space."""
    return F.array_remove(F.split(spaced(text), " "), "")


def rest(array: Column, start: int) -> Column:
    """The array from its ``start``-th element (from 1) on."""
    return F.slice(array, start, 1 << 30)


def hash60(text: Column) -> Column:
    """The first 60 bits of MD5 as a long; SQL engines can compute the same."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash60_sql(text: str) -> str:
    """``hash60`` in DuckDB."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the parts alone."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (hash60(key) + 0.5) / float(1 << 60)


def uniform_sql(seed: str, *parts: str) -> str:
    key = " || '|' || ".join([f"'{seed}'", *[f"coalesce(CAST({p} AS VARCHAR), 'null')" for p in parts]])
    return f"(({hash60_sql(key)} + 0.5) / {float(1 << 60)!r})"


def score_rows(docs: DataFrame, text: str, fields: dict[str, str], make_scorer,
               columns: list[str] | None = None) -> DataFrame:
    """Add to each row what a scorer says of its text; the row (or only its ``columns``) stays packed in ``row``.

    ``make_scorer()`` is called once in each task and returns a function from a list of
    texts (null: "") to one list per field.  Rows pass through in Arrow batches, which
    Spark bounds by bytes; a text that is a column of the packed row goes to the task once,
    and ``SLICE_ROWS`` rows are scored at a time.
    """
    names = columns or docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    within = text in names and docs.schema[text].dataType == T.StringType()
    packed = docs.select(row) if within else docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    schema = T.StructType([packed.schema["row"], *[T.StructField(k, _SPARK[v]()) for k, v in fields.items()]])
    place = names.index(text) if within else None

    def run(batches):
        scorer = make_scorer()
        for batch in batches:
            for part in slices(batch):
                given = part.column("row")
                bodies = part.column("body") if place is None else given.field(place)
                found = scorer([t or "" for t in bodies.to_pylist()])
                fresh = [pa.array(found[i], _ARROW[t]()) for i, t in enumerate(fields.values())]
                yield pa.RecordBatch.from_arrays([given, *fresh], names=["row", *fields])

    return map_batches(packed, run, schema)


def unpack(columns: list[str]) -> list[Column]:
    """The columns of the packed row."""
    return [F.col("row").getField(c).alias(c) for c in columns]
