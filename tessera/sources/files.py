"""Readers and writers for the file inputs of the workloads.

All readers take an explicit schema: no ``inferSchema`` double scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def clean_name(name: str) -> str:
    """One safe header style: runs of non-alphanumerics become one ``_``."""
    out = re.sub(r"[^0-9A-Za-z]+", "_", name.strip()).strip("_")
    if not out:
        out = "col"
    if out[0].isdigit():
        out = "c_" + out
    return out


def clean_headers(df: DataFrame) -> DataFrame:
    """Normalise every column name (``&``, spaces, ``/``, ``-``, dots)."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = clean_name(c)
        k = seen.get(n, 0)
        seen[n] = k + 1
        names.append(n if k == 0 else f"{n}_{k}")
    return df.toDF(*names)


def _fields(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _typed(raw: DataFrame, schema: StructType, names: dict[str, str]) -> DataFrame:
    """Text columns to their types: the text NA and, but for strings, a blank are
    missing; a blank string stays blank, quoted or not."""
    out = []
    for f in schema.fields:
        c = F.coalesce(F.col(f"`{names[f.name]}`"), F.lit(""))
        known = F.when(c != "NA", c)
        out.append((known if f.dataType.simpleString() == "string" else F.trim(known).try_cast(f.dataType)).alias(f.name))
    return raw.select(*out)


def read_delimited(spark: SparkSession, path: str, schema: StructType | str,
                   sep: str = "\t", header: bool = True, multi_line: bool = False) -> DataFrame:
    """Delimited text read as the scripts read it.

    With a header, columns are taken by name in any order (a missing one is an
    error); without, by position. Quotes inside quotes are doubled. ``NA`` is
    missing, a blank is an empty string, and a value that doesn't fit its type is
    missing. ``multi_line`` allows newlines inside quotes, at the price that a
    file is read by one task.
    """
    fields = _fields(schema)
    reader = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"') \
        .option("multiLine", multi_line).option("mode", "PERMISSIVE").option("inferSchema", False)
    if header:
        raw = reader.csv(path)
        lost = [f.name for f in fields if f.name not in raw.columns]
        if lost:
            raise ValueError(f"no columns {lost} in the header of {path}")
        return _typed(raw, fields, {f.name: f.name for f in fields})
    raw = reader.schema(StructType([StructField(f"_c{i}", StringType()) for i in range(len(fields))])).csv(path)
    return _typed(raw, fields, {f.name: f"_c{i}" for i, f in enumerate(fields)})


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             header: bool = True, multi_line: bool = False) -> DataFrame:
    """Comma-separated text with a header."""
    return read_delimited(spark, path, schema, sep=",", header=header, multi_line=multi_line)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated text with a header, missing values as NA, quotes doubled."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")).alias(c) for c in df.columns]
    df.select(*text).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_headerless(spark: SparkSession, path: str, schema: StructType | str,
                    names: dict[str, str] | None = None) -> DataFrame:
    """Headerless CSV, then rename generated columns (``_c0`` -> ``Digit``)."""
    df = read_delimited(spark, path, schema, sep=",", header=False)
    for old, new in (names or {}).items():
        df = df.withColumnRenamed(old, new)
    return df


def write_slices(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", max_rows: int = 5_000_000) -> None:
    """One CSV folder per slice key, with header; partition pruning on read.

    Rows are rebalanced by the key: the planner splits a large slice over tasks
    and merges small ones; a file holds ``max_rows`` at most.
    """
    (df.hint("rebalance", *[F.col(c) for c in by])
       .write.mode(mode).partitionBy(*by).option("header", True).option("escape", '"')
       .option("maxRecordsPerFile", max_rows).csv(path))


def read_slices(spark: SparkSession, path: str, schema: StructType | str,
                where: str | None = None) -> DataFrame:
    """Read slices back; a filter on the slice key prunes folders."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.filter(where) if where else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the driver data set."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
