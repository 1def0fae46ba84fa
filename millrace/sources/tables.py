"""Sources and sinks (S1-S10): every cell a nullable string on the way in, safe cells on the way out."""

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.staging import new_path

#: The literals that stand for a missing cell, exactly as written.
NA_LITERALS = ("", "N/A", "null", "NULL", "None", "nan")
#: What each file extension holds.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}


def name_of(column: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def cell(value: Column) -> Column:
    """S5 for one column: text, or null for a missing-value literal."""
    text = value.cast("string")
    return F.when(~text.isin(*NA_LITERALS), text)


def normalize_nulls(df: DataFrame) -> DataFrame:
    """All columns as strings, the six literals as null; nothing is trimmed."""
    return df.select(*[cell(name_of(c)).alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Header, UTF-8, every field a string. Short rows are padded; a row with more fields than the header raises
    when an action reads it."""
    header = spark.read.option("sep", sep).option("header", True).csv(path).columns
    names = [c.removeprefix("﻿") for c in header]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_over"]])
    rows = spark.read.schema(schema).options(sep=sep, header=True, multiLine=True, encoding="UTF-8", enforceSchema=True).csv(path)
    first = F.when(F.col("_over").isNotNull(), F.raise_error(F.lit("a row has more fields than the header"))).otherwise(name_of(names[0]))
    return rows.select(first.alias(names[0]), *[name_of(c) for c in names[1:]])


def json_objects(content: bytes) -> list[str]:
    """The objects of a file's array, or its only object, as they are written but each on one line; no others pass."""
    text = content.decode(json.detect_encoding(content)).strip(" \t\r\n")
    listed, decoder, blank, out = text.startswith("["), json.JSONDecoder(), re.compile(r"[ \t\r\n]*"), []
    if listed and not (len(text) > 1 and text.endswith("]")):
        raise ValueError("an array is not closed")
    at = blank.match(text, int(listed)).end()
    end = len(text) - 1 if listed else len(text)
    while at < end:
        value, stop = decoder.raw_decode(text, at)
        if not isinstance(value, dict):
            raise ValueError("a file holds something else than objects")
        out.append(re.sub(r"[\r\n]", " ", text[at:stop]))
        at = blank.match(text, stop).end()
        if at == end:
            break
        if not listed or text[at] != ",":
            raise ValueError("a file holds something else than one array of objects")
        at = blank.match(text, at + 1).end()
        if at == end:
            raise ValueError("an array ends with a comma")
    return out


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """One array of objects per file; anything else fails.

    The arrays become lines in the shared folder, an object each. Spark's own reader of arrays opens a file anew for every
    number that it keeps as text, and infers their schema in few tasks; lines it reads at once, as split as they are long."""

    @F.arrow_udf("array<string>")
    def objects(batch: pa.Array) -> pa.Array:
        return pa.array([json_objects(b) for b in batch.to_pylist()], pa.list_(pa.string()))

    files = spark.read.format("binaryFile").load(path)
    parts = files.columns[4:]  # behind path, time, length and content: from names of folders
    lines = new_path(spark, "json-lines")
    files.select(F.explode(objects("content")).alias("value"), *map(name_of, parts)).write.partitionBy(*parts).text(lines)
    return read_jsonl(spark, lines)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """S3: one object per line; a line that is none fails."""
    return spark.read.options(primitivesAsString=True, mode="FAILFAST").json(path)


def flatten_one_level(df: DataFrame) -> DataFrame:
    """Fields of struct columns become parent.child; what lies deeper becomes JSON text."""

    def flat(value: Column, kind: T.DataType) -> Column:
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        return F.to_json(value) if nested else value.cast("string")

    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            out += [flat(name_of(field.name).getField(f.name), f.dataType).alias(f"{field.name}.{f.name}") for f in field.dataType.fields]
        else:
            out.append(flat(name_of(field.name), field.dataType).alias(field.name))
    return df.select(*out)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of text files, split at line feeds only so that carriage returns stay in the line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """One loader by format or extension; everything arrives as nullable strings."""
    kind = fmt or FORMATS.get(path.rstrip("/").rpartition(".")[2].lower())
    if kind == "csv":
        rows = read_delimited(spark, path)
    elif kind == "tsv":
        rows = read_delimited(spark, path, "\t")
    elif kind == "json":
        rows = flatten_one_level(read_json_records(spark, path))
    elif kind == "jsonl":
        rows = flatten_one_level(read_jsonl(spark, path))
    elif kind == "parquet":
        rows = flatten_one_level(spark.read.parquet(path))
    else:
        raise ValueError(f"no reader for {fmt or path}")
    return normalize_nulls(rows)


def write_table(df: DataFrame, path: str, fmt: str) -> None:
    """Csv and tsv with guarded cells, json lines, or parquet; dates in ISO form."""
    iso = {"dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    if fmt in ("csv", "tsv"):
        as_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        formula_safe(df).write.options(header=True, sep="," if fmt == "csv" else "\t", **as_is, **iso).csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.options(**iso).json(path)
    elif fmt == "parquet":
        df.write.parquet(path)
    else:
        raise ValueError(f"no writer for {fmt}")


def sorted_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column report: keys sorted at every level, nulls written."""

    def ordered(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = sorted(kind.fields, key=lambda f: f.name)
            return F.when(value.isNotNull(), F.struct(*[ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: ordered(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.map_from_entries(F.array_sort(F.map_entries(value)))
        return value

    fields = sorted(df.schema.fields, key=lambda f: f.name)
    row = F.struct(*[ordered(name_of(f.name), f.dataType).alias(f.name) for f in fields])
    return df.select(F.to_json(row, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("report"))


def write_report(df: DataFrame, path: str) -> None:
    """A profile, a difference or verdicts as JSON lines with sorted keys."""
    sorted_json(df).write.text(path)


def formula_safe_cell(value: Column) -> Column:
    """An apostrophe in front of what a spreadsheet would run: = + @ tab or return, or a minus that starts no number."""
    body = F.ltrim(value)
    risky = value.rlike(r"^ *[=+@\t\r]") | (body.startswith("-") & ~body.rlike(r"^-(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"))
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def formula_safe(df: DataFrame) -> DataFrame:
    """Every string cell and header guarded for delimited sinks."""
    lead = {c: "'" + c if c.lstrip(" ")[:1] in ("=", "+", "@", "\t", "\r", "-") else c for c in df.columns}
    kinds = dict(df.dtypes)
    return df.select(*[(formula_safe_cell(name_of(c)) if kinds[c] == "string" else name_of(c)).alias(lead[c]) for c in df.columns])


def ledger_safe_cell(value: Column) -> Column:
    """The stricter guard of evidence ledgers: any lead of tab, return or line feed, or a first sign = + - @."""
    return F.when(value.rlike(r"^(?:[\t\r\n]|\s*[=+\-@])"), F.concat(F.lit("'"), value)).otherwise(value)


def ledger_safe(df: DataFrame) -> DataFrame:
    """Every string cell under the ledger guard."""
    kinds = dict(df.dtypes)
    return df.select(*[(ledger_safe_cell(name_of(c)) if kinds[c] == "string" else name_of(c)).alias(c) for c in df.columns])
