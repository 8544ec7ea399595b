"""Sources and sinks: delimited files with header guards, positional JSON, event lines, calendars."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, path: str, expect: list[str], sep: str = ",") -> DataFrame:
    """A delimited file as strings, its header trimmed and without a byte-order mark; all expected columns must be there."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", sep == ",").option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing = [c for c in expect if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: the header lacks {missing}")
    return df


def read_positional(spark: SparkSession, path: str, rows: str = "rows", header: str = "cols") -> DataFrame:
    """An object with column names and rows of values by position, as a table of strings."""
    whole = spark.read.option("multiLine", True).schema(f"{header} array<string>, {rows} array<array<string>>").json(path)
    names = whole.select(header).first()[0]
    row = whole.select(F.explode(rows).alias("r"))
    return row.select(*[F.try_element_at("r", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_nested(spark: SparkSession, path: str, field: str) -> DataFrame:
    """The rows of an array field of a JSON object that fills a file, with the schema that they show."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select(F.explode(field).alias("r")).select("r.*")


def read_zip_members(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """The wanted columns, as strings, of a CSV member of every ZIP archive at path; archives without it give no rows.

    Archives are read one a row, so each must fit into a task's memory.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    if member in archive.namelist():
                        with archive.open(member) as f:
                            yield from pd.read_csv(f, usecols=columns, dtype=str, keep_default_na=False, chunksize=50_000, encoding="utf-8-sig")

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lambda frames: (f[columns] for f in rows(frames)), schema)


def lines_of_chunks(chunks: DataFrame, request: str, order: str) -> DataFrame:
    """request, pos, line of texts that came in chunks cut anywhere; the last line needs no line end.

    Chunks are dealt by request and sorted; a task holds one unfinished line.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, rest, n = None, "", 0
        kept: list[tuple] = []

        def flush() -> None:
            if rest:
                kept.append((current, n, rest))

        for frame in frames:
            for r, chunk in zip(frame[request], frame["chunk"], strict=True):
                if r != current:
                    flush()
                    current, rest, n = r, "", 0
                *whole, rest = (rest + (chunk or "")).split("\n")
                kept += [(r, n + i, line) for i, line in enumerate(whole)]
                n += len(whole)
            yield pd.DataFrame(kept, columns=[request, "pos", "line"])
            kept.clear()
        flush()
        yield pd.DataFrame(kept, columns=[request, "pos", "line"])

    dealt = chunks.select(request, order, "chunk").repartition(request).sortWithinPartitions(request, order)
    return dealt.mapInPandas(fold, f"{request} {dict(chunks.dtypes)[request]}, pos int, line string")


def read_saved(df: DataFrame, raw: str, schema: T.StructType, needed: list[str], before: dict[str, str]) -> DataFrame:
    """Saved JSON rows by schema: malformed ones and those that lack a needed field go, fields of the version before stand in.

    before: new field -> the old one that is read where the new one is absent.
    """
    fields = [F.coalesce(F.col(f"new.{f.name}"), F.col(f"old.{before[f.name]}").cast(f.dataType)) if f.name in before else F.col(f"new.{f.name}") for f in schema]
    old = T.StructType([T.StructField(v, T.StringType()) for v in before.values()])
    parsed = df.select("*", F.from_json(raw, schema).alias("new"), F.from_json(raw, old).alias("old"))
    out = parsed.select(*df.columns, *[c.alias(f.name) for c, f in zip(fields, schema, strict=True)])
    return out.where(" AND ".join(f"`{c}` IS NOT NULL" for c in needed))


def read_events(spark: SparkSession, path: str, schema: T.StructType, stream: bool = False) -> DataFrame:
    """NDJSON lines by schema; lines that are no JSON object are left out. stream: a streaming table of a folder."""
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"), "value")
    return parsed.where(F.col("e").isNotNull() & F.col("value").rlike("^\\s*\\{")).select("e.*")


def read_capped(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Whole files up to a size; larger ones have null content."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))


def write_allowed(df: DataFrame, path: str, columns: list[str], mode: str = "append") -> None:
    """Only the allowed columns, absent ones as null."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).parquet(path)


def record_once(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of new whose key is neither recorded nor repeated, with the columns of known; absent ones are null.

    A row without a key is always recorded.
    """
    rows = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema])
    named = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known.select(key), key, "left_anti")
    return named.select(*known.columns).unionByName(rows.where(F.col(key).isNull()))


def write_report(df: DataFrame, path: str, order: list) -> None:
    """A small ordered table as one JSON file: a report of bounded size, so one task writes it."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def write_positional(df: DataFrame) -> DataFrame:
    """Rows as JSON arrays by position, one text a row."""
    return df.select(F.to_json(F.array(*[F.col(c).cast("string") for c in df.columns])).alias("value"))


def calendar_escape(c: Column) -> Column:
    """Text of a calendar property: backslash, semicolon, comma and line breaks escaped."""
    return F.regexp_replace(F.regexp_replace(c, "([\\\\;,])", "\\\\$1"), "\\r\\n|\\n|\\r", "\\\\n")


def calendar_fold(line: str, most: int = 75) -> str:
    """Lines of at most most octets, continued after CRLF and a space, never cut inside a character."""
    out, size = [], 0
    for c in line:
        n = len(c.encode())
        if size + n > most:
            out.append("\r\n ")
            size = 1
        out.append(c)
        size += n
    return "".join(out)


def calendar_events(df: DataFrame) -> DataFrame:
    """uid, start, summary to one VEVENT text each."""
    fold = F.pandas_udf(lambda s: s.map(calendar_fold, na_action="ignore"), "string")
    stamp = F.date_format("start", "yyyyMMdd'T'HHmmss'Z'")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("uid").cast("string")), F.concat(F.lit("DTSTART:"), stamp), fold(F.concat(F.lit("SUMMARY:"), calendar_escape(F.col("summary")))), F.lit("END:VEVENT")]
    return df.select("uid", F.concat_ws("\r\n", *lines).alias("event"))
