"""Reading and writing delimited, JSON and compressed files."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.cluster import ship
from quillon.functions import msgpack


def scan_delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = "\t", header: bool = True, keep: Column | None = None, strict: bool = True) -> DataFrame:
    """Rows of delimited files; ``strict`` fails on a row of another width or type."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    rows = reader.csv(paths)
    return rows if keep is None else rows.filter(keep)


def bad_lines(spark: SparkSession, paths: str | list[str], schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """The lines of delimited files that do not fit the schema; a header has the columns' names."""
    full = T._parse_datatype_string(schema)
    names = sep.join(full.names)
    read = F.from_csv("value", schema + ", _bad string", {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(paths)
    return (lines.filter(F.col("value") != names) if header else lines).select(read.alias("r")).filter("r._bad IS NOT NULL").select("r._bad")


def scan_ndjson(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def scan_json_array(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Documents of files that hold one array each; anything but an array or object is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)


def scan_blocks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of lines set apart by empty lines."""
    return spark.read.option("lineSep", "\n\n").text(paths).select(F.trim("value").alias("block")).filter("block <> ''")


# The first bytes of compressed formats.
MAGIC = ((b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz"), (b"PK\x03\x04", "zip"))


def expanded(content: bytes, member: str | None = None) -> bytes:
    """The plain bytes of a compressed file, told by its first bytes."""
    kind = next((k for m, k in MAGIC if content.startswith(m)), None)
    if kind == "gz":
        return gzip.decompress(content)
    if kind == "bz2":
        return bz2.decompress(content)
    if kind == "xz":
        return lzma.decompress(content)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read(member or archive.namelist()[0])
    return content


def _expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"path": batch["path"], "content": [expanded(bytes(c)) for c in batch["content"]]})


def open_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of files, unpacked whatever their compression; a file fits in memory."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_expand, "path string, content binary")


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, md5, size) of files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5("content").alias("md5"), F.col("length").alias("size"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """Documents as JSON text; null fields are written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def _yaml_scalar(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if value == {} or value == []:
        return "{}" if isinstance(value, dict) else "[]"
    text = str(value)
    if not isinstance(value, str):
        return text
    plain = text and text == text.strip() and text[0] not in "!&*-?|>@`\"'%{}[],#:" and ": " not in text and " #" not in text and "\n" not in text
    if plain and text.lower() not in ("true", "false", "null", "yes", "no", "~") and not text.replace(".", "", 1).isdigit():
        return text
    return json.dumps(text, ensure_ascii=False) if "\n" in text else "'" + text.replace("'", "''") + "'"


def to_yaml(value, indent: int = 0) -> str:
    """A value as YAML, keys in their order."""
    pad = "  " * indent
    nested = lambda v: isinstance(v, (dict, list)) and v
    if isinstance(value, dict) and value:
        return "".join(f"{pad}{k}:" + (f"\n{to_yaml(v, indent + 1)}" if nested(v) else f" {_yaml_scalar(v)}\n") for k, v in value.items())
    if isinstance(value, list) and value:
        return "".join(f"{pad}- " + (to_yaml(v, indent + 1).lstrip() if nested(v) else f"{_yaml_scalar(v)}\n") for v in value)
    return f"{pad}{_yaml_scalar(value)}\n"


def to_msgpack_rows(df: DataFrame) -> DataFrame:
    """Each row as one MessagePack map, in the column ``packed``."""
    ship(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None)
            yield pd.DataFrame({"packed": [msgpack.pack(dict(zip(names, map(_plain, row), strict=True))) for row in rows]})

    return df.mapInPandas(run, "packed binary")


def _plain(value):
    """A value without the types of arrays and data frames."""
    return value.item() if hasattr(value, "item") else value.to_pydatetime() if hasattr(value, "to_pydatetime") else value


def compacted(spark: SparkSession, source: str, target: str, size: int) -> DataFrame:
    """Small Parquet files as few of about ``size`` bytes."""
    rows = spark.read.parquet(source)
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    total = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    rows.repartition(max(1, -(-total // size))).write.parquet(target)
    return spark.read.parquet(target)


def older_than(rows: DataFrame, moment: Column) -> DataFrame:
    """(file, older): the files that rows come from, and whether they changed before a moment."""
    files = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("_at")).distinct()
    return files.select("file", (F.col("_at") < moment).alias("older"))


def load_objects(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Documents of compressed files of JSON lines, whatever their compression; pickles are not read, as they can run code."""
    lines = open_files(spark, paths).select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", schema).alias("d")).select("d.*")
