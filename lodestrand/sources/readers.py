"""Readers: delimited, .smi, gzip and parquet tables, optional tables, SQL sources."""

from __future__ import annotations

import gzip
import posixpath
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import unique_names

def file_system(path: str):
    """The file system of a path or URI, and the path in it: local, or one that all nodes share."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        import os

        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/") if path.startswith("file:") else path)


def file_size(path: str) -> int | None:
    """Bytes of a file, -1 for a folder, None where there is nothing."""
    from pyarrow import fs

    where, inside = file_system(path)
    info = where.get_file_info(inside)
    return None if info.type == fs.FileType.NotFound else -1 if info.type == fs.FileType.Directory else info.size


DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(path: str, size: int = 4096) -> str:
    """The delimiter that cuts the first lines into the same number of fields, most fields first; else a tab if there is
    one, else a comma."""
    where, inside = file_system(path)
    with where.open_input_stream(inside, compression=None) as f:
        head = (gzip.GzipFile(fileobj=f).read(size) if path.endswith(".gz") else f.read(size)).decode("utf-8", "replace")
    lines = [x for x in head.splitlines() if x.strip()][:20]
    if len(head) >= size and len(lines) > 1:
        lines = lines[:-1]
    counts = {d: {x.count(d) for x in lines} for d in DELIMITERS}
    even = [(min(c), d) for d, c in counts.items() if len(c) == 1 and min(c) > 0]
    return max(even, key=lambda x: x[0])[1] if even else "\t" if "\t" in head else ","


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, delimiter: str | None = None) -> DataFrame:
    """All columns as text, empty fields kept as empty text, header names trimmed and made unique; or by `schema`."""
    options = {"sep": delimiter or sniff_delimiter(path), "quote": '"', "escape": '"'}
    if schema is not None:
        return spark.read.options(header=True, **options).schema(schema).csv(path)
    options |= {"nullValue": "\0", "emptyValue": ""}
    first = spark.read.options(header=False, **options).csv(path).first()
    if first is None:
        return spark.createDataFrame([], "value string")
    names = unique_names([x or "" for x in first])
    text = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
    # The names don't match the file's own, so they must not be compared with it.
    rows = spark.read.options(header=True, enforceSchema=True, **options).schema(text).csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in rows.columns]).toDF(*names)


def read_smi(spark: SparkSession, path: str) -> DataFrame:
    """(line, smiles, id, name) of a .smi file: blank lines and lines that start with # are left out; `line` is the number
    of the physical line. Line numbers need the file in one piece, so a file is one task; many files are many tasks."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("i", "text"))
    parts = F.split(F.trim("text"), "\\s+")
    rest = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, F.size(parts)), " "))
    return lines.where("trim(text) <> '' AND NOT startswith(trim(text), '#')").select((F.col("i") + 1).alias("line"), F.get(parts, F.lit(0)).alias("smiles"), F.get(parts, F.lit(1)).alias("id"), rest.alias("name"))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending: parquet, .smi, or delimited text, gzipped or not."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if name.endswith((".smi", ".smiles")):
        return read_smi(spark, path)
    if name.endswith((".csv", ".tsv", ".txt", ".tab")):
        return read_delimited(spark, path)
    raise ValueError(f"no reader for {path}")


def with_row_ids(df: DataFrame, library: str, path: str, order: Sequence[str], id_column: str | None = None) -> DataFrame:
    """Library name, path, 1-based row number in the given order, and ids: the library's own, else made of the number."""
    from ..operators.splits import place

    numbered = df.withColumn("__key", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order]))
    rows = place(numbered, "__key", 0).withColumnRenamed("place", "row_number").drop("__key")
    own = F.trim(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) if id_column else F.lit("")
    made = F.concat_ws("__row_", F.lit(library), F.col("row_number").cast("string"))
    item = F.when(own == "", made).otherwise(own)
    return rows.withColumns({"library": F.lit(library), "path": F.lit(path), "item_id": item, "screening_compound_id": F.concat(F.lit(f"{library}__"), item, F.lit("__row_"), F.col("row_number").cast("string"))})


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table of the schema where the file is missing or has no bytes."""
    if file_size(path) in (None, 0):
        return spark.createDataFrame([], schema)
    return read_delimited(spark, path, schema)


def read_required(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    if file_size(path) is None:
        raise FileNotFoundError(path)
    df = read_library(spark, path)
    require_columns(df, columns)
    return df


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    if gone := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(gone)}")
    return df


def union_results(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """The first of the named result files that each folder under `root` has, united by column name."""
    from pyarrow import fs

    where, inside = file_system(root)
    folders: dict[str, set] = {}
    for info in where.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True)):
        if info.is_file:
            folders.setdefault(posixpath.dirname(info.path), set()).add(info.base_name)
    found = []
    for folder, files in sorted(folders.items()):
        hit = next((n for n in names if n in files), None)
        if hit:
            below = posixpath.relpath(folder, inside)
            found.append(read_delimited(spark, posixpath.join(root, "" if below == "." else below, hit)).withColumn("source_folder", F.lit(below)))
    if not found:
        raise FileNotFoundError(f"none of {', '.join(names)} under {root}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def feature_columns(df: DataFrame, prefixes: Sequence[str]) -> list[str]:
    """Names by prefix, without reading rows."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def jdbc_table(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32) -> DataFrame:
    """A database query; with a numeric column and its bounds it is read by `parts` tasks side by side."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q")
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return spark.table(name).dtypes
