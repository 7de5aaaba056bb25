"""Writers: tables, partitioned predictions, reports, manifests, checksums and archives."""

from __future__ import annotations

import datetime
import json
import math
import os
import posixpath
import tarfile
import zipfile
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .readers import file_system


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite", single: bool = False) -> None:
    """`single` writes one file, for small tables that people open."""
    w = (df.coalesce(1) if single else df).write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def rounded_numbers(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded half to even."""
    return df.select(*[F.bround(f"`{c}`", digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def preview(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def plain(value: Any) -> Any:
    """For JSON: NaN and infinities are null, rows are objects, dates are text."""
    if isinstance(value, Row):
        return plain(value.asDict(recursive=True))
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        return plain(value.item())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def write_json(payload: Any, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(payload), f, indent=2, sort_keys=True)


def read_json(path: str) -> dict:
    """Empty where the file is missing or not an object."""
    try:
        with open(path, encoding="utf-8") as f:
            out = json.load(f)
    except (OSError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of the files under `root`, hashed by tasks that read them in blocks, so that no file has to fit into
    memory. The listing is made on the driver; the folder must be one that all nodes see."""
    from pyarrow import fs

    where, inside = file_system(root)
    found = [(posixpath.relpath(x.path, inside), x.path, x.size) for x in where.get_file_info(fs.FileSelector(inside, recursive=True)) if x.is_file]
    tasks = max(1, min(len(found), spark.sparkContext.defaultParallelism * 4))

    def run(batches):
        import hashlib

        there, _ = file_system(root)
        for pdf in batches:
            sums = []
            for path in pdf["full"]:
                h = hashlib.sha256()
                with there.open_input_stream(path, compression=None) as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pdf.assign(sha256=sums)[["path", "size", "sha256"]]

    files = spark.createDataFrame(found, "path string, full string, size long").repartition(tasks)
    return files.mapInPandas(run, "path string, size long, sha256 string").orderBy("path")


def write_checksums(listing: DataFrame, path: str) -> None:
    listing.select(F.concat_ws("  ", "sha256", "path")).coalesce(1).write.mode("overwrite").text(path)


def archive(root: str, to: str) -> str:
    """A .tar.gz or .zip of the folder, names sorted."""
    names = sorted(os.path.join(f, n) for f, _, ns in os.walk(root) for n in ns)
    if to.endswith(".zip"):
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.write(n, os.path.relpath(n, root))
    else:
        with tarfile.open(to, "w:gz") as t:
            for n in names:
                t.add(n, os.path.relpath(n, root))
    return to


def tree(root: str) -> str:
    lines = []
    for folder, dirs, files in os.walk(root):
        dirs.sort()
        depth = os.path.relpath(folder, root).count(os.sep) + (folder != root)
        lines.append("  " * depth + os.path.basename(os.path.abspath(folder)) + "/")
        lines += ["  " * (depth + 1) + n for n in sorted(files)]
    return "\n".join(lines)


def errors_table(predictions: DataFrame, observed: str, predicted: str, order: Sequence[str]) -> DataFrame:
    """Residual and absolute error, largest first."""
    e = F.col(observed) - F.col(predicted)
    return predictions.withColumns({"residual": e, "absolute_error": F.abs(e)}).orderBy(F.desc_nulls_last("absolute_error"), *order)
