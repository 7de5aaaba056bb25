"""Releases of result folders: discovery by category, copies with checksums, versions, reports."""

from __future__ import annotations

import platform
import posixpath
from collections.abc import Sequence
from importlib import metadata
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import file_system
from .sinks import manifest, plain


def by_first_part(path: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose text stands in the path, in lower case."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, name in rules:
        out = out.when(F.contains(F.lower(path), F.lit(part.lower())), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def relative_path(path: Column, root: str) -> Column:
    """The path below `root`; a path elsewhere stays whole."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def discover(spark: SparkSession, root: str, categories: Sequence[tuple[str, str]], steps: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The files under `root` with size, checksum, category and originating step, by rules that the caller states."""
    files = manifest(spark, root)
    return files.withColumns({"category": by_first_part(F.col("path"), categories, "other"), "step": by_first_part(F.col("path"), steps, "unknown")})


def copy_assets(spark: SparkSession, root: str, to: str, paths: Sequence[str] | None = None) -> DataFrame:
    """(path, size, sha256, status) of files copied from `root` to `to` by tasks; `copied` where the copy has the checksum of
    the original, else `differs`, or `missing`. Both folders must be ones that all nodes see."""
    listing = manifest(spark, root)
    if paths is not None:
        listing = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string").join(listing, "path", "left")

    def run(batches):
        import hashlib

        source, source_root = file_system(root)
        target, target_root = file_system(to)
        for pdf in batches:
            status = []
            for path, sha in zip(pdf["path"], pdf["sha256"], strict=True):
                if sha is None or sha != sha:
                    status.append("missing")
                    continue
                out = posixpath.join(target_root, path)
                target.create_dir(posixpath.dirname(out), recursive=True)
                with source.open_input_stream(posixpath.join(source_root, path), compression=None) as f, target.open_output_stream(out, compression=None) as g:
                    while block := f.read(1 << 20):
                        g.write(block)
                h = hashlib.sha256()
                with target.open_input_stream(out, compression=None) as f:
                    while block := f.read(1 << 20):
                        h.update(block)
                status.append("copied" if h.hexdigest() == sha else "differs")
            yield pdf.assign(status=status)

    return listing.mapInPandas(run, "path string, size long, sha256 string, status string")


def versions(packages: Sequence[str] = ("pyspark", "pyarrow", "pandas", "numpy", "rdkit", "scikit-learn", "torch")) -> dict[str, str]:
    """Versions of Python, the platform and packages; `not installed` where there is none."""
    out = {"python": platform.python_version(), "platform": platform.platform()}
    for p in packages:
        try:
            out[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            out[p] = "not installed"
    return out


def report(title: str, parts: dict[str, Any], most: int = 1000) -> dict:
    """A report that can be written as JSON: values as they are, tables as lists of at most `most` rows with their number,
    one-row tables as an object. What is cut off is said."""
    out: dict[str, Any] = {"title": title}
    for name, part in parts.items():
        if isinstance(part, DataFrame):
            rows = part.limit(most + 1).collect()
            out[name] = plain(rows[0]) if len(rows) == 1 else {"rows": plain(rows[:most]), "complete": len(rows) <= most}
        else:
            out[name] = plain(part)
    return out
