"""Regression metrics over several groupings of the same rows, without a copy of the rows for each of them."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace
from .metrics import regression_metrics

#: Ranges of each value, groups times ranges that a task counts, and rows of one value that it holds in memory.
RANGES, MOST, HELD = 256, 2_000_000, 500_000
MOMENTS = ("ee", "ae", "y", "p")
SQUARES = ("yy", "pp", "yp")


def long_form(df: DataFrame, by: Sequence[str], groupings: Mapping[str, str], y: str, p: str) -> DataFrame:
    """`df` with a row for each grouping, its name in `group_type` and the value, as text, in `group_value`."""
    g = F.explode(F.array(*[F.struct(F.lit(n).alias("group_type"), F.col(c).cast("string").alias("group_value")) for n, c in groupings.items()]))
    return df.select(*by, y, p, g.alias("g")).select(*by, y, p, "g.*")


class Cells:
    """The numbers of a row's groups, packed into one: `tops` values of the common keys, and `sizes` values of each grouping."""

    def __init__(self, tops: int, sizes: Sequence[int]):
        self.tops, self.sizes = tops, list(sizes)
        self.starts = [tops * x for x in np.cumsum([0, *sizes]).tolist()]
        self.n = self.starts.pop()

    def groups(self, cell: np.ndarray) -> list[np.ndarray]:
        """The row's group in each grouping, counted from 0 in each."""
        codes = []
        for size in reversed(self.sizes):
            cell, code = np.divmod(cell, size)
            codes.append(code)
        return [(cell * size + code).astype(np.uint16 if self.tops * size <= 65536 else np.int64) for size, code in zip(self.sizes, reversed(codes), strict=True)]


def _range_of(cuts: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.searchsorted(cuts, v, side="left").astype(np.int32)


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _twice_ranks(v: np.ndarray, g: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Twice the average rank in its group of each of the values, which are sorted; `before` counts a group's values up to here and goes on."""
    order = np.argsort(g, kind="stable")
    a, b = g[order], v[order]
    at = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1))
    many, ties = np.bincount(g, minlength=len(before)), np.diff(np.append(at, len(v)))
    who = a[at]
    out = np.empty(len(v), np.int64)
    out[order] = np.repeat(2 * (before[who] + at - (np.cumsum(many) - many)[who]) + ties + 1, ties)
    before += many
    return out


def ranked(batches: Iterator[pa.RecordBatch], value: str, cells: Cells, cuts: np.ndarray, starts: np.ndarray, held: int = HELD) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Of batches sorted by `value`, holding whole ranges: (rows, each grouping's groups, twice the average rank in each).

    `starts`: a range's and group's values in ranges before. The rows of a value wait for its last one, beyond `held` of them in a file."""
    spans = [slice(s, s + cells.tops * n) for s, n in zip(cells.starts, cells.sizes, strict=True)]
    now, before = -1, np.zeros(cells.n, np.int64)

    def enter(k: int) -> None:
        nonlocal now
        if k != now:
            now = k
            before[:] = starts[k]

    def whole(rows: pa.RecordBatch):
        """Rows with all ties of their values."""
        v = _array(rows, value)
        k = _range_of(cuts, v)
        for part in np.split(np.arange(len(v)), np.flatnonzero(k[1:] != k[:-1]) + 1):
            lo, n = int(part[0]), len(part)
            enter(int(k[lo]))
            piece = rows.slice(lo, n)
            g = cells.groups(_array(piece, "cell"))
            yield piece, g, [_twice_ranks(v[lo : lo + n], x, before[s]) for x, s in zip(g, spans, strict=True)]

    def long_run(file, schema: pa.Schema, many: np.ndarray):
        """The rows of one value, from the file."""
        file.seek(0)
        with pa.ipc.open_stream(file) as stored:
            for i, rows in enumerate(stored):
                if not i:
                    enter(int(_range_of(cuts, _array(rows, value)[:1])[0]))
                g = cells.groups(_array(rows, "cell"))
                yield rows, g, [2 * before[s][x] + many[s][x] + 1 for x, s in zip(g, spans, strict=True)]
        before[:] += many

    run: list[pa.RecordBatch] = []
    size, last, file, sink, many = 0, None, None, None, np.zeros(cells.n, np.int64)

    def end():
        nonlocal run, size, file, sink
        if file is not None:
            store()
            sink.close()
            yield from long_run(file, sink_schema, many)
            file.close()
            file = sink = None
            many[:] = 0
        run, size = [], 0

    def store():
        nonlocal run, size
        for rows in run:
            sink.write_batch(rows)
            for x, s in zip(cells.groups(_array(rows, "cell")), spans, strict=True):
                many[s] += np.bincount(x, minlength=s.stop - s.start)
        run, size = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        v = _array(batch, value)
        first = 0
        if run or file is not None:  # the value goes on for `first` rows
            first = len(v) if v[-1] == last else int(np.searchsorted(v, last, side="right"))
            if first:
                run.append(batch.slice(0, first))
                size += first
        if first < len(v):
            if file is not None:
                yield from end()
            tail = int(np.searchsorted(v, v[-1], side="left"))
            done = [*run, *([batch.slice(first, tail - first)] if tail > first else [])]
            if done:
                yield from whole(pa.Table.from_batches(done).combine_chunks().to_batches()[0])
            run, size, last = [batch.slice(max(tail, first))], len(v) - max(tail, first), v[-1]
        if size > held:
            if file is None:
                file, sink_schema = tempfile.TemporaryFile(), batch.schema
                sink = pa.ipc.new_stream(file, sink_schema)
            store()
    if file is not None:
        yield from end()
    elif run:
        yield from whole(pa.Table.from_batches(run).combine_chunks().to_batches()[0])


def regression_metrics_each(df: DataFrame, by: Sequence[str], groupings: Mapping[str, str], y: str = "observed", p: str = "predicted", workspace: Workspace | None = None, ranges: int = RANGES, most: int = MOST, held: int = HELD) -> DataFrame:
    """`regression_metrics` by `by`, `group_type` and `group_value` for each of the groupings (name: column), which all have `by` in common.

    A row goes once through a shuffle by the range of either value, and takes its ranks in all its groupings with it: a task
    sees the rows of a range in order and knows each group's number of values in the ranges before. Medians are searched in the
    range that holds them. Groups are numbered for that; where they are so many that groups times ranges exceed `most`, the
    rows are copied for each grouping and go through `regression_metrics`, with the same result."""
    spark = df.sparkSession
    ws = workspace or Workspace(spark, "groupings")
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    names = [f"__g{i}" for i in range(len(groupings))]
    rows = ws.cut(rows.select(*by, *[F.col(c).cast("string").alias(n) for n, c in zip(names, groupings.values(), strict=True)], F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")), "rows")
    ws.release()
    tops = rows.select(*by).distinct().limit(most + 1).toArrow()
    sets = [rows.select(n).distinct().limit(most + 1).toArrow().column(0).combine_chunks() for n in names]
    cells = Cells(tops.num_rows, [len(s) for s in sets])
    if not tops.num_rows or cells.n * 2 * ranges > most or cells.tops * math.prod(cells.sizes) >= 2**62:
        back = rows.withColumnsRenamed({"y": y, "p": p})
        return regression_metrics(long_form(back, by, dict(zip(groupings, names, strict=True)), y, p), [*by, "group_type", "group_value"], y, p)

    # A cell's number is read digit by digit; the tables of them are small here.
    coded, cell = rows, F.col("__c0").cast("long")
    tables = [(by, tops.to_pylist()), *[([n], [{n: v} for v in u.to_pylist()]) for n, u in zip(names, sets, strict=True)]]
    for i, (columns, values) in enumerate(tables):
        kinds = ", ".join(f"v{j} {rows.schema[c].dataType.simpleString()}" for j, c in enumerate(columns))
        numbers = spark.createDataFrame([(*v.values(), k) for k, v in enumerate(values)], f"{kinds}, __c{i} int")
        on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"v{j}")) for j, c in enumerate(columns)])
        coded = coded.join(F.broadcast(numbers), on).drop(*[f"v{j}" for j in range(len(columns))])
        cell = cell * F.lit(len(values)) + F.col(f"__c{i}") if i else cell
    data = ws.cut(coded.select(cell.alias("cell"), "y", "p"), "cells")
    ws.drop("rows")
    ws.release()

    # Any cuts give the same result; these make ranges of about equal size.
    error = F.abs(F.col("y") - F.col("p"))
    at = [i / ranges for i in range(1, ranges)]
    fine = [i / (2 * ranges) for i in range(1, 2 * ranges)]
    q = data.agg(*[F.percentile_approx(c, F.lit(x), 2 * ranges).alias(n) for n, c, x in (("y", F.col("y"), at), ("p", F.col("p"), at), ("e", error, fine))]).first()
    cy, cp, ce = (np.unique(np.array(q[n], float)) for n in ("y", "p", "e"))
    y0, p0 = float(cy[len(cy) // 2]), float(cp[len(cp) // 2])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = {"y": cy, "p": cp, "e": ce}
        sums, ends = np.zeros((len(MOMENTS), cells.n)), np.tile(np.array([[np.inf], [-np.inf], [np.inf], [-np.inf]]), cells.n)
        counts = {k: np.zeros((cells.n, len(c) + 1), np.int64) for k, c in cuts.items()}
        for b in batches:
            v, w = _array(b, "y"), _array(b, "p")
            e = np.abs(v - w)
            terms = (e * e, e, v - y0, w - p0)
            at = {k: _range_of(c, x) for (k, c), x in zip(cuts.items(), (v, w, e), strict=True)}
            for g, start, size in zip(cells.groups(_array(b, "cell")), cells.starts, cells.sizes, strict=True):
                s, g = slice(start, start + cells.tops * size), g.astype(np.int64)
                for k, x in at.items():
                    wide = len(cuts[k]) + 1
                    counts[k][s] += np.bincount(g * wide + x, minlength=cells.tops * size * wide).reshape(-1, wide)
                for row, x in zip(sums, terms, strict=True):
                    row[s] += np.bincount(g, weights=x, minlength=cells.tops * size)
                for row, x, least in zip(ends, (v, v, w, w), (True, False, True, False), strict=True):
                    (np.minimum if least else np.maximum).at(row[s], g, x)
        for k, c in counts.items():
            g, at = np.nonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g), pa.array(at), pa.array(c[g, at]), *[pa.nulls(len(g), pa.float64())] * 8], names=partial)
        g = np.flatnonzero(counts["y"].sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(["m"] * len(g), pa.string()), pa.array(g), pa.array(np.zeros(len(g), np.int64)), pa.array(np.zeros(len(g), np.int64)), *[pa.array(x[g]) for x in (*sums, *ends)]], names=partial)

    least = ("y_min", "y_max", "p_min", "p_max")
    partial = ["kind", "g", "at", "n", *MOMENTS, *least]
    schema = "kind string, g long, at long, n long, " + ", ".join(f"{c} double" for c in (*MOMENTS, *least))
    got = data.mapInArrow(count, schema).groupBy("kind", "g", "at").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in MOMENTS], *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in least]).toArrow()
    counts = {}
    for k, c in (("y", cy), ("p", cp), ("e", ce)):
        one = got.filter(pc.equal(got["kind"], k))
        counts[k] = np.zeros((cells.n, len(c) + 1), np.int64)
        counts[k][one["g"].to_numpy(), one["at"].to_numpy()] = one["n"].to_numpy()
    moments = {r["g"]: r for r in got.filter(pc.equal(got["kind"], "m")).to_pylist()}
    many = counts["y"].sum(axis=1)
    means = np.zeros((2, cells.n))
    for g, m in moments.items():
        means[:, g] = y0 + m["y"] / many[g], p0 + m["p"] / many[g]
    starts = {k: np.ascontiguousarray((np.cumsum(c, axis=1) - c).T) for k, c in counts.items()}

    ranks = [f"r{i}" for i in range(len(names))]

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_range_of(cy, _array(b, "y")))], names=["cell", "y", "p", "at"])

    def first_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, r in ranked(batches, "y", cells, cy, starts["y"], held):
            yield pa.RecordBatch.from_arrays([b.column("cell"), b.column("p"), pa.array(_range_of(cp, _array(b, "p"))), *map(pa.array, r)], names=["cell", "p", "at", *ranks])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, cells.n))
        for b, g, r in ranked(batches, "p", cells, cp, starts["p"], held):
            for name, x, z, start, size in zip(ranks, g, r, cells.starts, cells.sizes, strict=True):
                s = slice(start, start + cells.tops * size)
                middle = many[s][x] + 1
                u, w = (_array(b, name) - middle).astype(float), (z - middle).astype(float)
                for row, t in zip(sums, (u * w, u * u, w * w), strict=True):
                    row[s] += np.bincount(x, weights=t, minlength=cells.tops * size)
        g = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(g), *[pa.array(x[g]) for x in sums]], names=["g", "uw", "uu", "ww"])

    ws.release()
    # Numbers of partitions are given, else few are made of what is small when compressed.
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = data.mapInArrow(by_range, "cell long, y double, p double, at int").repartition(wide, "at").drop("at").sortWithinPartitions("y")
    x = x.mapInArrow(first_ranks, "cell long, p double, at int, " + ", ".join(f"{r} long" for r in ranks)).repartition(wide, "at").drop("at").sortWithinPartitions("p")
    spearman = {r["g"]: r for r in x.mapInArrow(products, "g long, uw double, uu double, ww double").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("uw", "uu", "ww")]).collect()}
    ws.release()

    # The two middle places of a group, the ranges that hold them, and how many values lie before.
    lower, upper = (many + 1) // 2, many // 2 + 1
    upto = np.cumsum(counts["e"], axis=1)
    low, high = ((upto >= m[:, None]).argmax(axis=1) for m in (lower, upper))

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Errors in these ranges; and, without an error, the sums of squares and products around a group's means."""
        sums = np.zeros((3, cells.n))
        for b in batches:
            v, w = _array(b, "y"), _array(b, "p")
            e = np.abs(v - w)
            at = _range_of(ce, e)
            for g, start in zip(cells.groups(_array(b, "cell")), cells.starts, strict=True):
                g = g.astype(np.int64) + start
                a, c = v - means[0][g], w - means[1][g]
                for row, t in zip(sums, (a * a, c * c, a * c), strict=True):
                    row += np.bincount(g, weights=t, minlength=cells.n)
                hit = np.flatnonzero((at == low[g]) | (at == high[g]))
                yield pa.RecordBatch.from_arrays([pa.array(g[hit]), pa.array(e[hit]), *[pa.nulls(len(hit), pa.float64())] * 3], names=["g", "e", *SQUARES])
        g = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.float64()), *[pa.array(x[g]) for x in sums]], names=["g", "e", *SQUARES])

    near = data.mapInArrow(middle, "g long, e double, " + ", ".join(f"{c} double" for c in SQUARES)).groupBy("g", "e").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SQUARES])
    near = ws.cut(near, "near")
    squares = {r["g"]: r for r in near.where("e IS NULL").collect()}
    near = near.where("e IS NOT NULL").select("g", "e", "n")
    there = np.flatnonzero(many)
    places = spark.createDataFrame([(int(g), int(starts["e"][low[g], g]), int(lower[g]), int(upper[g])) for g in there], "g long, before long, lower long, upper long")
    near = near.join(places, "g").withColumn("upto", F.col("before") + F.sum("n").over(W.partitionBy("g").orderBy("e").rowsBetween(W.unboundedPreceding, 0)))
    hit = near.where("upto >= lower AND upto - n < upper")
    median = dict(hit.groupBy("g").agg(F.avg("e").alias("m")).collect())
    ws.drop("cells")
    ws.drop("near")

    top_rows = tops.to_pylist()
    out = []
    for kind, values_of, start, size in zip(groupings, sets, cells.starts, cells.sizes, strict=True):
        texts = values_of.to_pylist()
        for g in range(start, start + cells.tops * size):
            if many[g]:
                top, code = divmod(g - start, size)
                out.append((*top_rows[top].values(), kind, texts[code], *_metrics(int(many[g]), moments[g], squares.get(g), spearman.get(g), median[g])))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return spark.createDataFrame(out, f"{fields}, group_type string, group_value string, n long, rmse double, mae double, median_ae double, r2 double, pearson double, spearman double")


def _metrics(n: int, m: Mapping, q: Mapping | None, s: Mapping | None, median: float) -> tuple:
    """(n, rmse, mae, median_ae, r2, pearson, spearman) of a group's sums."""
    yy, pp, yp = (q[c] for c in SQUARES) if q else (0.0, 0.0, 0.0)
    differ = m["y_min"] < m["y_max"]
    both = n > 1 and differ and m["p_min"] < m["p_max"]
    over = lambda a, b: a / b if b else None
    r2 = 1 - m["ee"] / yy if differ and yy else None
    pearson = over(yp, math.sqrt(yy) * math.sqrt(pp)) if both else None
    return n, math.sqrt(m["ee"] / n), m["ae"] / n, median, r2, pearson, over(s["uw"], math.sqrt(s["uu"]) * math.sqrt(s["ww"])) if both and s else None
