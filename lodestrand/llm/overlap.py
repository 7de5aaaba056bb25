"""Problem 2: the same or nearly the same records across splits, by content-defined chunks and their digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, PLACEHOLDERS, present
from ..session import Workspace
from .components import contract
from .near import Texts, mixed, near_records, spread

__all__ = ["cross_split_pairs", "labelled_rows", "near_records", "overlap_fractions", "overlap_report", "structure_classes"]


def with_largest_component(df: DataFrame, smiles: str, out: str) -> DataFrame:
    """The first of the longest `.`-separated components, without blanks of any kind; null where there is none. In steps,
    so that no expression is worked out twice for a row."""
    blank = r"[\s\x1c-\x1f\x85\p{Z}]"
    longest = F.aggregate(F.split("__s", "\\."), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    df = df.withColumn("__s", F.when(F.col(smiles).rlike(blank), F.translate(smiles, BLANKS, "")).otherwise(F.col(smiles)))
    df = df.withColumn("__one", F.when(F.instr("__s", ".") > 0, longest).otherwise(F.col("__s")))
    return df.withColumn(out, F.when(F.col("__one") != "", F.col("__one"))).drop("__s", "__one")


USABLE = "row_uid IS NOT NULL AND place IS NOT NULL AND label IS NOT NULL"


def labelled_rows(splits: DataFrame) -> DataFrame:
    """(row_uid, place, label, source, compound, record) of all rows; place: task, strategy, split and fold. Rows without
    one of these four have no place, rows with another label or none no label; see USABLE. The filter is left to the
    caller, who applies it to the written rows: before them it would work out every text twice."""
    low = {c: F.lower(present(F.col(c))) for c in ("task_name", "split_strategy", "split_id", "fold_id", "split_label")}
    label = low.pop("split_label")
    label = F.when(label == "train", "train").when(label.isin("valid", "validation"), "valid").when(label == "test", "test")
    parts = [x for c in low.values() for x in (c, F.lit("\x1f"))][:-1]
    rows = splits.select(
        "row_uid", F.concat(*parts).alias("place"), label.alias("label"), F.col("source_environment").alias("source"),
        F.lower(present(F.col("compound_id"), PLACEHOLDERS)).alias("compound"), "standardized_smiles",
    )
    return with_largest_component(rows, "standardized_smiles", "record").drop("standardized_smiles")


def _digests(*of: Column) -> Column:
    """128 bits that stand for the values: equal ones are taken to be the same."""
    return F.struct(F.xxhash64(*of).alias("k1"), F.xxhash64(F.lit(7), *of).alias("k2"))


def _written(splits: DataFrame, ws: Workspace) -> DataFrame:
    rows = labelled_rows(splits).withColumn("id", F.when(F.col("record").isNotNull(), F.xxhash64("record")))
    return ws.cut(rows, "rows", compression="zstd").where(USABLE)


def _near(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Both ways of the near-equal structures (id_a, id_b) of written rows. Places are told apart by 64 buckets here, so that
    pairs may be among them that share no place; joins on the place leave them out."""
    bit = F.expr("shiftleft(1L, CAST(pmod(xxhash64(place), 64) AS INT))")
    places = [F.bit_or(F.when(F.col("label") == x, bit).otherwise(F.lit(0).cast("long")) if x else F.when(F.col("label") != "train", bit).otherwise(F.lit(0).cast("long"))).alias(c) for c, x in (("train", "train"), ("other", None))]
    records = ws.cut(rows.where("id IS NOT NULL").groupBy("id", "record").agg(*places), "records", compression="zstd")
    if not records.groupBy("id").count().where("count > 1").isEmpty():
        raise RuntimeError("two structures have the same 64-bit digest; number them with another seed")
    near = ws.cut(near_records(records, ws).select("id_a", "id_b"), "near")
    ws.drop("records")
    return near.unionByName(near.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))


def _row_pairs(rows: DataFrame, ways: DataFrame) -> DataFrame:
    """Pairs of written rows; see cross_split_pairs."""
    keys = lambda side, name: side.select(
        F.col("row_uid").alias(name), F.explode(F.array(F.when(F.col("compound").isNotNull(), _digests(F.lit("c"), "place", "compound")), F.when(F.col("id").isNotNull(), _digests(F.lit("s"), "place", "id")))).alias("k")
    ).where("k IS NOT NULL").select(name, "k.*")
    train, other = rows.where("label = 'train'"), rows.where("label <> 'train'")
    moved = other.select(F.col("row_uid").alias("other_uid"), "place", F.col("id").alias("id_a")).join(ways, "id_a").select("other_uid", _digests(F.lit("s"), F.col("place"), F.col("id_b")).alias("k")).select("other_uid", "k.*")
    return keys(train, "train_uid").join(keys(other, "other_uid").unionByName(moved), ["k1", "k2"]).select("train_uid", "other_uid").distinct()


def cross_split_pairs(splits: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(train_uid, other_uid): a training row and a valid or test row of the same task, strategy, split and fold with an
    equal compound id, or with an equal or nearly equal structure. Pairs come once, repeated rows too; missing ids and
    structures match nothing; an empty table gives no rows; other columns are ignored.

    Structures are compared once each, however many rows hold them, and rows are paired afterwards by an equi-join on
    digests of place and compound, or place and structure; adaptive execution splits the keys that hold most of the rows.
    """
    ws = workspace or Workspace(splits.sparkSession, "overlap")
    rows = _written(splits, ws)
    return _row_pairs(rows, _near(rows, ws))


def structure_classes(splits: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """(structure, class_structure, n_links, n_rows): one row for each structure of labelled rows, with the least structure of its
    class, the number of other structures that it nearly equals across the splits of a place, and its rows. A family of near-copies is one
    class, however many pairs it has. Structures are compared by their longest component, case-sensitively; rows without
    one do not take part; an empty table gives no rows."""
    ws = workspace or Workspace(splits.sparkSession, "classes")
    rows = _written(splits, ws).where("id IS NOT NULL")
    held = rows.groupBy("id").agg(F.min("record").alias("structure"), F.count("*").alias("n_rows"))
    at = lambda cond, name: rows.where(cond).select("place", F.col("id").alias(name)).distinct()
    met = at("label = 'train'", "id_a").join(_near(rows, ws), "id_a").join(at("label <> 'train'", "id_b"), ["place", "id_b"])
    links = ws.cut(met.select(F.least("id_a", "id_b").alias("u"), F.greatest("id_a", "id_b").alias("v")).distinct(), "links")
    counts = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    out = ws.cut(held.join(counts, "id", "left"), "held")
    roots = contract(links, ws)
    if roots is None:
        return out.select("structure", F.col("structure").alias("class_structure"), F.lit(0).cast("long").alias("n_links"), "n_rows")
    out = out.join(roots.select(F.col("vertex").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = out.groupBy("root").agg(F.min("structure").alias("class_structure"))
    return out.join(least, "root").select("structure", "class_structure", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_rows")


def content_chunks(texts: pa.Array, divisor: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined chunks of `texts`: (text number, start, length, digest).

    A text is cut behind a character where the rolling hash of the three characters that end there falls into the lowest of
    `divisor` equal ranges; so equal stretches are cut alike wherever they stand, and edits change the chunks they touch.
    """
    t = Texts.of(texts)
    total = len(t.codes)
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    c = t.codes.astype(np.int64)
    rolled = np.zeros(total, np.int64)
    rolled[2:] = (((c[:-2] * 31 + c[1:-1]) * 31 + c[2:]) * 40503) % 65536
    cut = rolled * divisor < 65536
    full = t.begin[t.size > 0]
    for k in (0, 1):
        cut[np.minimum(full + k, total - 1)] = False
    cut[(t.begin + t.size)[t.size > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(t.size)), np.diff(np.searchsorted(starts, np.concatenate([t.begin, [total]]))))
    # Digests of whole chunks, from sums of characters times powers of the base, which roll from chunk to chunk.
    length = ends - starts
    owner, i = spread(length)
    power = np.cumprod(np.full(int(length.max()), 0x100000001B3, np.uint64))
    value = np.add.reduceat((c + 7).astype(np.uint64) * power[i], starts)
    return text, starts - t.begin[text], length, mixed(value ^ length.astype(np.uint64)).view(np.int64)


def overlap_fractions(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(id_a, id_b, overlap) of `pairs` (id_a, id_b): the share of b's characters that lie in chunks which a has too. Chunks
    of `records` (id, record) are cut by content, joined by digest, and their lengths summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _, length, digest = content_chunks(batch.column("record"))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text)), pa.array(digest), pa.array(length)], names=["id", "digest", "n"])

    needed = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    chunks = records.join(needed, "id", "left_semi").select("id", "record").mapInArrow(run, "id long, digest long, n long").groupBy("id", "digest").agg(F.sum("n").alias("n"))
    whole = chunks.groupBy("id").agg(F.sum("n").alias("whole"))
    a, b = chunks.select(F.col("id").alias("id_a"), "digest"), chunks.select(F.col("id").alias("id_b"), "digest", "n")
    shared = pairs.join(a, "id_a").join(b, ["id_b", "digest"]).groupBy("id_a", "id_b").agg(F.sum("n").alias("n"))
    return shared.join(whole.withColumnRenamed("id", "id_b"), "id_b").select("id_a", "id_b", (F.col("n") / F.col("whole")).alias("overlap"))


def overlap_report(splits: DataFrame, workspace: Workspace | None = None) -> DataFrame:
    """For each place, label and source: the rows, those that repeat a training row, and how much of their structures is
    overlapped: the mean over these rows of the largest share of characters in chunks that the training structure has too.
    Rows that repeat one by compound only, and whose structures are missing or share no chunk, count as 0."""
    ws = workspace or Workspace(splits.sparkSession, "overlap")
    rows = _written(splits, ws)
    pairs = ws.cut(_row_pairs(rows, _near(rows, ws)), "pairs")
    ids = rows.select("row_uid", "id")
    known = (
        pairs.join(ids.select(F.col("row_uid").alias("train_uid"), F.col("id").alias("id_a")), "train_uid")
        .join(ids.select(F.col("row_uid").alias("other_uid"), F.col("id").alias("id_b")), "other_uid")
    )
    known = ws.cut(known.select("other_uid", "id_a", "id_b").distinct(), "known")
    structures = known.where("id_a IS NOT NULL AND id_b IS NOT NULL").select("id_a", "id_b").distinct()
    share = overlap_fractions(structures, rows.where("id IS NOT NULL").select("id", "record").distinct())
    hit = known.join(share, ["id_a", "id_b"], "left").groupBy(F.col("other_uid").alias("row_uid")).agg(F.max(F.coalesce("overlap", F.lit(0.0))).alias("overlap"))
    other = rows.where("label <> 'train'").select("row_uid", "place", "label", "source")
    return other.join(hit, "row_uid", "left").groupBy("place", "label", "source").agg(
        F.count("*").alias("n_rows"), F.count("overlap").alias("n_overlapping"), F.round(F.avg("overlap"), 6).alias("mean_overlap")
    )
