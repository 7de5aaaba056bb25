"""Problem 6: texts into containers of fixed token capacity, by optimal length buckets."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace

TOKENIZER_DIR = "/opt/tokenizers"
_encoders: dict = {}


def encoder(path: str):
    """A byte-level BPE encoder from a rank file, once for each worker process."""
    if path not in _encoders:
        import tiktoken

        # Fixed value: the published splitting pattern of this vocabulary.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none."""
    path = os.path.join(tokenizer_dir, name)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            e = encoder(path)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens int")


def bucket_bounds(histogram: np.ndarray, capacity: int, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` length ranges with the least unused space, by dynamic programming.

    `histogram[n]` counts the items of n tokens. In a bucket that ends at b a container holds capacity // b items at
    least, so each of its items is charged capacity / (capacity // b) tokens; what it doesn't fill is padding.
    """
    lengths = np.flatnonzero(histogram[1:]) + 1
    if not len(lengths):
        return []
    n = np.concatenate([[0.0], np.cumsum(histogram[lengths])])
    charge = capacity / (capacity // lengths)
    best = np.full(len(lengths) + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, len(lengths))):
        new, came = np.full(len(best), np.inf), np.zeros(len(best), int)
        for j in range(1, len(best)):
            cost = best[:j] + (n[j] - n[:j]) * charge[j - 1]
            came[j] = int(np.argmin(cost))
            new[j] = cost[came[j]]
        better = new < best - 1e-9
        back.append((came, better))
        best = np.where(better, new, best)
    ends, j = [], len(lengths)
    for came, better in reversed(back):
        if j and better[j]:
            ends.append(int(lengths[j - 1]))
            j = came[j]
    return sorted(ends)


def plan_containers(histogram: np.ndarray, bounds: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Kinds of containers as (kind, bucket, containers, length, items of it in each container), from the counts alone.

    Token-budget batches form inside a bucket, from the longest bucket down: a container takes the bucket's items from the
    longest on as they come, until the next one does not fit. What room is left is topped up from the buckets below, each time
    with the longest item that fits. As many equal containers are planned at once as the counts allow, so the
    plan has a few kinds for each length, however many items there are.
    """
    left = histogram.astype(np.int64).copy()
    kinds: list[tuple[int, int, int, int, int]] = []
    kind = 0
    for bucket, top in reversed(list(enumerate(sorted(bounds)))):
        low = sorted(bounds)[bucket - 1] if bucket else 0
        while left[low + 1 : top + 1].any():
            room, take = capacity, {}
            for lo, hi, whole in ((low, top, True), (0, low, False)):
                while room > 0:
                    free = np.flatnonzero(left[lo + 1 : (hi if whole else min(hi, room)) + 1]) + lo + 1
                    n = next((int(n) for n in free[::-1] if left[n] > take.get(int(n), 0)), 0)
                    if not n or n > room:
                        break
                    # Few of many equal ones at a time would make a plan row of each; as many as fit is what comes out.
                    most = min(room // n, int(left[n]) - take.get(n, 0))
                    take[n] = take.get(n, 0) + most
                    room -= most * n
            times = min(int(left[n]) // k for n, k in take.items())
            for n, k in take.items():
                kinds.append((kind, bucket, times, n, k))
                left[n] -= times * k
            kind += 1
    return kinds


def pack(documents: DataFrame, capacity: int = 2048, buckets: int = 16, tokenizer_dir: str = TOKENIZER_DIR, chunk_rows: int = 50_000, workspace: Workspace | None = None) -> DataFrame:
    """(container_id, bucket, doc_id, part, first_token, n_tokens): every document with tokens, whole in one container of
    at most `capacity` tokens; a longer one is cut into full containers and a rest that is packed like the other items. `bucket`
    is the length bucket in which the container's batch was formed.

    Documents without tokens (null or empty text) take no space and do not come out; an empty table gives no rows;
    repeated rows are items of their own. Only the histogram, with `capacity` counts, goes to the driver. Container numbers
    follow from an item's place among the items of its length, which is its chunk's offset and its place in the chunk;
    chunks are hashes of the id and grow in number with the rows, so no task ever orders more than a chunk.
    """
    spark = documents.sparkSession
    ws = workspace or Workspace(spark, "pack")
    counts = ws.cut(token_counts(documents, tokenizer_dir), "counts")
    part = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")))
    cut = counts.where("n_tokens > 0").withColumn("part", part).withColumn("first_token", F.col("part") * capacity)
    rows = counts.count()
    chunks = max(1, -(-rows // chunk_rows))
    item = cut.select("doc_id", "part", "first_token", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity)).alias("length"), F.pmod(F.xxhash64("doc_id", "n_tokens", "part"), F.lit(chunks)).cast("int").alias("chunk"))
    per_chunk = ws.cut(item.groupBy("length", "chunk").agg(F.count("*").alias("n")), "per-chunk")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    bounds = bucket_bounds(histogram, capacity, buckets)
    kinds = plan_containers(histogram, bounds, capacity)
    first, at = {}, 0
    used: dict[int, int] = {}
    plan = []
    for kind, bucket, times, n, k in kinds:
        if kind not in first:
            first[kind], at = at, at + times
        start = used.get(n, 0)
        used[n] = start + times * k
        plan.append((n, start, used[n], first[kind], k, bucket))
    # One row for each length, with its ranges of places in ascending order: at most `capacity` rows.
    by_length: dict[int, list] = {}
    for n, *ranges in plan:
        by_length.setdefault(n, []).append(ranges)
    table = spark.createDataFrame(
        [(n, *([r[i] for r in rs] for i in range(5))) for n, rs in by_length.items()],
        "length int, starts array<long>, ends array<long>, firsts array<long>, each array<int>, buckets array<int>",
    )
    offset = per_chunk.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).select("length", "chunk", "before")
    inside = F.row_number().over(W.partitionBy("chunk", "length").orderBy("doc_id", "first_token")) - 1
    placed = item.withColumn("inside", inside).join(offset, ["length", "chunk"]).withColumn("place", F.col("before") + F.col("inside")).join(F.broadcast(table), "length")
    i = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    placed = placed.withColumn("i", i).withColumn("container_id", F.get("firsts", F.col("i")) + ((F.col("place") - F.get("starts", F.col("i"))) / F.get("each", F.col("i"))).cast("long"))
    return placed.select("container_id", F.get("buckets", F.col("i")).alias("bucket"), "doc_id", "part", "first_token", F.col("length").alias("n_tokens"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Per bucket: containers, items, tokens and the share of the space that is used."""
    each = packed.groupBy("container_id", "bucket").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return each.groupBy("bucket").agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("fullest"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"),
    )


def packing_errors(packed: DataFrame, documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: the documents with text, those packed, containers above the capacity, and documents that lie in several
    containers though one would hold them."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    docs = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count_distinct("container_id").alias("n"))
    return (
        documents.agg(F.count_if(F.col("text") != "").alias("n_texts"))
        .join(each.agg(F.count_if(F.col("tokens") > capacity).alias("n_overfull")))
        .join(docs.agg(F.count("*").alias("n_packed"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= capacity)).alias("n_torn")))
    )
