"""Problem 7: passages of evaluation texts inside training texts, by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Workspace

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits, in lower case; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def small_enough(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


class LeakIndex:
    """Postings (term, doc_id, pos) of a corpus, for the terms that occur in the items.

    `documents`: (doc_id, text); `items`: (item_id, text). Null and empty texts have no words and match nothing; repeated
    rows give the same matches once. Documents are read once and whole; each task writes its postings sorted by term, so
    that a search for few terms skips most of the stored blocks. `broadcast_terms`: the items' vocabulary and
    rare words are broadcast only where the items have up to so many words; beyond that they are joined by a shuffle.
    """

    def __init__(self, documents: DataFrame, items: DataFrame, workspace: Workspace, run: int = 12, broadcast_terms: int = 200_000):
        self.run, self.workspace = run, workspace
        spark = documents.sparkSession
        self.item_terms = workspace.cut(
            items.select("item_id", F.posexplode(words(F.col("text"))).alias("ipos", "term")).distinct(), "item-terms"
        )
        vocabulary = workspace.cut(
            self.item_terms.select("term").distinct().coalesce(1).withColumn("term_id", F.monotonically_increasing_id().cast("int")), "terms"
        )
        self.broadcast = small_enough(self.item_terms, broadcast_terms)
        side = F.broadcast(vocabulary) if self.broadcast else vocabulary
        postings = documents.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(side, "term").select("term_id", "doc_id", "pos")
        self.postings = workspace.cut(postings.sortWithinPartitions("term_id"), "postings", compression="zstd")
        counts = self.postings.groupBy("term_id").agg(F.count("*").alias("n"))
        self.terms = workspace.cut(self.item_terms.join(vocabulary, "term").join(counts, "term_id", "left").select("item_id", "ipos", "term_id", F.coalesce("n", F.lit(0)).alias("n")), "terms-counted")
        self.spark = spark

    def windows(self, k: int) -> DataFrame:
        """(item_id, first, rare): for every `run` consecutive words of an item, from word `first` on, its `k` words with
        the fewest postings as (ipos, term_id). Windows with a word the corpus lacks can't occur and are left out."""
        w = W.partitionBy("item_id").orderBy("ipos")
        around = F.collect_list(F.struct("n", "ipos", "term_id")).over(w.rowsBetween(0, self.run - 1))
        return (
            self.terms.withColumn("around", F.array_sort(around))
            .where((F.size("around") == self.run) & (F.col("around")[0]["n"] > 0))
            .select("item_id", F.col("ipos").alias("first"), F.transform(F.slice("around", 1, k), lambda x: F.struct(x["ipos"].alias("ipos"), x["term_id"].alias("term_id"))).alias("rare"))
        )

    def matches(self, rarest: int = 2) -> DataFrame:
        """(doc_id, item_id, words): the longest run of consecutive words of the item in the document, from `run` on.

        The posting lists of every window's `rarest` words, shifted by the word's place in the item, are intersected: at an
        offset where they don't all meet the window doesn't occur. For the windows that are left, the lists of all their
        words are shifted and intersected, and unbroken rows of positions are measured. Exact: a run of `run` words
        or more is a row of windows, and each holds its rarest words.
        """
        ws, r = self.workspace, self.run
        windows = ws.cut(self.windows(min(rarest, r)), "windows")
        marks = windows.select("item_id", F.explode("rare").alias("m")).select("item_id", "m.ipos", "m.term_id").distinct()
        met = self.postings.join(F.broadcast(marks) if self.broadcast else marks, "term_id").select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
        met = met.groupBy("doc_id", "item_id", "shift").agg(F.collect_list("ipos").alias("met")).where(F.size("met") >= min(rarest, r))
        wanted = windows.groupBy("item_id").agg(F.collect_list(F.struct("first", F.col("rare.ipos").alias("rare"))).alias("windows"))
        whole = F.filter("windows", lambda w: F.size(F.array_except(w["rare"], F.col("met"))) == 0)
        spots = met.join(wanted, "item_id").withColumn("whole", whole).where(F.size("whole") > 0)
        places = F.array_distinct(F.flatten(F.transform("whole", lambda w: F.sequence(w["first"], w["first"] + r - 1))))
        spots = ws.cut(spots.select("doc_id", "item_id", "shift", places.alias("places")), "spots", compression="zstd")
        ws.release()
        lists = self.postings.join(spots.select("doc_id").distinct(), "doc_id", "left_semi")
        near = spots.select("doc_id", "item_id", "shift", F.explode("places").alias("ipos")).join(self.terms.select("item_id", "ipos", "term_id"), ["item_id", "ipos"])
        hit = near.withColumn("pos", F.col("ipos") + F.col("shift")).join(lists, ["doc_id", "term_id", "pos"]).select("doc_id", "item_id", "shift", "ipos")
        line = W.partitionBy("doc_id", "item_id", "shift").orderBy("ipos")
        return (
            # Repeated documents give a place twice; its rank and the ends of the row are the same.
            hit.withColumn("line", F.col("ipos") - F.dense_rank().over(line))
            .groupBy("doc_id", "item_id", "shift", "line")
            .agg((F.max("ipos") - F.min("ipos") + 1).alias("words"))
            .where(F.col("words") >= r)
            .groupBy("doc_id", "item_id")
            .agg(F.max("words").alias("words"))
        )

    def proximity(self, rare_words: int = 6, span: int = 40) -> DataFrame:
        """(doc_id, item_id, found): documents in which at least `rare_words` of an item's ten rarest different words
        stand within `span` consecutive words, in any order."""
        ranked = self.terms.groupBy("item_id", "term_id", "n").agg(F.min("ipos").alias("ipos")).where("n > 0")
        top = ranked.withColumn("k", F.row_number().over(W.partitionBy("item_id").orderBy("n", "ipos"))).where("k <= 10").select("item_id", "term_id")
        placed = self.postings.join(F.broadcast(top) if self.broadcast else top, "term_id")
        w = W.partitionBy("doc_id", "item_id").orderBy("pos").rangeBetween(-(span - 1), 0)
        return (
            placed.withColumn("found", F.size(F.collect_set("term_id").over(w)))
            .where(F.col("found") >= rare_words)
            .groupBy("doc_id", "item_id")
            .agg(F.max("found").alias("found"))
        )
