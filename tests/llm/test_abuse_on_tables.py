"""Scores of abusive language on labelled documents that the machine was not fitted on."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import abuse

TABLES = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.1")


@pytest.mark.skipif(not os.path.exists(f"{TABLES}/content_labels.parquet"), reason="no tables")
def test_held_out_quarter(spark):
    documents, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "content_labels"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0
    scored = abuse.score_documents(documents, labels.where(own))
    apart = labels.where(~own).where("abusive IS NOT NULL").groupBy("doc_id").agg(F.min("abusive").alias("y"), F.max("abusive").alias("y2")).where("y = y2")
    n = {(r["abusive"], r["y"]): r["count"] for r in scored.join(apart, "doc_id").groupBy("abusive", "y").count().collect()}
    hit, wrong, missed = n.get((True, 1), 0), n.get((True, 0), 0), n.get((False, 1), 0)
    # About a sixth of the documents labelled abusive hold no abuse: wrong labels.
    assert hit / (hit + wrong) >= 0.9 and hit / (hit + missed) >= 0.6
