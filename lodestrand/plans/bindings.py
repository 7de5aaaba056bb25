"""The test tables seen as measurements: one observation is a compound measured against a target.

Each binding is a lazy DataFrame and, for the SQL side, the same definition as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def obs(spark: SparkSession, d: str, **hints: str) -> DataFrame:
    """Observations: line items as measurements of parts (compounds) against the supplier's nation (target). `hints`: a join hint for a table."""
    li, s, n, p = (x.hint(hints[t]) if t in hints else x for t, x in ((t, table(spark, d, t)) for t in ("lineitem", "supplier", "nation", "part")))
    return (
        li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
        .select(
            F.col("l_partkey").alias("compound"), F.col("s_nationkey").alias("target"), F.col("n_name").alias("target_name"), F.col("n_regionkey").alias("family"),
            F.col("l_extendedprice").alias("ki"), (F.lit(9.0) - F.log10("l_extendedprice")).alias("pki"), F.col("p_brand").alias("scaffold"), F.col("p_type").alias("generic"),
            F.col("l_orderkey").alias("assay"), F.col("l_linenumber").alias("doc"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("model"),
            F.col("l_quantity").alias("quantity"), (F.col("p_retailprice") * F.col("l_quantity")).alias("estimate"), F.col("l_discount").alias("discount"),
        )
    )


OBS = """obs AS (SELECT l_partkey AS compound, s_nationkey AS target, n_name AS target_name, n_regionkey AS family, l_extendedprice AS ki, 9.0 - log10(l_extendedprice) AS pki,
 p_brand AS scaffold, p_type AS generic, l_orderkey AS assay, l_linenumber AS doc, l_returnflag AS source, l_linestatus AS model, l_quantity AS quantity, p_retailprice * l_quantity AS estimate, l_discount AS discount
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""


def fact(spark: SparkSession, d: str) -> DataFrame:
    """One row per (compound, target): median values and support."""
    from ..operators.measures import aggregate_duplicates

    o = obs(spark, d)
    f = aggregate_duplicates(o, ["compound", "target"], "ki", "pki", {"n_assays": "assay"})
    return f.select("compound", "target", F.col("median_ki").alias("ki"), F.col("median_pki").alias("pki"), F.col("n_records").alias("n"), "n_assays")


FACT = OBS + """, fact AS (SELECT compound, target, median(ki) AS ki, median(pki) AS pki, count(*) AS n, count(DISTINCT assay) AS n_assays FROM obs GROUP BY 1, 2)"""


def predictions(spark: SparkSession, d: str, **hints: str) -> DataFrame:
    """Observed and predicted values by model family, model and fold."""
    fam = F.create_map(*[F.lit(x) for x in ("A", "classical", "N", "deep", "R", "causal")])
    fold = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("assay").cast("string"), F.col("doc").cast("string"))), 1, 4), 16, 10).cast("int") % 5
    return obs(spark, d, **hints).select(
        fam[F.col("source")].alias("family_name"), F.col("model"), fold.alias("fold"), "compound", "target", "family", "scaffold", "generic",
        F.log10("ki").alias("observed"), F.log10("estimate").alias("predicted"), (F.col("quantity") > 25).cast("int").alias("positive"),
        (F.col("ki") / 100000).alias("chance"), (F.col("discount") > 0.05).cast("int").alias("cliff"),
    )


PREDICTIONS = OBS + """, predictions AS (SELECT CASE source WHEN 'A' THEN 'classical' WHEN 'N' THEN 'deep' WHEN 'R' THEN 'causal' END AS family_name, model,
 CAST(('0x' || md5(concat_ws('|', CAST(assay AS VARCHAR), CAST(doc AS VARCHAR)))[1:4]) AS INTEGER) % 5 AS fold, compound, target, family, scaffold, generic,
 log10(ki) AS observed, log10(estimate) AS predicted, CAST(quantity > 25 AS INTEGER) AS positive, ki / 100000 AS chance, CAST(discount > 0.05 AS INTEGER) AS cliff FROM obs)"""
