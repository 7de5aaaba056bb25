"""Queries on quality checks, selection of models, streams seen as tables, and output assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import present
from ..operators import quality, windows
from ..session import table
from .bindings import OBS, PREDICTIONS, obs, predictions
from .facts import PRESENT
from .models import MEANS, means, rounded

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


COLS = ("molecular_weight", "clogp", "tpsa", "heavy_atom_count")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, count(DISTINCT {c}) AS n_different, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS most, round(avg({c}), 6) AS mean FROM environment_features" for c in COLS))
def reference_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.reference_summary(table(spark, d, "environment_features"), COLS).withColumn("mean", F.round("mean", 6))


@query(f"WITH e AS (SELECT {PRESENT('standardized_smiles')} AS s, source_library_name AS m FROM environment_features) SELECT s AS structure, count(DISTINCT m) AS n_values, count(*) AS n_rows FROM e GROUP BY 1 HAVING count(DISTINCT m) > 1")
def structures_in_libraries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(present(F.col("standardized_smiles")).alias("structure"), F.col("source_library_name").alias("m"))
    return quality.conflicts(e, "structure", "m")


@query(f"WITH {MEANS} SELECT family_name, model, split, rmse, CAST(row_number() OVER (PARTITION BY split ORDER BY rmse, family_name, model) AS INTEGER) AS rank, row_number() OVER (PARTITION BY split ORDER BY rmse, family_name, model) = 1 AS is_primary FROM s QUALIFY row_number() OVER (PARTITION BY split ORDER BY rmse, family_name, model) <= 3")
def selected_models(spark: SparkSession, d: str) -> DataFrame:
    """The primary model of each split and the next two."""
    t = windows.top_per_group(means(spark, d), ["split"], [F.col("rmse"), F.col("family_name"), F.col("model")], 3)
    return t.select("family_name", "model", "split", "rmse", "rank", (F.col("rank") == 1).alias("is_primary"))


@query("SELECT o_orderpriority, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS o_orderstatus_code, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3")
def binary_codes(spark: SparkSession, d: str) -> DataFrame:
    o = quality.binary_codes(table(spark, d, "orders").where("o_orderstatus <> 'P'"), "o_orderstatus")
    return o.groupBy("o_orderpriority", "o_orderstatus", "o_orderstatus_code").agg(F.count("*").alias("n"))


@query(f"WITH {OBS} SELECT source, model, count(*) AS n, round(avg(pki), 6) AS mean FROM obs WHERE source IN ('A', 'R') GROUP BY 1, 2")
def allowed_endpoints(spark: SparkSession, d: str) -> DataFrame:
    o = quality.endpoint_policy(obs(spark, d), "source", "filter", ["A", "R"])
    return rounded(o.groupBy("source", "model").agg(F.count("*").alias("n"), F.avg("pki").alias("mean")))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the windowed stream."""
    e = table(spark, d, "events")
    return rounded(e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query(f"WITH {PREDICTIONS} SELECT compound, target, " + ", ".join(f"round(min(CASE WHEN family_name = '{f}' THEN predicted END), 6) AS {f}" for f in ("classical", "deep", "causal")) + " FROM predictions GROUP BY 1, 2")
def wide_predictions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predictions(spark, d).groupBy("compound", "target").pivot("family_name", ["classical", "deep", "causal"]).agg(F.min("predicted")))


@query(f"""WITH a AS (SELECT row_uid, split_label, {PRESENT('standardized_smiles')} AS s FROM split_assignments), e AS (SELECT {PRESENT('standardized_smiles')} AS s, min(screening_compound_id) AS screening_id, count(*) AS n FROM environment_features GROUP BY 1)
SELECT row_uid, split_label AS meta_split_label, screening_id AS meta_screening_id, coalesce(n, 0) AS meta_n FROM a LEFT JOIN e USING (s)""")
def assignment_output(spark: SparkSession, d: str) -> DataFrame:
    """Assigned rows with metadata under a prefix; a structure's rows are summed up first, so nothing fans out."""
    a = table(spark, d, "split_assignments").select("row_uid", F.col("split_label").alias("meta_split_label"), present(F.col("standardized_smiles")).alias("s"))
    e = table(spark, d, "environment_features").groupBy(present(F.col("standardized_smiles")).alias("s")).agg(F.min("screening_compound_id").alias("meta_screening_id"), F.count("*").alias("meta_n"))
    return a.join(e, "s", "left").drop("s").withColumn("meta_n", F.coalesce("meta_n", F.lit(0)))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(count(*) FILTER (coalesce(length(text), 0) <> n_chars) AS BIGINT) AS n_wrong FROM documents GROUP BY CUBE (lang, source)")
def document_cube(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sizes by language and source, with all subtotals."""
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.coalesce(F.length("text"), F.lit(0)) != F.col("n_chars")).alias("n_wrong"))
