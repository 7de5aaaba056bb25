"""Queries on ranking, consensus, applicability and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, key, present
from ..operators import shortlist, windows
from ..operators.measures import known
from ..session import table
from .bindings import OBS, obs
from .facts import PRESENT
from .models import rounded

QUERIES: dict = {}
SQL: dict = {}
NUM = lambda c: f"CASE WHEN NOT isnan({c}) THEN {c} END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# A mean whose sum does not depend on the order of the rows: decimal, with more digits than scores carry.
MEAN = "CAST(sum(CAST(score AS DECIMAL(18,9))) AS DOUBLE) / count(score)"


def mean_of(c: str) -> Column:
    return F.try_divide(F.sum(F.col(c).cast("decimal(18,9)")).cast("double"), F.count(c))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One row per (target, compound): the latest score, and its parts."""
    r = table(spark, d, "compound_target_ranking").select(
        key(F.col("target_chembl_id")).alias("target"), F.col("screening_compound_id").alias("compound"), known("final_strategic_score").alias("score"),
        known("potency_component_raw").alias("potency"), known("selectivity_component_raw").alias("selectivity"), known("uncertainty_component_raw").alias("uncertainty"), "scored_at",
    ).where("target IS NOT NULL AND compound IS NOT NULL")
    return r.groupBy("target", "compound").agg(F.max("score").alias("score"), F.max("potency").alias("potency"), F.max("selectivity").alias("selectivity"), F.min("uncertainty").alias("uncertainty"), F.count("*").alias("n_rows"))


SCORED = f"""scored AS (SELECT upper({PRESENT('target_chembl_id', True)}) AS target, screening_compound_id AS compound, max({NUM('final_strategic_score')}) AS score, max({NUM('potency_component_raw')}) AS potency, max({NUM('selectivity_component_raw')}) AS selectivity,
 min({NUM('uncertainty_component_raw')}) AS uncertainty, count(*) AS n_rows FROM compound_target_ranking WHERE {PRESENT('target_chembl_id', True)} IS NOT NULL AND screening_compound_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"""WITH {SCORED} SELECT target, compound, CAST(row_number() OVER (PARTITION BY target ORDER BY score DESC NULLS LAST, potency DESC NULLS LAST, compound) AS INTEGER) AS rank_in_target,
round(CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY target, score IS NULL ORDER BY score, compound) / count(score) OVER (PARTITION BY target) END, 6) AS percent_rank,
round(CASE WHEN score IS NOT NULL THEN CASE WHEN count(score) OVER (PARTITION BY target) = 1 THEN 1 ELSE (rank() OVER (PARTITION BY target, score IS NULL ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0 - 1) / (count(score) OVER (PARTITION BY target) - 1) END END, 6) AS normalized FROM scored""")
def target_rankings(spark: SparkSession, d: str) -> DataFrame:
    s = windows.with_place(scored(spark, d), "score", [F.col("compound")], "place", "n", ["target"])
    s = windows.with_rank_normalized(s, "score", "normalized", ["target"])
    order = [F.col("score").desc_nulls_last(), F.col("potency").desc_nulls_last(), F.col("compound")]
    return rounded(s.select("target", "compound", windows.row_rank(order, ["target"]).alias("rank_in_target"), (F.col("place") / F.col("n")).alias("percent_rank"), "normalized"))


@query(f"""WITH {SCORED}, g AS (SELECT target, count(*) AS n, max(score) AS best, median(score) AS median, {MEAN} AS mean FROM scored GROUP BY 1), q AS (SELECT *, row_number() OVER (ORDER BY n DESC, target) AS i, count(*) OVER () AS m FROM g)
SELECT target, n, round(best, 6) AS best, round(median, 6) AS median, round(mean, 6) AS mean, CAST(greatest(ceil(5.0 * (i - 1) / (m - 1)) - 1, 0) AS INTEGER) AS size_bin FROM q""")
def target_profile(spark: SparkSession, d: str) -> DataFrame:
    """Targets with their size bin; the window runs over targets, not rows."""
    s = scored(spark, d)
    g = s.groupBy("target").agg(F.count("*").alias("n"), F.max("score").alias("best"), mean_of("score").alias("mean"))
    g = windows.joined(g, windows.medians(s, "score", "median", ["target"]), ["target"]).select("target", "n", "best", "median", "mean")
    b = windows.quantile_bin(windows.row_rank([F.col("n").desc(), F.col("target")]), F.count("*").over(W.partitionBy()))
    return rounded(g.withColumn("size_bin", b))


@query(f"""WITH {SCORED}, b AS (SELECT compound, count(*) AS n_targets, round(max(score), 6) AS best, round({MEAN}, 6) AS mean FROM scored GROUP BY 1), t AS (SELECT compound, target AS best_target FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY compound ORDER BY score DESC, target) = 1)
SELECT compound, n_targets, best, mean, best_target FROM b LEFT JOIN t USING (compound)""")
def compound_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per compound its best target; equal scores go to the lesser name."""
    s = scored(spark, d)
    top = s.where("score IS NOT NULL").groupBy("compound").agg(F.max("score").alias("m"))
    best = s.join(top, "compound").where("score = m").groupBy("compound").agg(F.min("target").alias("best_target"))
    return rounded(s.groupBy("compound").agg(F.count("*").alias("n_targets"), F.max("score").alias("best"), mean_of("score").alias("mean"))).join(best, "compound", "left")


FAMILIES = ("classical", "deep", "causal")
FAM = f"{OBS}, u AS (SELECT compound, target, CASE source WHEN 'A' THEN 'classical' WHEN 'N' THEN 'deep' ELSE 'causal' END AS fam, pki AS v FROM obs), fs AS (SELECT compound, target, fam, avg(v) AS mean, median(v) AS median, min(v) AS min, max(v) AS max, CASE WHEN count(*) > 1 THEN stddev_pop(v) ELSE 0 END AS std, count(v) AS n_models FROM u GROUP BY 1, 2, 3)"


def unified(spark: SparkSession, d: str) -> DataFrame:
    fam = F.when(F.col("source") == "A", "classical").when(F.col("source") == "N", "deep").otherwise("causal")
    return obs(spark, d).select("compound", "target", fam.alias("fam"), F.col("pki").alias("v"))


@query(f"WITH {FAM} SELECT compound, target, fam, round(mean, 6) AS mean, round(median, 6) AS median, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std, n_models FROM fs")
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shortlist.family_summary(unified(spark, d), ["compound", "target"], "fam", "v"))


@query(f"WITH {FAM} SELECT compound, target, " + ", ".join(f"round(max(CASE WHEN fam = '{f}' THEN mean END), 6) AS {f}_mean, round(coalesce(max(CASE WHEN fam = '{f}' THEN std END), 0), 6) AS {f}_within" for f in FAMILIES)
       + ", round(avg(mean), 6) AS cross_mean, round(median(mean), 6) AS cross_median, round(stddev_pop(mean), 6) AS cross_std, round(max(mean) - min(mean), 6) AS disagreement, CAST(count(*) AS INTEGER) AS families_with_support FROM fs GROUP BY 1, 2")
def consensus(spark: SparkSession, d: str) -> DataFrame:
    c = shortlist.consensus(shortlist.family_summary(unified(spark, d), ["compound", "target"], "fam", "v"), ["compound", "target"], "fam", FAMILIES)
    return rounded(c.select("compound", "target", *[f"{f}_{x}" for f in FAMILIES for x in ("mean", "within")], "cross_mean", "cross_median", "cross_std", "disagreement", "families_with_support"))


@query(f"""WITH {FAM}, m AS (SELECT compound, target, stddev_pop(v) AS model_std, count(v) AS n_predictions FROM u GROUP BY 1, 2), b AS (SELECT compound, target, max(CASE WHEN fam = 'causal' THEN max END) AS causal, max(CASE WHEN fam <> 'causal' THEN max END) AS other, CAST(sum(n_models) AS BIGINT) AS n_models, stddev_pop(mean) AS cross_std, max(mean) - min(mean) AS disagreement FROM fs GROUP BY 1, 2)
SELECT compound, target, n_predictions, n_models, round(model_std, 6) AS model_std, round(causal, 6) AS best_causal, round(other, 6) AS best_other, round(causal - other, 6) AS difference, round(0.5 * model_std + 0.3 * cross_std + 0.2 * disagreement, 6) AS uncertainty FROM m JOIN b USING (compound, target)""")
def uncertainty(spark: SparkSession, d: str) -> DataFrame:
    u = unified(spark, d)
    keys = ["compound", "target"]
    c = shortlist.consensus(shortlist.family_summary(u, keys, "fam", "v"), keys, "fam", FAMILIES)
    n = sum((F.coalesce(F.col(f"{f}_n"), F.lit(0)) for f in FAMILIES), F.lit(0)).cast("long")
    m = u.groupBy(*keys).agg(F.stddev_pop("v").alias("model_std"), F.count("v").alias("n_predictions"))
    j = c.withColumns({"best_causal": F.col("causal_best"), "best_other": F.greatest("classical_best", "deep_best"), "n_models": n}).join(m, keys)
    total = shortlist.weighted({"model_std": 0.5, "cross_std": 0.3, "disagreement": 0.2})
    return rounded(j.select(*keys, "n_predictions", "n_models", "model_std", "best_causal", "best_other", (F.col("best_causal") - F.col("best_other")).alias("difference"), total.alias("uncertainty")))


FEATURES = ("molecular_weight", "clogp", "tpsa")
APPLY = f"e AS (SELECT screening_compound_id AS id, {PRESENT('murcko_scaffold', True)} AS m, molecular_weight, clogp, tpsa, md5(screening_compound_id) < 'b' AS train FROM environment_features), st AS (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, median({c}) AS md_{c}, stddev_pop({c}) AS sd_{c}" for c in FEATURES) + " FROM e WHERE train)"
Z = [f"CASE WHEN sd_{c} > 0 THEN ({c} - md_{c}) / sd_{c} END" for c in FEATURES]


@query(f"WITH {APPLY} SELECT DISTINCT id, " + " + ".join(f"CAST(coalesce({c} < lo_{c} OR {c} > hi_{c}, false) AS INTEGER)" for c in FEATURES) + " AS range_violations, round(sqrt((" + " + ".join(f"coalesce(({z}) ** 2, 0)" for z in Z) + ") / nullif(" + " + ".join(f"CAST(({z}) IS NOT NULL AS INTEGER)" for z in Z) + ", 0)), 6) AS distance FROM e, st WHERE NOT train")
def applicability(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("id"), *FEATURES)
    train = F.md5("id") < "b"
    a = shortlist.applicability(e.where(~train), e.where(train), FEATURES)
    return rounded(a.select("id", "range_violations", "distance").distinct())


@query(f"""WITH e AS (SELECT DISTINCT screening_compound_id AS id, coalesce({PRESENT('murcko_scaffold', True)}, '') AS m, {PRESENT('standardized_smiles')} AS s FROM environment_features), f AS (SELECT m, count(*) AS n FROM e GROUP BY 1)
SELECT id, CASE WHEN e.m <> '' THEN e.m ELSE s END AS scaffold_group, n AS frequency, round(1.0 / n, 6) AS bonus FROM e JOIN f USING (m)""")
def diversity_bonus(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("id"), F.coalesce(present(F.col("murcko_scaffold"), PLACEHOLDERS), F.lit("")).alias("m"), present(F.col("standardized_smiles")).alias("s")).distinct()
    f = e.groupBy("m").agg(F.count("*").alias("frequency"))
    j = e.join(f, "m")
    return rounded(j.select("id", F.when(F.col("m") != "", F.col("m")).otherwise(F.col("s")).alias("scaffold_group"), "frequency", (1.0 / F.col("frequency")).alias("bonus")))


def _norm(c: str, larger: bool) -> str:
    o = "" if larger else " DESC"
    return f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER (PARTITION BY target) = 1 THEN 1 ELSE (rank() OVER (PARTITION BY target, {c} IS NULL ORDER BY {c}{o}) + (count(*) OVER (PARTITION BY target, {c}) - 1) / 2.0 - 1) / (count({c}) OVER (PARTITION BY target) - 1) END END"


@query(f"WITH {SCORED}, n AS (SELECT target, compound, {_norm('potency', True)} AS p, {_norm('selectivity', True)} AS s, {_norm('uncertainty', False)} AS u FROM scored) SELECT target, compound, round(p, 6) AS potency, round(s, 6) AS selectivity, round(u, 6) AS certainty, round(coalesce(p, 0) * 0.5 + coalesce(s, 0) * 0.3 + coalesce(u, 0) * 0.2, 9) AS strategic FROM n")
def strategic_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rank-normalized parts of a target and their weighted sum."""
    s = scored(spark, d)
    n = s
    for part, out, larger in (("potency", "potency_rank", True), ("selectivity", "selectivity_rank", True), ("uncertainty", "certainty", False)):
        n = windows.with_rank_normalized(n, part, out, ["target"], larger_is_better=larger)
    n = n.select("target", "compound", F.col("potency_rank").alias("potency"), F.col("selectivity_rank").alias("selectivity"), "certainty")
    total = shortlist.weighted({"potency": 0.5, "selectivity": 0.3, "certainty": 0.2})
    return n.select("target", "compound", *[F.round(c, 6).alias(c) for c in ("potency", "selectivity", "certainty")], F.round(total, 9).alias("strategic"))


ENTITY = f"""e AS (SELECT entity_id, {NUM('final_strategic_score')} AS score, scaffold_frequency AS freq, coalesce(rare_scaffold_flag, 0) AS rare, coalesce({PRESENT('murcko_scaffold', True)}, '') AS scaffold, coalesce({PRESENT('generic_scaffold', True)}, '') AS generic, eligibility_flags AS flags FROM final_shortlist),
q AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY score IS NULL ORDER BY score, entity_id) / count(score) OVER () END AS pr FROM e)"""
BUCKETS = {"top": "pr >= 0.8", "rare": "rare = 1 AND pr >= 0.3", "broad": "freq >= 5 AND pr >= 0.5", "open": "pr < 0.3 AND rare = 0"}


def entities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "final_shortlist").select(
        "entity_id", known("final_strategic_score").alias("score"), F.col("scaffold_frequency").alias("freq"), F.coalesce("rare_scaffold_flag", F.lit(0)).alias("rare"),
        F.coalesce(present(F.col("murcko_scaffold"), PLACEHOLDERS), F.lit("")).alias("scaffold"), F.coalesce(present(F.col("generic_scaffold"), PLACEHOLDERS), F.lit("")).alias("generic"),
    )
    return windows.with_place(e, "score", [F.col("entity_id")], "place", "n").withColumn("pr", F.col("place") / F.col("n")).drop("place", "n")


def bucket_entries(spark: SparkSession, d: str) -> DataFrame:
    e = entities(spark, d)
    hits = F.array_compact(F.array(*[F.when(F.expr(rule), F.struct(F.lit(b).alias("bucket"), F.lit(i + 1).alias("priority"))) for i, (b, rule) in enumerate(BUCKETS.items())]))
    return e.withColumn("hit", F.explode(hits)).select("entity_id", "score", "freq", "scaffold", "generic", "hit.*")


ENTRIES = f"{ENTITY}, entries AS (" + " UNION ALL ".join(f"SELECT entity_id, score, freq, scaffold, generic, '{b}' AS bucket, {i + 1} AS priority FROM q WHERE {r}" for i, (b, r) in enumerate(BUCKETS.items())) + ")"


@query(f"WITH {ENTITY} SELECT entity_id, round(pr, 6) AS pr, concat_ws(';', " + ", ".join(f"CASE WHEN {BUCKETS[b]} THEN '{b}' END" for b in sorted(BUCKETS)) + ") AS satisfied FROM q")
def bucket_flags(spark: SparkSession, d: str) -> DataFrame:
    """Quantile and flag rules of four buckets, and the sorted names of those a row satisfies."""
    sat = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.expr(r), F.lit(b)) for b, r in BUCKETS.items()]))), ";")
    return rounded(entities(spark, d).select("entity_id", "pr", sat.alias("satisfied")))


@query(f"WITH {ENTRIES} SELECT entity_id, arg_min(bucket, priority) AS bucket, CAST(min(priority) AS INTEGER) AS priority, string_agg(DISTINCT bucket, ';' ORDER BY bucket) AS all_buckets, count(DISTINCT bucket) AS n_buckets, count(DISTINCT bucket) > 1 AS was_in_several FROM entries GROUP BY 1")
def bucket_assignment(spark: SparkSession, d: str) -> DataFrame:
    return shortlist.one_bucket(bucket_entries(spark, d), "entity_id", "bucket", "priority")


@query(f"WITH {ENTRIES} SELECT entity_id, bucket, CAST(row_number() OVER (PARTITION BY bucket ORDER BY score DESC NULLS LAST, freq NULLS LAST, entity_id) AS INTEGER) AS rank FROM entries QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY score DESC NULLS LAST, freq NULLS LAST, entity_id) <= 15")
def top_of_buckets(spark: SparkSession, d: str) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("freq").asc_nulls_last(), F.col("entity_id")]
    return windows.top_per_group(bucket_entries(spark, d), ["bucket"], order, 15).select("entity_id", "bucket", "rank")


@query(f"""WITH RECURSIVE {ENTRIES}, o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC NULLS LAST, entity_id) AS i FROM entries),
step AS (SELECT bucket, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS entity_id, false AS kept, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS gs FROM (SELECT DISTINCT bucket FROM o)
UNION ALL SELECT o.bucket, o.i, o.entity_id, len(list_filter(es, lambda x: x = scaffold)) < 3 AND len(list_filter(gs, lambda x: x = generic)) < 5,
CASE WHEN len(list_filter(es, lambda x: x = scaffold)) < 3 AND len(list_filter(gs, lambda x: x = generic)) < 5 THEN list_append(es, scaffold) ELSE es END,
CASE WHEN len(list_filter(es, lambda x: x = scaffold)) < 3 AND len(list_filter(gs, lambda x: x = generic)) < 5 THEN list_append(gs, generic) ELSE gs END FROM step JOIN o ON o.bucket = step.bucket AND o.i = step.i + 1)
SELECT bucket, entity_id FROM step WHERE kept""")
def capped_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Greedy caps of three per scaffold and five per generic scaffold among the rows already kept."""
    e = bucket_entries(spark, d).withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy(F.col("score").desc_nulls_last(), "entity_id")))
    kept = shortlist.capped(e, "bucket", ["place"], "scaffold", "generic", 3, 5)
    return kept.select("bucket", "place").join(e.select("bucket", "place", "entity_id"), ["bucket", "place"]).select("bucket", "entity_id")


@query("SELECT coalesce(assigned_bucket, 'all') AS assigned_bucket, count(*) AS n_rows, count(DISTINCT screening_compound_id) AS n_screening_compound_id, count(DISTINCT target_chembl_id) AS n_target_chembl_id FROM final_shortlist GROUP BY ROLLUP (assigned_bucket)")
def bucket_subtotals(spark: SparkSession, d: str) -> DataFrame:
    return shortlist.subtotals(table(spark, d, "final_shortlist"), "assigned_bucket", ["screening_compound_id", "target_chembl_id"])


@query(f"WITH {ENTRIES}, m AS (SELECT entity_id, min(priority) AS p FROM entries GROUP BY 1) SELECT bucket, count(*) AS n_entries, count(*) FILTER (priority = p) AS n_final, count(*) - count(*) FILTER (priority = p) AS n_removed FROM entries JOIN m USING (entity_id) GROUP BY 1")
def bucket_summary(spark: SparkSession, d: str) -> DataFrame:
    e = bucket_entries(spark, d)
    m = e.groupBy("entity_id").agg(F.min("priority").alias("p"))
    return e.join(m, "entity_id").groupBy("bucket").agg(F.count("*").alias("n_entries"), F.count_if(F.col("priority") == F.col("p")).alias("n_final"), F.count_if(F.col("priority") != F.col("p")).alias("n_removed"))


@query(f"WITH f AS (SELECT assigned_bucket, {PRESENT('murcko_scaffold', True)} AS s FROM final_shortlist) SELECT assigned_bucket, s AS scaffold, count(*) AS n, CAST(row_number() OVER (PARTITION BY assigned_bucket ORDER BY count(*) DESC, s) AS INTEGER) AS rank FROM f WHERE s IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY assigned_bucket ORDER BY count(*) DESC, s) <= 5")
def commonest_scaffolds(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "final_shortlist").select("assigned_bucket", present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("scaffold")).where("scaffold IS NOT NULL")
    g = f.groupBy("assigned_bucket", "scaffold").agg(F.count("*").alias("n"))
    return windows.top_per_group(g, ["assigned_bucket"], [F.col("n").desc(), F.col("scaffold")], 5)


@query("SELECT x.assigned_bucket AS a, y.assigned_bucket AS b, count(DISTINCT x.screening_compound_id) AS shared FROM final_shortlist x JOIN final_shortlist y USING (screening_compound_id) WHERE x.assigned_bucket <> y.assigned_bucket GROUP BY 1, 2")
def bucket_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "final_shortlist").select("screening_compound_id", "assigned_bucket").distinct()
    a, b = c.withColumnRenamed("assigned_bucket", "a"), c.withColumnRenamed("assigned_bucket", "b")
    return a.join(b, "screening_compound_id").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@query(f"""WITH {SCORED}, l AS (SELECT DISTINCT screening_compound_id AS compound, source_library_name AS lib FROM environment_features), s AS (SELECT compound, max(score) AS score FROM scored GROUP BY 1)
SELECT CASE WHEN s.compound IS NULL THEN 'library only' WHEN l.compound IS NULL THEN 'scores only' ELSE 'both' END AS side, count(*) AS n, count(score) AS n_scored FROM s FULL JOIN l ON s.compound = l.compound GROUP BY 1""")
def score_entities(spark: SparkSession, d: str) -> DataFrame:
    """Scores and library, each whether or not the other has it."""
    lib = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("c"), F.col("source_library_name").alias("lib")).distinct()
    s = scored(spark, d).groupBy("compound").agg(F.max("score").alias("score"))
    j = s.join(lib, F.col("compound") == F.col("c"), "full")
    side = F.when(F.col("compound").isNull(), "library only").when(F.col("c").isNull(), "scores only").otherwise("both")
    return j.groupBy(side.alias("side")).agg(F.count("*").alias("n"), F.count("score").alias("n_scored"))


@query("SELECT eligibility_flags AS flags, trim(f) AS flag, count(*) AS n FROM (SELECT eligibility_flags, unnest(string_split(eligibility_flags, ';')) AS f FROM final_shortlist) WHERE trim(f) <> '' GROUP BY 1, 2")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "final_shortlist").select(F.col("eligibility_flags").alias("flags"), F.explode(F.split("eligibility_flags", ";")).alias("f"))
    return f.where(F.trim("f") != "").groupBy("flags", F.trim("f").alias("flag")).agg(F.count("*").alias("n"))


@query("SELECT entity_id, coalesce(nullif(trim(target_chembl_id), ''), 'none') || ': ' || printf('%.6f', final_strategic_score) AS rationale FROM final_shortlist WHERE final_strategic_score IS NOT NULL AND NOT isnan(final_strategic_score)")
def rationale_text(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "final_shortlist").where(known("final_strategic_score").isNotNull())
    return f.select("entity_id", F.concat(F.coalesce(F.nullif(F.trim("target_chembl_id"), F.lit("")), F.lit("none")), F.lit(": "), F.format_string("%.6f", "final_strategic_score")).alias("rationale"))
