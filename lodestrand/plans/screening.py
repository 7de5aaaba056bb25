"""Queries that compose screening and evaluation results from several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PLACEHOLDERS, key, present
from ..operators import compose, labels, metrics, shortlist, windows
from ..operators.measures import known
from ..session import table
from .bindings import FACT, OBS, PREDICTIONS, fact, obs, predictions
from .facts import PRESENT
from .models import FOLDS, folds, rounded
from .rankings import NUM, SCORED, scored

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def library(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "environment_features").select(
        F.col("screening_compound_id").alias("compound"), present(F.col("standardized_smiles")).alias("structure"), F.col("source_library_name").alias("library"),
        present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("scaffold"), present(F.col("generic_murcko_scaffold"), PLACEHOLDERS).alias("generic"),
        "heavy_atom_count", *[known(c).alias(c) for c in ("molecular_weight", "clogp", "tpsa")], "registered_at",
    )


LIBRARY = f"""library AS (SELECT screening_compound_id AS compound, {PRESENT('standardized_smiles')} AS structure, source_library_name AS library, {PRESENT('murcko_scaffold', True)} AS scaffold, {PRESENT('generic_murcko_scaffold', True)} AS generic,
 heavy_atom_count, {NUM('molecular_weight')} AS molecular_weight, {NUM('clogp')} AS clogp, {NUM('tpsa')} AS tpsa, registered_at FROM environment_features)"""
FIRST = "structure NULLS LAST, library NULLS LAST, registered_at NULLS LAST"
ORDER = ("structure", "library", "registered_at")


def training(spark: SparkSession, d: str) -> DataFrame:
    """Rows labelled train, with structure and target."""
    s = table(spark, d, "split_assignments").where(F.lower(present(F.col("split_label"))) == "train")
    return s.select("row_uid", present(F.col("standardized_smiles")).alias("structure"), key(F.col("target_chembl_id")).alias("target"), F.lower(present(F.col("split_strategy"))).alias("strategy"), known("pKi").alias("pki"))


TRAINING = f"""training AS (SELECT row_uid, {PRESENT('standardized_smiles')} AS structure, upper({PRESENT('target_chembl_id', True)}) AS target, lower({PRESENT('split_strategy')}) AS strategy, {NUM('pKi')} AS pki FROM split_assignments WHERE lower({PRESENT('split_label')}) = 'train')"""


@query(f"WITH {LIBRARY}, {TRAINING}, t AS (SELECT DISTINCT structure AS s FROM training) SELECT compound, library, registered_at, coalesce(structure IN (SELECT s FROM t WHERE s IS NOT NULL), false) AS in_training FROM library")
def training_membership(spark: SparkSession, d: str) -> DataFrame:
    """Whether a library compound's structure is among the training structures."""
    x = compose.with_membership(library(spark, d), "structure", training(spark, d), "structure", "in_training")
    return x.select("compound", "library", "registered_at", "in_training")


@query(f"WITH {LIBRARY}, {TRAINING}, m AS (SELECT DISTINCT structure, scaffold FROM library WHERE structure IS NOT NULL AND scaffold IS NOT NULL), r AS (SELECT scaffold, count(*) AS n, count(DISTINCT training.structure) AS k, round(avg(pki), 6) AS pki FROM training JOIN m USING (structure) GROUP BY 1) SELECT compound, library, registered_at, l.scaffold, coalesce(n, 0) AS n_rows_training_reference, coalesce(k, 0) AS n_structures_training_reference, pki AS pki_training_reference FROM library l LEFT JOIN r ON l.scaffold = r.scaffold")
def training_reference(spark: SparkSession, d: str) -> DataFrame:
    """Library compounds with what training knows of their scaffold; summed up per scaffold first, so that the join does not fan out."""
    lib = library(spark, d)
    of = lib.where("structure IS NOT NULL AND scaffold IS NOT NULL").select("structure", "scaffold").distinct()
    r = training(spark, d).join(of, "structure").groupBy(F.col("scaffold").alias("s")).agg(
        F.count("*").alias("n_rows_training_reference"), F.count_distinct("structure").alias("n_structures_training_reference"), F.avg("pki").alias("pki_training_reference")
    )
    x = lib.join(r, F.col("scaffold") == F.col("s"), "left").fillna(0, ["n_rows_training_reference", "n_structures_training_reference"])
    return rounded(x.select("compound", "library", "registered_at", "scaffold", *[c for c in r.columns if c != "s"]))


@query(f"WITH {LIBRARY}, {TRAINING}, f AS (SELECT * FROM library WHERE structure IS NOT NULL QUALIFY row_number() OVER (PARTITION BY structure ORDER BY compound, library NULLS LAST, registered_at NULLS LAST) = 1) SELECT row_uid, target, strategy, t.structure IS NOT NULL AND f.structure IS NOT NULL AS has_features, heavy_atom_count, clogp, tpsa FROM training t LEFT JOIN f ON t.structure = f.structure")
def rows_with_features(spark: SparkSession, d: str) -> DataFrame:
    """Training rows with the features of their structure, one feature row a structure."""
    lib = library(spark, d)
    columns = ["heavy_atom_count", "clogp", "tpsa", "compound"]
    x = compose.join_first(training(spark, d), [(lib, ["structure"], ["compound", "library", "registered_at"], columns)])
    return x.select("row_uid", "target", "strategy", F.col("compound").isNotNull().alias("has_features"), "heavy_atom_count", "clogp", "tpsa")


SHORT = f"""sl AS (SELECT entity_id, assigned_bucket, final_shortlist_rank, screening_compound_id AS compound, upper({PRESENT('target_chembl_id', True)}) AS target, {PRESENT('murcko_scaffold', True)} AS scaffold, {PRESENT('generic_scaffold', True)} AS generic, coalesce(rare_scaffold_flag, 0) AS rare, {NUM('final_strategic_score')} AS final_score, eligibility_flags FROM final_shortlist)"""


def short(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "final_shortlist").select(
        "entity_id", "assigned_bucket", "final_shortlist_rank", F.col("screening_compound_id").alias("compound"), key(F.col("target_chembl_id")).alias("target"), present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("scaffold"),
        present(F.col("generic_scaffold"), PLACEHOLDERS).alias("generic"), F.coalesce("rare_scaffold_flag", F.lit(0)).alias("rare"), known("final_strategic_score").alias("final_score"), "eligibility_flags",
    )


DICTIONARY = f"td AS (SELECT chembl_id AS target, lower({PRESENT('organism')}) AS organism, {PRESENT('kinase_family')} AS family FROM target_dictionary)"


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "target_dictionary").select(F.col("chembl_id").alias("target"), F.lower(present(F.col("organism"))).alias("organism"), present(F.col("kinase_family")).alias("family"))


@query(f"""WITH {SHORT}, {SCORED}, {LIBRARY}, {DICTIONARY}, l AS (SELECT * FROM library WHERE compound IS NOT NULL QUALIFY row_number() OVER (PARTITION BY compound ORDER BY {FIRST}) = 1)
SELECT entity_id, sl.compound, sl.target, library, l.scaffold AS lib_scaffold, organism, family, score, potency, coalesce(score >= 0.5, false) AS score_ok, coalesce(potency >= 6, false) AS potency_ok, coalesce(tpsa <= 140 AND clogp <= 5, false) AS physchem_ok, l.compound IS NULL AS not_in_library
FROM sl LEFT JOIN scored s ON sl.compound = s.compound AND sl.target = s.target LEFT JOIN l ON sl.compound = l.compound LEFT JOIN td ON sl.target = td.target""")
def shortlist_entities(spark: SparkSession, d: str) -> DataFrame:
    """Shortlist rows with their score, library row and target, each side one row a key, and flags."""
    lib = library(spark, d)
    x = compose.join_first(short(spark, d).select("entity_id", "compound", "target"), [
        (scored(spark, d), ["compound", "target"], ["score"], ["score", "potency"]),
        (lib.withColumn("there", F.lit(True)), ["compound"], ORDER, ["library", "scaffold", "tpsa", "clogp", "there"]),
        (dictionary(spark, d), ["target"], ["organism"], ["organism", "family"]),
    ], ["", "lib_", ""])
    ok = lambda c: F.coalesce(c, F.lit(False))
    return x.select(
        "entity_id", "compound", "target", F.col("lib_library").alias("library"), "lib_scaffold", "organism", "family", "score", "potency", ok(F.col("score") >= 0.5).alias("score_ok"), ok(F.col("potency") >= 6).alias("potency_ok"),
        ok((F.col("lib_tpsa") <= 140) & (F.col("lib_clogp") <= 5)).alias("physchem_ok"), F.col("lib_there").isNull().alias("not_in_library"),
    )


SUMMARIES = {"target": "target", "compound": "compound", "scaffold": "scaffold", "bucket": "assigned_bucket"}


@query(f"WITH {SHORT}, " + ", ".join(f"g_{n} AS (SELECT {c}, count(*) AS n, round(avg(final_score), 6) AS mean, max(final_score) AS best FROM sl WHERE {c} IS NOT NULL GROUP BY 1)" for n, c in SUMMARIES.items())
       + " SELECT entity_id, " + ", ".join(f"g_{n}.{x} AS {n}_{x}" for n in SUMMARIES for x in ("n", "mean", "best")) + " FROM sl " + " ".join(f"LEFT JOIN g_{n} ON sl.{c} = g_{n}.{c}" for n, c in SUMMARIES.items()))
def consensus_with_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Each row with four summaries of its groups."""
    s = short(spark, d)
    x = s.select("entity_id", *SUMMARIES.values())
    for n, c in SUMMARIES.items():
        g = s.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(f"{n}_n"), F.avg("final_score").alias(f"{n}_mean"), F.max("final_score").alias(f"{n}_best"))
        x = x.join(g, c, "left")
    return rounded(x.drop(*SUMMARIES.values()))


@query(f"""WITH {SHORT}, w AS (SELECT entity_id, compound, assigned_bucket, final_shortlist_rank AS r, coalesce(target, 'none') || ' in ' || assigned_bucket || ': ' || coalesce(printf('%.6f', final_score), 'no score') AS rationale FROM sl),
b AS (SELECT assigned_bucket, count(*) AS n, min(r) AS first_rank FROM w GROUP BY 1), t AS (SELECT compound, count(*) AS n_rows, arg_min(entity_id, r) AS kept, string_agg(entity_id, ';' ORDER BY entity_id) AS trace FROM w GROUP BY 1)
SELECT entity_id, rationale, b.n AS bucket_rows, first_rank AS bucket_first_rank, n_rows AS dedup_rows, kept AS dedup_kept, trace AS dedup_trace, entity_id = kept AS is_kept FROM w LEFT JOIN b USING (assigned_bucket) LEFT JOIN t ON w.compound = t.compound""")
def rationale_trace(spark: SparkSession, d: str) -> DataFrame:
    """Rationale of a row, of its bucket, and the trace of repeated compounds, under names that do not collide."""
    text = F.concat(F.coalesce("target", F.lit("none")), F.lit(" in "), F.col("assigned_bucket"), F.lit(": "), F.when(F.col("final_score").isNotNull(), F.format_string("%.6f", "final_score")).otherwise("no score"))
    w = short(spark, d).select("entity_id", "compound", "assigned_bucket", F.col("final_shortlist_rank").alias("r"), text.alias("rationale"))
    b = w.groupBy("assigned_bucket").agg(F.count("*").alias("bucket_rows"), F.min("r").alias("bucket_first_rank"))
    t = w.groupBy("compound").agg(F.count("*").alias("dedup_rows"), F.min_by("entity_id", "r").alias("dedup_kept"), F.array_join(F.array_sort(F.collect_list("entity_id")), ";").alias("dedup_trace"))
    x = w.join(b, "assigned_bucket", "left").join(t, "compound", "left")
    return x.select("entity_id", "rationale", "bucket_rows", "bucket_first_rank", "dedup_rows", "dedup_kept", "dedup_trace", (F.col("entity_id") == F.col("dedup_kept")).alias("is_kept"))


@query(f"""WITH {LIBRARY}, {SCORED}, {SHORT}, l AS (SELECT * FROM library WHERE compound IS NOT NULL QUALIFY row_number() OVER (PARTITION BY compound ORDER BY {FIRST}) = 1),
r AS (SELECT compound, max(score) AS score, count(*) AS n_targets FROM scored GROUP BY 1), h AS (SELECT compound, min(final_shortlist_rank) AS rank, arg_min(assigned_bucket, final_shortlist_rank) AS bucket FROM sl GROUP BY 1),
j AS (SELECT l.*, score, n_targets, rank, bucket FROM l LEFT JOIN r USING (compound) LEFT JOIN h USING (compound)),
q AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY score IS NULL ORDER BY score, compound) END AS i, count(score) OVER () AS m FROM j)
SELECT compound, library, heavy_atom_count AS feature_heavy_atom_count, clogp AS feature_clogp, tpsa AS feature_tpsa, round(score, 6) AS score, n_targets, rank AS shortlist_rank, bucket AS shortlist_bucket,
CASE WHEN i IS NOT NULL THEN CAST(CASE WHEN m <= 1 THEN 0 ELSE greatest(ceil(least(5, m) * (i - 1) / (m - 1)) - 1, 0) END AS INTEGER) END AS score_bin, CASE WHEN rank IS NOT NULL THEN 'shortlisted' WHEN n_targets IS NOT NULL THEN 'scored' ELSE 'library only' END AS label FROM q""")
def compound_level(spark: SparkSession, d: str) -> DataFrame:
    """One row per library compound with ranking, shortlist and numeric features, a quantile bin of the score and a label."""
    lib = compose.first_rows(library(spark, d), ["compound"], ORDER, ["library", "heavy_atom_count", "clogp", "tpsa"])
    lib = lib.select("compound", "library", *[F.col(c).alias(f"feature_{c}") for c in ("heavy_atom_count", "clogp", "tpsa")])
    r = scored(spark, d).groupBy("compound").agg(F.max("score").alias("score"), F.count("*").alias("n_targets"))
    h = short(spark, d).groupBy("compound").agg(F.min("final_shortlist_rank").alias("shortlist_rank"), F.min_by("assigned_bucket", "final_shortlist_rank").alias("shortlist_bucket"))
    x = windows.with_place(lib.join(r, "compound", "left").join(h, "compound", "left"), "score", [F.col("compound")], "i", "m")
    label = F.when(F.col("shortlist_rank").isNotNull(), "shortlisted").when(F.col("n_targets").isNotNull(), "scored").otherwise("library only")
    return rounded(x.withColumns({"score_bin": F.when(F.col("i").isNotNull(), windows.quantile_bin(F.col("i"), F.col("m"))), "label": label}).drop("i", "m"))


@query(f"WITH {SHORT}, {SCORED} SELECT s.target, s.compound, round(score, 6) AS score FROM scored s WHERE EXISTS (SELECT 1 FROM sl WHERE sl.compound = s.compound)")
def shortlisted_only(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return rounded(s.join(short(spark, d).select("compound").distinct(), "compound", "left_semi").select("target", "compound", "score"))


@query(f"SELECT row_uid, lower({PRESENT('split_label')}) AS label FROM split_assignments WHERE {PRESENT('split_label')} IS NULL OR lower({PRESENT('split_label')}) IN ('test', 'holdout')")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the test or holdout part, and those without a label."""
    s = table(spark, d, "split_assignments").select("row_uid", F.lower(present(F.col("split_label"))).alias("label"))
    return s.where(F.col("label").isNull() | F.col("label").isin("test", "holdout"))


@query(f"""WITH {SCORED}, a AS (SELECT compound, avg(score) AS cross FROM scored GROUP BY 1) SELECT target, compound, round(coalesce(score, potency, selectivity, a.cross), 6) AS value, CASE WHEN score IS NOT NULL THEN 'strategic' WHEN potency IS NOT NULL THEN 'potency' WHEN selectivity IS NOT NULL THEN 'selectivity' WHEN a.cross IS NOT NULL THEN 'cross_family' END AS source
FROM scored JOIN a USING (compound)""")
def score_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first known score in order of preference, with its source's name; a compound's mean over all targets as the fallback."""
    s = scored(spark, d)
    x = s.join(s.groupBy("compound").agg(F.avg("score").alias("cross")), "compound")
    value, source = compose.preferred([("score", "strategic"), ("potency", "potency"), ("selectivity", "selectivity"), ("cross", "cross_family")])
    return rounded(x.select("target", "compound", value.alias("value"), source.alias("source")))


PHYS = ("heavy_atom_count", "molecular_weight", "clogp", "tpsa")


@query(f"""WITH {LIBRARY}, e AS (SELECT *, md5(compound) < 'b' AS train FROM library WHERE compound IS NOT NULL), st AS (SELECT """ + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, median({c}) AS md_{c}, stddev_pop({c}) AS sd_{c}" for c in PHYS)
       + """ FROM e WHERE train), s AS (SELECT DISTINCT scaffold FROM e WHERE train AND scaffold IS NOT NULL), g AS (SELECT DISTINCT generic FROM e WHERE train AND generic IS NOT NULL),
x AS (SELECT e.*, """ + " + ".join(f"CAST(coalesce({c} < lo_{c} OR {c} > hi_{c}, false) AS INTEGER)" for c in PHYS) + " AS violations, sqrt((" + " + ".join(f"coalesce((CASE WHEN sd_{c} > 0 THEN ({c} - md_{c}) / sd_{c} END) ** 2, 0)" for c in PHYS) + f""") / {len(PHYS)}) AS distance,
CAST(scaffold IS NOT NULL AND scaffold NOT IN (SELECT scaffold FROM s) AS INTEGER) AS novel, CAST(generic IS NOT NULL AND generic NOT IN (SELECT generic FROM g) AS INTEGER) AS novel_generic FROM e, st WHERE NOT train)
SELECT compound, structure, library, registered_at, violations, round(distance, 6) AS distance, novel, novel_generic, CAST(violations > 0 AS INTEGER) AS out_of_range, CAST({' AND '.join(f'{c} IS NULL' for c in PHYS)} AS INTEGER) AS features_missing, round(violations + distance + novel + CAST(violations > 0 AS INTEGER), 6) AS penalty FROM x""")
def applicability_flags(spark: SparkSession, d: str) -> DataFrame:
    """How far screening compounds lie from the training compounds: range violations, distance in spreads (a missing feature
    counts as no distance), novel scaffolds, physico-chemical range, and the sum of these as a penalty."""
    lib = library(spark, d).where("compound IS NOT NULL").withColumn("heavy_atom_count", F.col("heavy_atom_count").cast("double"))
    train = F.md5("compound") < "b"
    ref = lib.where(train)
    x = shortlist.applicability(lib.where(~train), ref, PHYS)
    known_features = sum((F.col(c).isNotNull().cast("int") for c in PHYS), F.lit(0))
    x = x.withColumn("distance", F.coalesce(F.col("distance") * F.sqrt(known_features / F.lit(float(len(PHYS)))), F.lit(0.0)))
    x = compose.with_membership(x, "scaffold", ref, "scaffold", "old_scaffold")
    x = compose.with_membership(x, "generic", ref, "generic", "old_generic")
    novel = (F.col("scaffold").isNotNull() & ~F.col("old_scaffold")).cast("int")
    out = (F.col("range_violations") > 0).cast("int")
    return rounded(x.select(
        "compound", "structure", "library", "registered_at", F.col("range_violations").alias("violations"), "distance", novel.alias("novel"), (F.col("generic").isNotNull() & ~F.col("old_generic")).cast("int").alias("novel_generic"),
        out.alias("out_of_range"), (known_features == 0).cast("int").alias("features_missing"), (F.col("range_violations") + F.col("distance") + novel + out).alias("penalty"),
    ))


ANNOTATIONS = ("target", "organism", "family", "scaffold")


@query(f"""WITH {DICTIONARY}, {SHORT}, {LIBRARY}, {TRAINING} SELECT DISTINCT target, organism, family, CAST(NULL AS VARCHAR) AS scaffold, 'targets' AS annotation_source FROM td UNION ALL SELECT DISTINCT target, NULL, NULL, scaffold, 'shortlist' FROM sl
UNION ALL SELECT DISTINCT NULL, NULL, NULL, scaffold, 'library' FROM library UNION ALL SELECT DISTINCT target, NULL, NULL, NULL, 'training' FROM training""")
def annotation_union(spark: SparkSession, d: str) -> DataFrame:
    """Distinct annotations of four tables in common columns."""
    return compose.union_of_annotations({"targets": dictionary(spark, d), "shortlist": short(spark, d), "library": library(spark, d), "training": training(spark, d)}, ANNOTATIONS)


@query(f"WITH {FOLDS}, m AS (SELECT family_name, model, round(avg(rmse), 6) AS plot_metric FROM folds GROUP BY 1, 2) SELECT family_name, model, plot_metric, CAST(row_number() OVER (ORDER BY plot_metric, family_name, model) AS INTEGER) AS place FROM m WHERE plot_metric IS NOT NULL")
def metric_view(spark: SparkSession, d: str) -> DataFrame:
    """Models by their error in display order: lower is better, so ascending."""
    m = rounded(folds(spark, d).groupBy("family_name", "model").agg(F.avg("rmse").alias("rmse")))
    return compose.metric_view(m, "rmse", ["family_name", "model"], True).drop("rmse")


@query(f"WITH {FOLDS} SELECT family_name, model, fold, rmse AS x, mae AS y, 'rmse_mae' AS pair FROM folds WHERE rmse IS NOT NULL AND mae IS NOT NULL UNION ALL SELECT family_name, model, fold, pearson, spearman, 'pearson_spearman' FROM folds WHERE pearson IS NOT NULL AND spearman IS NOT NULL")
def scatter_sources(spark: SparkSession, d: str) -> DataFrame:
    """Source rows of scatter plots: two metrics of a fold, where both are known."""
    f = folds(spark, d)
    pair = lambda x, y: f.select("family_name", "model", "fold", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(f"{x}_{y}").alias("pair")).dropna(subset=["x", "y"])
    return pair("rmse", "mae").unionByName(pair("pearson", "spearman"))


TOPS = {"scaffold": "top_scaffolds", "generic": "top_generic", "target": "top_targets"}


@query(f"WITH {SHORT}, r AS (SELECT assigned_bucket AS bucket, * FROM sl UNION ALL SELECT 'ALL_BUCKETS', * FROM sl), " + ", ".join(
    f"t_{c} AS (SELECT bucket, string_agg(v || ':' || n, '; ' ORDER BY i) AS {o} FROM (SELECT bucket, {c} AS v, count(*) AS n, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, {c}) AS i FROM r WHERE {c} IS NOT NULL GROUP BY 1, 2) WHERE i <= 5 GROUP BY 1)" for c, o in TOPS.items())
    + " SELECT r.bucket, count(*) AS n_rows, count(DISTINCT compound) AS n_compounds, count(DISTINCT scaffold) AS n_scaffolds, round(1 - count(DISTINCT scaffold) / count(*), 6) AS duplication_rate, " + ", ".join(f"any_value({o}) AS {o}" for o in TOPS.values())
    + " FROM r " + " ".join(f"LEFT JOIN t_{c} ON r.bucket = t_{c}.bucket" for c in TOPS) + " GROUP BY 1")
def diversity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values, duplication rate and the five commonest values of each bucket, and of all."""
    s = short(spark, d)
    r = s.withColumn("bucket", F.explode(F.array(F.col("assigned_bucket"), F.lit("ALL_BUCKETS"))))
    x = r.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.count_distinct("compound").alias("n_compounds"), F.count_distinct("scaffold").alias("n_scaffolds"))
    x = x.withColumn("duplication_rate", 1 - F.col("n_scaffolds") / F.col("n_rows"))
    for c, o in TOPS.items():
        x = x.join(compose.value_list(r, ["bucket"], c, o), "bucket", "left")
    return rounded(x)


@query(f"WITH {SHORT}, {SCORED} SELECT assigned_bucket, count(*) AS n_rows, round(median(final_score), 6) AS median_score, min(final_score) AS least_score, max(final_score) AS most_score, round(avg(rare), 6) AS rare_fraction, round(avg(CAST(scaffold IS NULL AS INTEGER)), 6) AS missing_fraction, round(median(potency), 6) AS median_potency FROM sl LEFT JOIN scored ON sl.compound = scored.compound AND sl.target = scored.target GROUP BY 1")
def bucket_profile(spark: SparkSession, d: str) -> DataFrame:
    x = compose.join_first(short(spark, d), [(scored(spark, d), ["compound", "target"], ["score"], ["potency"])])
    return rounded(x.groupBy("assigned_bucket").agg(
        F.count("*").alias("n_rows"), F.median("final_score").alias("median_score"), F.min("final_score").alias("least_score"), F.max("final_score").alias("most_score"), F.avg("rare").alias("rare_fraction"),
        F.avg(F.col("scaffold").isNull().cast("int")).alias("missing_fraction"), F.median("potency").alias("median_potency"),
    ))


@query(f"WITH {TRAINING}, v AS (SELECT target, row_number() OVER (ORDER BY target) AS code FROM (SELECT DISTINCT target FROM training WHERE target IS NOT NULL)) SELECT row_uid, coalesce(code, 0) AS target_code FROM split_assignments s LEFT JOIN v ON upper({PRESENT('target_chembl_id', True)}) = v.target")
def encoded_targets(spark: SparkSession, d: str) -> DataFrame:
    """Codes of a vocabulary that is made of training rows only, 0 for targets it does not have."""
    v = training(spark, d).where("target IS NOT NULL").select(F.col("target").alias("t")).distinct().withColumn("code", F.row_number().over(W.orderBy("t")).cast("long"))
    s = table(spark, d, "split_assignments").select("row_uid", key(F.col("target_chembl_id")).alias("target"))
    return s.join(v, F.col("target") == F.col("t"), "left").select("row_uid", F.coalesce("code", F.lit(0)).alias("target_code"))


@query(f"WITH {FACT}, p AS (SELECT a.compound, a.target AS a, b.target AS b FROM fact a JOIN fact b ON a.compound = b.compound AND a.target < b.target WHERE abs(a.pki - b.pki) >= 1.5) SELECT compound, a AS target FROM p UNION SELECT compound, b FROM p")
def pair_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """The distinct measurements that stand at either end of a pair with a large difference."""
    from ..operators import pairs

    p = pairs.member_pairs(fact(spark, d), "compound", "target", ["pki"]).where("abs(pki_a - pki_b) >= 1.5")
    return compose.endpoints(p, [("compound", "target_a"), ("compound", "target_b")], ("compound", "target"))


@query(f"""WITH {PREDICTIONS}, p AS (SELECT family_name, model, fold, positive, chance, compound, target, sum(positive) OVER w AS tp, count(*) OVER w AS n FROM predictions WINDOW w AS (PARTITION BY family_name, model, fold ORDER BY chance DESC, compound, target, positive, observed, predicted ROWS UNBOUNDED PRECEDING))
SELECT family_name, model, fold, round(sum(CASE WHEN positive = 0 THEN tp ELSE 0 END) / CAST(sum(positive) * sum(1 - positive) AS DOUBLE), 6) AS roc_auc,
round(sum(CASE WHEN positive = 1 THEN (tp / n + CASE WHEN n = 1 THEN 1 ELSE (tp - 1) / (n - 1) END) / 2 ELSE 0 END) / sum(positive), 6) AS pr_auc FROM p GROUP BY 1, 2, 3""")
def stepwise_areas(spark: SparkSession, d: str) -> DataFrame:
    """Areas under curves of single rows, equal scores not grouped."""
    order = ["compound", "target", "positive", "observed", "predicted"]
    return rounded(metrics.stepwise_areas(predictions(spark, d), ["family_name", "model", "fold"], "positive", "chance", order))


@query(f"WITH {PREDICTIONS} SELECT compound, family_name, count(*) AS n, round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse FROM predictions GROUP BY 1, 2 HAVING count(*) >= 3")
def environment_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors per environment, of those with three rows or more."""
    e = F.col("observed") - F.col("predicted")
    return rounded(predictions(spark, d).groupBy("compound", "family_name").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).where("n >= 3"))


@query(f"WITH n AS (SELECT DISTINCT target_name, trim(regexp_replace(translate(upper(target_name), '-/', '  '), '\\s+', ' ', 'g')) AS x FROM compound_target_ranking WHERE target_name IS NOT NULL) SELECT target_name, x AS normalized, CASE "
       + " ".join(f"WHEN contains(x, '{t}') THEN '{f}'" for t, f in labels.FAMILY_RULES) + " ELSE 'Unclassified' END AS family, CASE " + " ".join(f"WHEN contains(x, '{t}') THEN 'name_match:{t}'" for t, _ in labels.FAMILY_RULES) + " ELSE 'name_match:unclassified' END AS provenance FROM n")
def family_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Families of target names by the ordered rules, with the rule that held."""
    n = table(spark, d, "compound_target_ranking").where("target_name IS NOT NULL").select("target_name").distinct()
    x = n.withColumn("normalized", labels.normalized_name(F.col("target_name")))
    return x.withColumn("r", labels.first_rule(F.col("normalized"))).select("target_name", "normalized", "r.family", "r.provenance")


@query(f"WITH {OBS} SELECT compound, string_agg(DISTINCT target_name, ';' ORDER BY target_name) AS names, count(DISTINCT target_name) AS n FROM obs GROUP BY 1")
def stable_order(spark: SparkSession, d: str) -> DataFrame:
    """The distinct values of a group in lexicographic order; a group has at most as many as there are targets."""
    o = obs(spark, d).select("compound", "target_name").distinct()
    return o.groupBy("compound").agg(F.array_join(F.array_sort(F.collect_list("target_name")), ";").alias("names"), F.count("*").alias("n"))


@query(f"WITH f AS (SELECT eligibility_flags, lower(trim(CAST(rare_scaffold_flag AS VARCHAR))) AS t FROM final_shortlist) SELECT t AS flag, coalesce(t IN ('1', 'true', 'yes') OR TRY_CAST(t AS DOUBLE) > 0, false) AS says_yes, count(*) AS n FROM f GROUP BY ALL")
def truthy_flags(spark: SparkSession, d: str) -> DataFrame:
    """Loosely written flags as booleans."""
    c = F.col("rare_scaffold_flag")
    return table(spark, d, "final_shortlist").groupBy(F.lower(F.trim(c.cast("string"))).alias("flag"), labels.truthy(c).alias("says_yes")).agg(F.count("*").alias("n"))


@query()
def embedding_map(spark: SparkSession, d: str) -> DataFrame:
    """Two principal coordinates of the embeddings."""
    from ..operators.models import principal_coordinates

    return principal_coordinates(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


@query("SELECT count(*) AS n, true AS centred, true AS ordered FROM embeddings")
def embedding_extent(spark: SparkSession, d: str) -> DataFrame:
    """Extent of the map: coordinates lie about 0, and the first spreads at least as far as the second."""
    m = embedding_map(spark, d)
    c = F.get("coordinates", F.lit(0)), F.get("coordinates", F.lit(1))
    a = m.agg(F.count("*").alias("n"), *[f(x).alias(f"{n}{i}") for i, x in enumerate(c) for n, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_pop))])
    return a.select("n", ((F.col("lo0") <= 0) & (F.col("hi0") >= 0) & (F.col("lo1") <= 0) & (F.col("hi1") >= 0)).alias("centred"), (F.col("sd0") >= F.col("sd1")).alias("ordered"))


