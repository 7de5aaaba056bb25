"""Queries on pairs, labels, splits, metrics and model comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import groupings, labels, measures, metrics, pairs, splits, windows
from ..session import table
from .bindings import FACT, OBS, PREDICTIONS, fact, obs, predictions

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, so that sums in another order compare equal; halves as binary arithmetic has them."""
    return df.select(*[measures.round_half_away(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query(f"WITH {FACT} SELECT a.compound, a.target AS target_a, b.target AS target_b, round(a.pki, 6) AS pki_a, round(b.pki, 6) AS pki_b, round(a.pki - b.pki, 6) AS delta FROM fact a JOIN fact b ON a.compound = b.compound AND a.target < b.target WHERE abs(a.pki - b.pki) >= 1.0")
def target_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs.member_pairs(fact(spark, d), "compound", "target", ["pki"]).withColumn("delta", F.col("pki_a") - F.col("pki_b"))
    return rounded(p.where(F.abs("delta") >= 1.0).select("compound", "target_a", "target_b", "pki_a", "pki_b", "delta"))


@query(f"WITH {FACT} SELECT a.target AS target_a, b.target AS target_b, count(*) AS n, round(avg(a.pki - b.pki), 6) AS mean_delta, count(*) FILTER (a.pki >= b.pki) AS n_not_less FROM fact a JOIN fact b ON a.compound = b.compound AND a.target <> b.target GROUP BY 1, 2")
def pairwise_task(spark: SparkSession, d: str) -> DataFrame:
    """Pairs in both directions, summed up per pair of targets."""
    p = pairs.member_pairs(fact(spark, d), "compound", "target", ["pki"], both_ways=True)
    return rounded(p.groupBy("target_a", "target_b").agg(F.count("*").alias("n"), F.avg(F.col("pki_a") - F.col("pki_b")).alias("mean_delta"), F.count_if(F.col("pki_a") >= F.col("pki_b")).alias("n_not_less")))


@query(f"""WITH {FACT}, p AS (SELECT a.compound, a.target, a.pki, b.pki AS o FROM fact a JOIN fact b ON a.compound = b.compound AND a.target <> b.target), g AS (SELECT compound, avg(pki) AS m, stddev_pop(pki) AS s FROM fact GROUP BY 1)
SELECT p.compound, target, round(any_value(pki), 6) AS pki, CAST(count(*) AS INTEGER) AS n_others, round(median(o), 6) AS others_median, round(avg(o), 6) AS others_mean, round(max(o), 6) AS others_max, round(list_sort(list(o), 'DESC')[2], 6) AS others_second, round(any_value(m), 6) AS group_mean, round(any_value(s), 6) AS group_std
FROM p JOIN g ON p.compound = g.compound GROUP BY 1, 2""")
def target_against_others(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.leave_one_out(fact(spark, d), "compound", "target", "pki"))


@query(f"""WITH {FACT}, x AS (SELECT compound, target, pki, CASE WHEN pki >= 4.5 THEN 1 WHEN pki < 4.2 THEN 0 END AS active, CASE WHEN pki >= 5.0 THEN 1 ELSE 0 END AS strong FROM fact)
SELECT compound, target, round(pki, 6) AS pki, active, CASE active WHEN 1 THEN 'active' WHEN 0 THEN 'inactive' ELSE 'unlabeled' END AS active_name, strong, '1 if value >= 4.5; 0 if value < 4.2; gray zone: unlabel' AS active_rule FROM x""")
def activity_labels(spark: SparkSession, d: str) -> DataFrame:
    f = fact(spark, d)
    a, s = labels.binary_label(F.col("pki"), 4.5, 4.2), labels.binary_label(F.col("pki"), 5.0, 4.2, "assign")
    return rounded(f.select("compound", "target", "pki", a.alias("active"), labels.label_name(a, "active", "inactive").alias("active_name"), s.alias("strong"), F.lit(labels.rule_text(4.5, 4.2, "unlabel")).alias("active_rule")))


@query(f"""WITH {FACT}, p AS (SELECT a.compound, a.target, any_value(a.pki) - median(b.pki) AS delta FROM fact a JOIN fact b ON a.compound = b.compound AND a.target <> b.target GROUP BY 1, 2)
SELECT f.compound, f.target, CASE WHEN pki >= 4.5 THEN 1 WHEN pki < 4.2 THEN 0 END AS active, round(delta, 6) AS delta, CASE WHEN delta >= 0.5 THEN 1 WHEN delta < 0.2 THEN 0 END AS selective FROM fact f LEFT JOIN p USING (compound, target)
WHERE coalesce(CASE WHEN pki >= 4.5 THEN 1 WHEN pki < 4.2 THEN 0 END, CASE WHEN delta >= 0.5 THEN 1 WHEN delta < 0.2 THEN 0 END) IS NOT NULL""")
def selectivity_labels(spark: SparkSession, d: str) -> DataFrame:
    """Activity and selectivity labels together, of the rows that have one of them."""
    f = fact(spark, d)
    loo = pairs.leave_one_out(f, "compound", "target", "pki").select("compound", "target", (F.col("pki") - F.col("others_median")).alias("delta"))
    x = f.join(loo, ["compound", "target"], "left").select("compound", "target", labels.binary_label(F.col("pki"), 4.5, 4.2).alias("active"), "delta", labels.binary_label(F.col("delta"), 0.5, 0.2).alias("selective"))
    return rounded(x.where(F.coalesce("active", "selective").isNotNull()))


UID = "concat_ws('|', CAST(compound AS VARCHAR), CAST(target AS VARCHAR))"


def uids(spark: SparkSession, d: str) -> DataFrame:
    return fact(spark, d).select(F.concat_ws("|", F.col("compound").cast("string"), F.col("target").cast("string")).alias("row_uid"), "compound", "target", "pki")


PLACED = f"{FACT}, u AS (SELECT {UID} AS row_uid, compound, target, pki, row_number() OVER (ORDER BY md5('2025|' || {UID}), {UID}) AS place, count(*) OVER () AS n FROM fact)"
LABEL = "CASE WHEN place <= floor(n * 0.7) THEN 'train' WHEN place <= floor(n * 0.7) + floor(n * 0.15) THEN 'valid' ELSE 'test' END"


@query(f"WITH {PLACED} SELECT row_uid, place, {LABEL} AS split_label FROM u")
def random_holdout(spark: SparkSession, d: str) -> DataFrame:
    return splits.random_split(uids(spark, d), "row_uid").select("row_uid", "place", "split_label")


@query(f"""WITH {PLACED}, f AS (SELECT unnest(range(1, 6)) AS fold_id), b AS (SELECT fold_id, n, (fold_id - 1) * (n // 5) + least(fold_id - 1, n % 5) AS s, n // 5 + CASE WHEN fold_id <= n % 5 THEN 1 ELSE 0 END AS h FROM f, (SELECT DISTINCT n FROM u))
SELECT row_uid, CAST(fold_id AS INTEGER) AS fold_id, CASE WHEN place > s AND place <= s + h THEN 'test' WHEN place - CASE WHEN place > s + h THEN h ELSE 0 END <= floor((u.n - h) * (0.15 / (0.7 + 0.15))) THEN 'valid' ELSE 'train' END AS split_label FROM u, b""")
def k_fold(spark: SparkSession, d: str) -> DataFrame:
    return splits.k_folds(uids(spark, d), "row_uid")


GROUPED = "g AS (SELECT k, row_number() OVER (ORDER BY md5('{seed}|' || k), k) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM x))"
GLABEL = "CASE WHEN place <= greatest(floor(n * 0.7), 1) THEN 'train' WHEN place <= greatest(floor(n * 0.7), 1) + greatest(floor(n * 0.15), 1) THEN 'valid' ELSE 'test' END"


@query(f"WITH {FACT}, x AS (SELECT {UID} AS row_uid, p_type AS k FROM fact JOIN part ON compound = p_partkey), {GROUPED.format(seed=2036)} SELECT row_uid, k AS group_key, {GLABEL} AS split_label FROM x JOIN g USING (k)")
def grouped_split(spark: SparkSession, d: str) -> DataFrame:
    u = uids(spark, d).join(table(spark, d, "part"), F.col("compound") == F.col("p_partkey"))
    return splits.group_split(u, "row_uid", "p_type")


@query(f"WITH {OBS}, s AS (SELECT compound, min(generic) AS k FROM obs GROUP BY 1), x AS (SELECT CAST(compound AS VARCHAR) AS row_uid, k FROM s), {GROUPED.format(seed=2048)} SELECT k AS group_key, {GLABEL} AS split_label, count(*) AS n_rows FROM x JOIN g USING (k) GROUP BY 1, 2")
def generic_scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    """Compounds by the least scaffold they were seen with."""
    s = obs(spark, d).groupBy("compound").agg(F.min("generic").alias("k"))
    a = splits.group_split(s, "compound", "k", offset=23)
    return a.groupBy("group_key", "split_label").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {FACT}, x AS (SELECT a.compound, fa.n_regionkey || '__' || fb.n_regionkey AS k FROM fact a JOIN fact b ON a.compound = b.compound AND a.target < b.target JOIN nation fa ON a.target = fa.n_nationkey JOIN nation fb ON b.target = fb.n_nationkey), {GROUPED.format(seed=2062)}
SELECT k AS group_key, {GLABEL} AS split_label, count(*) AS n_rows FROM x JOIN g USING (k) GROUP BY 1, 2""")
def family_pair_split(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("target"), F.col("n_regionkey").alias("family"))
    f = fact(spark, d).join(n, "target")
    p = pairs.member_pairs(f, "compound", "target", ["family"]).withColumn("k", F.concat_ws("__", F.col("family_a").cast("string"), F.col("family_b").cast("string")))
    return splits.group_split(p, "compound", "k", offset=37).groupBy("group_key", "split_label").agg(F.count("*").alias("n_rows"))


@query(f"WITH {PLACED}, t AS (SELECT row_uid, row_number() OVER (ORDER BY row_uid) AS i FROM u WHERE {LABEL} = 'train'), z AS (SELECT unnest([50, 100, 250, 500]) AS subset_size) SELECT subset_size, row_uid FROM t, z WHERE i <= subset_size")
def low_data_subsets(spark: SparkSession, d: str) -> DataFrame:
    return splits.low_data(splits.random_split(uids(spark, d), "row_uid"), "row_uid")


@query(f"WITH {PLACED}, a AS (SELECT *, {LABEL} AS split_label FROM u) SELECT count(*) AS n_rows, count(DISTINCT compound) AS n_compounds, count(DISTINCT target) AS n_targets, " + ", ".join(f"count(*) FILTER (split_label = '{x}') AS n_{x}" for x in ("train", "valid", "test")) + " FROM a")
def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    a = splits.random_split(uids(spark, d), "row_uid")
    return a.agg(F.count("*").alias("n_rows"), F.count_distinct("compound").alias("n_compounds"), F.count_distinct("target").alias("n_targets"), *[F.count_if(F.col("split_label") == x).alias(f"n_{x}") for x in ("train", "valid", "test")])


@query(f"WITH {PLACED}, a AS (SELECT compound, {LABEL} AS split_label FROM u) SELECT compound, count(DISTINCT split_label) AS n_labels FROM a GROUP BY 1 HAVING count(DISTINCT split_label) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    return splits.leakage(splits.random_split(uids(spark, d), "row_uid"), "compound")


# A sign bit for each of the 64 entries, in two halves that fit a BIGINT.
BITS = lambda lo: f"CAST(list_sum(list_transform(range({lo}, {lo} + 32), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS BIGINT) << (i - {lo}) ELSE 0 END)) AS BIGINT)"
BOTH = "bit_count(a.b & b.b) + bit_count(a.c & b.c)"
SIMILAR = f"""e AS (SELECT vec_id AS id, label, {BITS(1)} AS b, {BITS(33)} AS c, embedding[1] AS v FROM embeddings),
s AS (SELECT a.label, a.id AS item_1, b.id AS item_2, a.v AS v1, b.v AS v2, ({BOTH}) / (bit_count(a.b) + bit_count(a.c) + bit_count(b.b) + bit_count(b.c) - ({BOTH})) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.id < b.id)"""


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Sign bits of the embeddings, and their first entry as the measured value."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", pairs.sign_bits(F.col("embedding")).alias("bits"), F.get("embedding", F.lit(0)).cast("double").alias("value"))


@query(f"WITH {SIMILAR} SELECT label, item_1, item_2, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.45")
def similar_items(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one label by Tanimoto similarity of their sign bits."""
    return rounded(pairs.similar_pairs(fingerprints(spark, d), "label", "id", "bits", 0.45))


@query(f"WITH {SIMILAR}, p AS (SELECT * FROM s WHERE similarity >= 0.45 AND abs(v1 - v2) >= 0.15), u AS (SELECT label, item_1 AS item, item_2 AS partner, similarity FROM p UNION ALL SELECT label, item_2, item_1, similarity FROM p) SELECT e.label, id AS item, count(partner) AS n_pairs, count(DISTINCT partner) AS n_partners, round(max(similarity), 6) AS most_similar, CASE WHEN count(partner) > 0 THEN 'cliff_associated' ELSE 'non_cliff' END AS subset FROM e LEFT JOIN u ON e.label = u.label AND e.id = u.item GROUP BY 1, 2")
def cliff_flags(spark: SparkSession, d: str) -> DataFrame:
    """Items with a similar partner whose value differs enough, and the others."""
    x = fingerprints(spark, d)
    flags = pairs.pair_flags(pairs.similar_pairs(x, "label", "id", "bits", 0.45, value="value", least_difference=0.15), "label")
    j = x.select("label", F.col("id").alias("item")).join(flags, ["label", "item"], "left")
    return rounded(j.withColumns({"n_pairs": F.coalesce("n_pairs", F.lit(0)), "n_partners": F.coalesce("n_partners", F.lit(0)), "subset": F.when(F.col("n_pairs").isNotNull(), "cliff_associated").otherwise("non_cliff")}))


CORR = "CASE WHEN count(*) > 1 AND min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"


def reg_sql(by: str, src: str = "predictions", where: str = "true") -> str:
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    tie = lambda c: f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{c}) - 1) / 2.0"
    return f"""SELECT {cols}count(*) AS n, round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse, round(avg(abs(observed - predicted)), 6) AS mae, round(median(abs(observed - predicted)), 6) AS median_ae,
 round(CASE WHEN min(observed) < max(observed) THEN 1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) END, 6) AS r2, round({CORR.format(a='observed', b='predicted')}, 6) AS pearson, round({CORR.format(a='ro', b='rp')}, 6) AS spearman
 FROM (SELECT *, {tie('observed')} AS ro, {tie('predicted')} AS rp FROM {src} WHERE {where}) {'GROUP BY ' + by if by else ''}"""


@query(f"WITH {PREDICTIONS} " + reg_sql("family_name, model, fold"))
def regression_by_fold(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.regression_metrics(predictions(spark, d), ["family_name", "model", "fold"]))


@query(f"WITH {PREDICTIONS} " + reg_sql("family_name, target"))
def regression_by_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.regression_metrics(predictions(spark, d), ["family_name", "target"]))


GROUPS = {"scaffold_group": "scaffold", "generic_scaffold_group": "generic", "family_group": "family", "source_group": "model", "cliff_group": "cliff"}


@query(f"WITH {PREDICTIONS}, long AS (" + " UNION ALL ".join(f"SELECT '{g}' AS group_type, CAST({c} AS VARCHAR) AS group_value, family_name, observed, predicted FROM predictions" for g, c in GROUPS.items()) + ") " + reg_sql("family_name, group_type, group_value", "long"))
def regression_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Five groupings at once, without a copy of the rows for each."""
    # The suppliers' nations fit a broadcast up to a million of them; parts meet their rows in one shuffle without sorting.
    hints = {"part": "shuffle_hash"} | ({"supplier": "broadcast"} if table(spark, d, "supplier").count() <= 1_000_000 else {})
    return rounded(groupings.regression_metrics_each(predictions(spark, d, **hints), ["family_name"], GROUPS))


@query(f"WITH {PREDICTIONS}, m AS (" + reg_sql("scaffold, family_name") + ") SELECT scaffold, family_name, n, rmse FROM m ORDER BY rmse DESC, scaffold, family_name LIMIT 15")
def worst_scaffolds(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 15 groups with the largest error."""
    m = rounded(metrics.regression_metrics(predictions(spark, d), ["scaffold", "family_name"]))
    return m.orderBy(F.desc("rmse"), "scaffold", "family_name").limit(15).select("scaffold", "family_name", "n", "rmse")


@query(f"WITH {PREDICTIONS} SELECT compound, count(*) AS n, round(avg(abs(observed - predicted)), 6) AS mean_error FROM predictions GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 100")
def hardest_compounds(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).groupBy("compound").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("observed") - F.col("predicted"))), 6).alias("mean_error"))
    return p.orderBy(F.desc("mean_error"), "compound").limit(100)


def cls_sql(undefined: str) -> str:
    return f"""c AS (SELECT family_name, model, count(*) FILTER (chance >= 0.5 AND positive = 1) AS tp, count(*) FILTER (chance < 0.5 AND positive = 0) AS tn, count(*) FILTER (chance >= 0.5 AND positive = 0) AS fp, count(*) FILTER (chance < 0.5 AND positive = 1) AS fn FROM predictions GROUP BY 1, 2)
SELECT family_name, model, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), {undefined}), 6) AS f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), {undefined}), 6) AS mcc FROM c"""


@query(f"WITH {PREDICTIONS}, {cls_sql('0')}")
def classification_by_model(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.classification_metrics(predictions(spark, d), ["family_name", "model"], "positive", "chance"))


CURVE = """k AS (SELECT family_name, chance, sum(positive) AS p, sum(1 - positive) AS n FROM predictions GROUP BY 1, 2),
q AS (SELECT family_name, chance, p, n, sum(p) OVER w / sum(p) OVER a AS tpr, sum(n) OVER w / sum(n) OVER a AS fpr, sum(p) OVER w / (sum(p) OVER w + sum(n) OVER w) AS precision FROM k WINDOW w AS (PARTITION BY family_name ORDER BY chance DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY family_name))"""


@query(f"WITH {PREDICTIONS}, {CURVE} SELECT family_name, round(chance, 6) AS threshold, CAST(p AS BIGINT) AS p, CAST(n AS BIGINT) AS n, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM q")
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return rounded(metrics.curve(p, ["family_name"], "positive", "chance"))


@query(f"""WITH {PREDICTIONS}, {CURVE}, z AS (SELECT *, coalesce(lag(tpr) OVER w, 0) AS t0, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(precision) OVER w, 1) AS p0 FROM q WINDOW w AS (PARTITION BY family_name ORDER BY chance DESC))
SELECT family_name, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS roc_auc, round(sum((tpr - t0) * precision), 6) AS average_precision, round(sum((tpr - t0) * (precision + p0) / 2), 6) AS pr_auc FROM z GROUP BY 1""")
def ranking_quality(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return rounded(metrics.ranking_quality(p, ["family_name"], "positive", "chance"))


FOLDS = f"{PREDICTIONS}, folds AS (" + reg_sql("family_name, model, fold") + ")"


def folds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.regression_metrics(predictions(spark, d), ["family_name", "model", "fold"]))


@query(f"WITH {FOLDS} SELECT family_name, model, count(*) AS n_rows, " + ", ".join(f"count({m}) AS {m}_n, round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(stddev_samp({m}) / sqrt(count({m})), 6) AS {m}_sem, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max, round(median({m}), 6) AS {m}_median" for m in ("rmse", "mae")) + " FROM folds GROUP BY 1, 2")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(measures.summarize(folds(spark, d), ["family_name", "model"], ["rmse", "mae"]))


MEANS = f"{FOLDS}, s AS (SELECT family_name, model, fold % 2 AS split, round(avg(rmse), 7) AS rmse, count(*) AS n FROM folds GROUP BY 1, 2, 3)"


def means(spark: SparkSession, d: str) -> DataFrame:
    f = folds(spark, d).withColumn("split", F.col("fold") % 2)
    return f.groupBy("family_name", "model", "split").agg(F.round(F.avg("rmse"), 7).alias("rmse"), F.count("*").alias("n"))


@query(f"WITH {MEANS} SELECT *, dense_rank() OVER (PARTITION BY split ORDER BY rmse) AS rank FROM s")
def ranked_models(spark: SparkSession, d: str) -> DataFrame:
    return means(spark, d).withColumn("rank", F.dense_rank().over(W.partitionBy("split").orderBy("rmse")).cast("long"))


@query(f"WITH {MEANS}, b AS (SELECT *, row_number() OVER (PARTITION BY split, family_name ORDER BY rmse, model) AS i FROM s) SELECT family_name, model, split, rmse, n FROM b WHERE i = 1")
def best_models(spark: SparkSession, d: str) -> DataFrame:
    return windows.keep_first(means(spark, d), ["split", "family_name"], [F.col("rmse"), F.col("model")])


def improvement(candidate: Column, baseline: Column, lower_is_better: bool = True) -> Column:
    """Signed percentage; positive is better; null where the baseline is 0."""
    gain = baseline - candidate if lower_is_better else candidate - baseline
    return 100 * F.try_divide(gain, F.abs(baseline))


@query(f"""WITH {MEANS}, c AS (SELECT split, model AS cm, rmse AS c FROM s WHERE family_name = 'causal' QUALIFY row_number() OVER (PARTITION BY split ORDER BY rmse, model) = 1), b AS (SELECT split, family_name AS bf, model AS bm, rmse AS b FROM s WHERE family_name <> 'causal' QUALIFY row_number() OVER (PARTITION BY split ORDER BY rmse, family_name, model) = 1)
SELECT split, cm AS causal_model, c AS causal_rmse, bf AS baseline_family, bm AS baseline_model, b AS baseline_rmse, round(c - b, 7) AS difference, round(100 * (b - c) / abs(b), 4) AS improvement FROM c JOIN b USING (split)""")
def causal_against_baseline(spark: SparkSession, d: str) -> DataFrame:
    m = means(spark, d)
    c = windows.keep_first(m.where("family_name = 'causal'"), ["split"], [F.col("rmse"), F.col("model")]).select("split", F.col("model").alias("causal_model"), F.col("rmse").alias("causal_rmse"))
    b = windows.keep_first(m.where("family_name <> 'causal'"), ["split"], [F.col("rmse"), F.col("family_name"), F.col("model")]).select("split", F.col("family_name").alias("baseline_family"), F.col("model").alias("baseline_model"), F.col("rmse").alias("baseline_rmse"))
    return c.join(b, "split").withColumns({"difference": F.round(F.col("causal_rmse") - F.col("baseline_rmse"), 7), "improvement": F.round(improvement(F.col("causal_rmse"), F.col("baseline_rmse")), 4)})


@query(f"WITH {MEANS} SELECT a.family_name, a.model, a.split, a.rmse, b.rmse AS reference_rmse, round(a.rmse - b.rmse, 7) AS degradation, round(100 * (b.rmse - a.rmse) / abs(b.rmse), 4) AS improvement FROM s a JOIN s b ON a.family_name = b.family_name AND a.model = b.model AND b.split = 0 WHERE a.split <> 0")
def split_degradation(spark: SparkSession, d: str) -> DataFrame:
    """Every split against the reference split of the same model."""
    m = means(spark, d)
    ref = m.where("split = 0").select("family_name", "model", F.col("rmse").alias("reference_rmse"))
    return m.where("split <> 0").join(ref, ["family_name", "model"]).select("family_name", "model", "split", "rmse", "reference_rmse", F.round(F.col("rmse") - F.col("reference_rmse"), 7).alias("degradation"), F.round(improvement(F.col("rmse"), F.col("reference_rmse")), 4).alias("improvement"))


@query(f"WITH {MEANS}, m AS (SELECT split, model, rmse AS main FROM s WHERE family_name = 'causal') SELECT split, model, family_name AS ablation, rmse, round(rmse - main, 7) AS drop, dense_rank() OVER (PARTITION BY split, model ORDER BY rmse - main DESC) AS rank FROM s JOIN m USING (split, model) WHERE family_name <> 'causal'")
def ablations(spark: SparkSession, d: str) -> DataFrame:
    m = means(spark, d)
    main = m.where("family_name = 'causal'").select("split", "model", F.col("rmse").alias("main"))
    j = m.where("family_name <> 'causal'").join(main, ["split", "model"])
    return j.select("split", "model", F.col("family_name").alias("ablation"), "rmse", F.round(F.col("rmse") - F.col("main"), 7).alias("drop"), F.dense_rank().over(W.partitionBy("split", "model").orderBy((F.col("rmse") - F.col("main")).desc())).cast("long").alias("rank"))


@query(f"""WITH {FOLDS}, f AS (SELECT family_name || '/' || model AS m, fold, rmse FROM folds), d AS (SELECT a.m AS model_a, b.m AS model_b, a.rmse - b.rmse AS d FROM f a JOIN f b ON a.fold = b.fold AND a.m < b.m)
SELECT model_a, model_b, count(*) AS n, round(avg(d), 5) AS mean_difference, round(stddev_samp(d), 5) AS sd, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 2) AS t, count(*) - 1 AS df FROM d GROUP BY 1, 2""")
def paired_models(spark: SparkSession, d: str) -> DataFrame:
    f = folds(spark, d).select("fold", F.concat_ws("/", "family_name", "model").alias("m"), "rmse")
    return metrics.paired_t(f, ["fold"], "m", "rmse").withColumns({"mean_difference": F.round("mean_difference", 5), "sd": F.round("sd", 5), "t": F.round("t", 2)})


@query()
def paired_p_values(spark: SparkSession, d: str) -> DataFrame:
    """With two-sided p values; DuckDB has no t distribution, so this one is tested against known values."""
    return paired_models(spark, d).withColumn("p", metrics.t_p_value(F.col("t"), F.col("df").cast("double")))


@query(f"""WITH {PREDICTIONS}, r AS ({reg_sql('family_name, model, cliff')}) SELECT a.family_name, a.model, a.rmse AS cliff_rmse, b.rmse AS other_rmse, round(a.rmse - b.rmse, 6) AS degradation FROM r a JOIN r b ON a.family_name = b.family_name AND a.model = b.model AND a.cliff = 1 AND b.cliff = 0""")
def cliff_degradation(spark: SparkSession, d: str) -> DataFrame:
    m = rounded(metrics.regression_metrics(predictions(spark, d), ["family_name", "model", "cliff"]))
    w = m.groupBy("family_name", "model").agg(F.max(F.when(F.col("cliff") == 1, F.col("rmse"))).alias("cliff_rmse"), F.max(F.when(F.col("cliff") == 0, F.col("rmse"))).alias("other_rmse"))
    return w.withColumn("degradation", F.round(F.col("cliff_rmse") - F.col("other_rmse"), 6))


@query(f"""WITH {PREDICTIONS}, e AS (SELECT family_name, target, avg((observed - predicted) ** 2) AS mse FROM predictions GROUP BY 1, 2 HAVING count(*) >= 2), c AS (SELECT family_name, avg(abs(observed - predicted)) FILTER (cliff = 1) AS cliff_mae, count(*) FILTER (positive = 0) / count(*) FILTER (positive = 1) AS positive_weight FROM predictions GROUP BY 1)
SELECT e.family_name, round(var_pop(mse), 6) AS invariance, count(*) AS n_environments, round(any_value(cliff_mae), 6) AS cliff_mae, round(any_value(positive_weight), 6) AS positive_weight FROM e JOIN c ON e.family_name = c.family_name GROUP BY 1""")
def environment_penalties(spark: SparkSession, d: str) -> DataFrame:
    """Variance over environments of their mean squared error, error on cliff rows, and the class weight."""
    p = predictions(spark, d)
    e = p.groupBy("family_name", "target").agg(F.avg(F.pow(F.col("observed") - F.col("predicted"), 2)).alias("mse"), F.count("*").alias("n")).where("n >= 2")
    e = e.groupBy("family_name").agg(F.var_pop("mse").alias("invariance"), F.count("*").alias("n_environments"))
    c = p.groupBy("family_name").agg(F.avg(F.when(F.col("cliff") == 1, F.abs(F.col("observed") - F.col("predicted")))).alias("cliff_mae"), F.try_divide(F.count_if(F.col("positive") == 0), F.count_if(F.col("positive") == 1)).alias("positive_weight"))
    return rounded(e.join(c, "family_name"))


@query(f"WITH {PREDICTIONS} SELECT target, count(*) AS n, round(regr_slope(observed, predicted), 5) AS slope, round(regr_intercept(observed, predicted), 5) AS intercept FROM predictions WHERE fold <> 0 GROUP BY 1 HAVING count(*) >= 10")
def line_per_target(spark: SparkSession, d: str) -> DataFrame:
    """One least-squares line per target with enough training rows, in one aggregation for all targets."""
    p = predictions(spark, d).where("fold <> 0").groupBy("target").agg(F.count("*").alias("n"), F.regr_slope("observed", "predicted").alias("slope"), F.regr_intercept("observed", "predicted").alias("intercept"))
    return rounded(p.where("n >= 10"), 5)


@query("SELECT e.event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.8), 6) AS q80 FROM events e GROUP BY 1")
def upper_quantile(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.percentile("value", F.lit(0.8)).alias("q80")))


@query(f"WITH {MEANS} SELECT split, " + ", ".join(f"max(CASE WHEN family_name = '{f}' THEN rmse END) AS {f}" for f in ("classical", "deep", "causal")) + " FROM s GROUP BY 1")
def family_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return means(spark, d).groupBy("split").pivot("family_name", ["classical", "deep", "causal"]).agg(F.max("rmse"))


@query(f"WITH {FOLDS}, l AS (UNPIVOT folds ON rmse, mae, median_ae INTO NAME metric VALUE v) SELECT family_name, metric, count(*) AS n, round(median(v), 5) AS median FROM l GROUP BY 1, 2")
def melted_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = folds(spark, d).unpivot(["family_name"], ["rmse", "mae", "median_ae"], "metric", "v")
    return rounded(f.groupBy("family_name", "metric").agg(F.count("*").alias("n"), F.median("v").alias("median")), 5)


@query(f"WITH {PREDICTIONS} SELECT family_name, count(*) AS n, round(avg(observed), 6) AS mean, round(stddev_samp(observed), 6) AS std, round(min(observed), 6) AS min, round(quantile_cont(observed, 0.25), 6) AS q25, round(quantile_cont(observed, 0.5), 6) AS q50, round(quantile_cont(observed, 0.75), 6) AS q75, round(max(observed), 6) AS max FROM predictions GROUP BY 1")
def family_boxes(spark: SparkSession, d: str) -> DataFrame:
    q = [F.percentile("observed", F.lit(x)).alias(f"q{int(x * 100)}") for x in (0.25, 0.5, 0.75)]
    return rounded(predictions(spark, d).groupBy("family_name").agg(F.count("*").alias("n"), F.avg("observed").alias("mean"), F.stddev_samp("observed").alias("std"), F.min("observed").alias("min"), *q, F.max("observed").alias("max")))


@query(f"WITH {FOLDS}, t AS (SELECT family_name, model, fold, CASE WHEN rmse > 0 THEN mae END AS a, r2 AS b FROM folds) SELECT family_name, arg_min(a, struct_pack(m := model, f := fold)) AS first_mae, arg_min(b, struct_pack(m := model, f := fold)) AS first_r2 FROM t GROUP BY 1")
def first_metric(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_non_null(folds(spark, d), ["family_name"], ["model", "fold"], ["mae", "r2"]).withColumnsRenamed({"mae": "first_mae", "r2": "first_r2"})


@query("""WITH r AS (SELECT 'low_' || o_orderpriority AS s, o_totalprice AS v FROM orders) SELECT CAST(nullif(regexp_extract(s, '(\\d+)', 1), '') AS INTEGER) AS size, count(*) AS n, round(avg(v), 4) AS mean FROM r WHERE starts_with(s, 'low') GROUP BY 1""")
def low_data_curve(spark: SparkSession, d: str) -> DataFrame:
    """The first whole number in a name is the size of its subset."""
    o = table(spark, d, "orders").select(F.concat(F.lit("low_"), "o_orderpriority").alias("s"), "o_totalprice").where(F.col("s").startswith("low"))
    return o.groupBy(F.nullif(F.regexp_extract("s", "(\\d+)", 1), F.lit("")).try_cast("int").alias("size")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


ALL_RESULTS = [("regression", "rmse"), ("regression", "mae")]


@query(f"WITH {FOLDS} " + " UNION ALL ".join(f"SELECT '{t}' AS task, '{m}' AS metric, family_name, model, fold, {m} AS v FROM folds" for t, m in ALL_RESULTS))
def union_of_results(spark: SparkSession, d: str) -> DataFrame:
    f = folds(spark, d)
    return reduce(DataFrame.unionByName, [f.select(F.lit(t).alias("task"), F.lit(m).alias("metric"), "family_name", "model", "fold", F.col(m).alias("v")) for t, m in ALL_RESULTS])
