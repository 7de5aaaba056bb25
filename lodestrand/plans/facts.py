"""Queries on extraction, curation, aggregation, panels and annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANKS, PLACEHOLDERS, key, present, stripped
from ..operators import clean, labels, measures, windows
from ..operators.measures import known
from ..session import table
from .bindings import FACT, OBS, fact, obs

QUERIES: dict = {}
SQL: dict = {}
B = "concat(" + ", ".join(f"chr({ord(c)})" for c in BLANKS) + ")"
WORDS = ", ".join(f"'{w}'" for w in PLACEHOLDERS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: measures.round_half_away(F.col(c), 6) for c in cols})


STAGES = (("A", "l_quantity > 0"), ("B", "l_returnflag <> 'N'"), ("C", "l_discount <= 0.05"), ("D", "l_extendedprice > 0"), ("E", "o_orderstatus <> 'P'"), ("F", "p_size >= 10"), ("G", "c_acctbal > 0"))


@query("WITH j AS (SELECT *, s_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey) "
       + " UNION ALL ".join(f"SELECT '{n}' AS stage, count(*) AS n_rows, count(DISTINCT t) AS n_targets FROM j WHERE " + " AND ".join(p for _, p in STAGES[: i + 1]) for i, (n, _) in enumerate(STAGES)))
def extraction_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows and targets left after each of seven cumulative predicates, in one pass over the joined tables."""
    li, o, p, s, c = (table(spark, d, t) for t in ("lineitem", "orders", "part", "supplier", "customer"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).join(c, o.o_custkey == c.c_custkey)
    upto = [reduce(lambda a, b: a & b, [F.expr(x) for _, x in STAGES[: i + 1]]) for i in range(len(STAGES))]
    per = j.groupBy(F.col("s_nationkey").alias("t")).agg(*[F.count_if(u).alias(f"n{i}") for i, u in enumerate(upto)])
    one = per.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(STAGES))], *[F.count_if(F.col(f"n{i}") > 0).alias(f"t{i}") for i in range(len(STAGES))])
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(f"n{i}").alias("n_rows"), F.col(f"t{i}").alias("n_targets")) for i, (n, _) in enumerate(STAGES)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query("""SELECT r_name, n_name, p_brand, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, CAST(sum(l_quantity) AS DOUBLE) AS quantity
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE l_returnflag = 'R' AND p_size > 5 AND o_orderstatus <> 'P' GROUP BY 1, 2, 3""")
def six_way_join(spark: SparkSession, d: str) -> DataFrame:
    """The flagship extraction: six tables, filters pushed to the scans, small dimensions chosen for broadcast by size."""
    r, n, s, li, o, p = (table(spark, d, t) for t in ("region", "nation", "supplier", "lineitem", "orders", "part"))
    j = (
        li.where("l_returnflag = 'R'").join(o.where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).join(p.where("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"))
        .join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return j.groupBy("r_name", "n_name", "p_brand").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"), F.sum("l_quantity").alias("quantity"))


@query(f"""WITH t AS (SELECT chembl_id FROM target_dictionary WHERE lower(coalesce(pref_name, '')) LIKE '%kinase%' UNION SELECT chembl_id FROM target_dictionary WHERE lower(coalesce(kinase_family, '')) <> ''),
m AS (SELECT upper(trim(target_chembl_id, {B})) AS t FROM curated_measurements) SELECT t AS target, count(*) AS n_rows FROM m WHERE t IN (SELECT chembl_id FROM t) GROUP BY 1""")
def classified_targets(spark: SparkSession, d: str) -> DataFrame:
    """Measurements of targets classified by name or by family: a distinct union as a semi-join set."""
    t = table(spark, d, "target_dictionary")
    by_name = t.where(F.lower(F.coalesce("pref_name", F.lit(""))).contains("kinase")).select("chembl_id")
    chosen = by_name.union(t.where(F.lower(F.coalesce("kinase_family", F.lit(""))) != "").select("chembl_id")).distinct()
    m = table(spark, d, "curated_measurements").select(F.upper(stripped(F.col("target_chembl_id"))).alias("target"))
    return m.join(chosen, m.target == chosen.chembl_id, "left_semi").groupBy("target").agg(F.count("*").alias("n_rows"))


@query(f"""SELECT coalesce(nullif(upper(trim(target_type, {B})), ''), '<missing>') AS kind, coalesce(nullif(lower(trim(organism, {B})), ''), '<missing>') AS organism, count(*) AS n FROM target_dictionary GROUP BY 1, 2""")
def endpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "target_dictionary")
    m = F.lit("<missing>")
    return t.groupBy(F.coalesce(F.upper(present(F.col("target_type"))), m).alias("kind"), F.coalesce(F.lower(present(F.col("organism"))), m).alias("organism")).agg(F.count("*").alias("n"))


PRESENT = lambda c, words=False: f"CASE WHEN NOT (trim({c}, {B}) = ''{f' OR lower(trim({c}, {B})) IN ({WORDS})' if words else ''}) THEN trim({c}, {B}) END"
CURATE = f"""c AS (SELECT *, upper({PRESENT('target_chembl_id', True)}) AS t, upper({PRESENT('compound_id', True)}) AS c, {PRESENT('standardized_smiles')} AS s FROM curated_measurements)"""


@query(f"""WITH {CURATE} SELECT coalesce(CASE WHEN s IS NULL THEN 'missing_structure' WHEN t IS NULL THEN 'missing_target' WHEN median_ki_nM IS NULL OR isnan(median_ki_nM) THEN 'missing_value' WHEN median_ki_nM <= 0 THEN 'not_positive'
WHEN contains(s, '.') THEN 'mixture' WHEN length(s) < 60 THEN 'too_small' END, 'kept') AS reason, count(*) AS n, count(DISTINCT curation_source) AS n_sources FROM c GROUP BY 1""")
def curation_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules, the first that holds names the reason."""
    m = table(spark, d, "curated_measurements").withColumns({"s": present(F.col("standardized_smiles")), "t": key(F.col("target_chembl_id")), "v": known("median_ki_nM")})
    rules = [
        ("missing_structure", F.col("s").isNull()), ("missing_target", F.col("t").isNull()), ("missing_value", F.col("v").isNull()), ("not_positive", F.col("v") <= 0),
        ("mixture", F.col("s").contains(".")), ("too_small", F.length("s") < 60),
    ]
    return m.groupBy(F.coalesce(clean.first_reason(rules), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("curation_source").alias("n_sources"))


@query(f"WITH {OBS} SELECT compound, target, count(*) AS n_records, median(ki) AS median_ki, round(median(pki), 6) AS median_pki, round(stddev_samp(pki), 6) AS std_pki, count(DISTINCT assay) AS n_assays, count(DISTINCT source) AS n_sources, count(*) > 1 AS is_duplicate FROM obs GROUP BY 1, 2")
def dup_aggregate(spark: SparkSession, d: str) -> DataFrame:
    f = measures.aggregate_duplicates(obs(spark, d).where("ki > 0"), ["compound", "target"], "ki", "pki", {"n_assays": "assay", "n_sources": "source"})
    return r6(f, "median_pki", "std_pki")


@query(f"""WITH {CURATE} SELECT s AS structure, t AS target, count(*) AS n_records, median(CASE WHEN NOT isnan(median_ki_nM) THEN median_ki_nM END) AS median_ki, round(median(CASE WHEN NOT isnan(pKi) THEN pKi END), 6) AS median_pki,
round(stddev_samp(CASE WHEN NOT isnan(pKi) THEN pKi END), 6) AS std_pki, count(DISTINCT c) AS n_compounds, count(*) > 1 AS is_duplicate FROM c WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2""")
def curated_duplicates(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "curated_measurements").select(
        present(F.col("standardized_smiles")).alias("structure"), key(F.col("target_chembl_id")).alias("target"), key(F.col("compound_id")).alias("c"), known("median_ki_nM").alias("ki"), known("pKi").alias("pki")
    ).where("structure IS NOT NULL AND target IS NOT NULL")
    return r6(measures.aggregate_duplicates(m, ["structure", "target"], "ki", "pki", {"n_compounds": "c"}), "median_pki", "std_pki")


PANEL = f"WITH {FACT}, s AS (SELECT target, count(*) AS n_records, count(DISTINCT compound) AS n_compounds, round(median(pki), 6) AS median, round(coalesce(stddev_samp(pki), 0), 6) AS std, CAST(sum(n) AS BIGINT) AS support FROM fact GROUP BY 1)"


@query(PANEL + " SELECT *, CASE WHEN n_records < 1280 THEN concat_ws(';', CASE WHEN n_compounds < 1280 THEN 'too_few_compounds' END, 'too_few_records') ELSE coalesce(CASE WHEN n_compounds < 1280 THEN 'too_few_compounds' END, '') END AS reasons, n_records >= 1280 AND n_compounds >= 1280 AS kept FROM s")
def panel_selection(spark: SparkSession, d: str) -> DataFrame:
    s = measures.target_summary(fact(spark, d), "target", "compound", "pki", "n")
    return r6(measures.panel(s, 1280, 1280), "median", "std")


@query(f"WITH {FACT} SELECT compound, count(*) AS n_targets, round(min(pki), 6) AS least, round(max(pki), 6) AS most, round(median(pki), 6) AS median FROM fact GROUP BY 1 HAVING count(DISTINCT target) >= 15")
def wide_compounds(spark: SparkSession, d: str) -> DataFrame:
    f = measures.with_min_targets(fact(spark, d), "compound", "target", 15)
    return r6(f.groupBy("compound").agg(F.count("*").alias("n_targets"), F.min("pki").alias("least"), F.max("pki").alias("most"), F.median("pki").alias("median")), "least", "most", "median")


@query(f"WITH {FACT} SELECT count(DISTINCT compound) AS n_rows, count(DISTINCT target) AS n_columns, count(*) AS observed, count(*) / (count(DISTINCT compound) * count(DISTINCT target)) AS density FROM fact")
def matrix_density(spark: SparkSession, d: str) -> DataFrame:
    return measures.density(fact(spark, d), "compound", "target")


@query(f"WITH {FACT} SELECT compound, " + ", ".join(f"round(max(CASE WHEN target = {t} THEN pki END), 6) AS t{t}, CAST(count(CASE WHEN target = {t} THEN 1 END) AS INTEGER) AS m{t}" for t in range(25)) + " FROM fact GROUP BY 1")
def panel_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Wide matrix and 0/1 mask over the given targets; the long form stays the canonical one."""
    w = measures.matrix(fact(spark, d), "compound", "target", "pki", range(25))
    return w.select("compound", *[F.round(f"t{t}", 6).alias(f"t{t}") for t in range(25)], *[F.col(f"t{t}").isNotNull().cast("int").alias(f"m{t}") for t in range(25)])


OVERLAP = "WITH {base}, c AS (SELECT DISTINCT {i} AS i, {g} AS g FROM {t}), n AS (SELECT g, count(*) AS n FROM c GROUP BY 1), p AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM c x JOIN c y USING (i) GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard, round(shared / least(x.n, y.n), 6) AS coefficient FROM p JOIN n x ON a = x.g JOIN n y ON b = y.g"


@query(OVERLAP.format(base=FACT, i="compound", g="target", t="fact"))
def panel_overlap(spark: SparkSession, d: str) -> DataFrame:
    return r6(measures.overlap(fact(spark, d), "compound", "target"), "jaccard", "coefficient")


@query(OVERLAP.format(base=f"e AS (SELECT {PRESENT('murcko_scaffold', True)} AS m, source_library_name FROM environment_features)", i="m", g="source_library_name", t="e WHERE m IS NOT NULL"))
def library_overlap(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("m"), "source_library_name").where("m IS NOT NULL")
    return r6(measures.overlap(e, "m", "source_library_name"), "jaccard", "coefficient")


@query(f"""WITH e AS (SELECT screening_compound_id AS id, {PRESENT('murcko_scaffold', True)} AS m FROM environment_features), f AS (SELECT m, count(*) AS n FROM e GROUP BY 1)
SELECT id, e.m AS scaffold, n AS frequency, CASE WHEN n <= 1 THEN 'singleton' WHEN n <= 5 THEN 'rare' WHEN n <= 20 THEN 'common' ELSE 'frequent' END AS bin, n = 1 AS rare_flag FROM e JOIN f ON e.m IS NOT DISTINCT FROM f.m""")
def scaffold_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Group sizes back on the rows: aggregated first and joined by a null-safe key, so a hot scaffold is not gathered."""
    e = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("id"), present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("scaffold"))
    f = e.groupBy(F.col("scaffold").alias("s")).agg(F.count("*").alias("frequency"))
    j = e.join(f, F.col("scaffold").eqNullSafe(F.col("s"))).drop("s")
    return j.withColumns({"bin": labels.frequency_bin(F.col("frequency"), (1, 5, 20)), "rare_flag": F.col("frequency") == 1})


@query(f"""WITH r AS (SELECT kinase_family, pref_name, organism, tid, CASE WHEN trim(pref_name) <> '' THEN tid END AS k1, CASE WHEN trim(organism) <> '' THEN tid END AS k2 FROM target_dictionary)
SELECT kinase_family, count(*) AS n, arg_min(pref_name, k1) AS first_name, arg_min(organism, k2) AS first_organism FROM r GROUP BY 1""")
def first_nonblank(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "target_dictionary")
    f = measures.first_present(t.withColumn("f", F.coalesce("kinase_family", F.lit("\0"))), "f", ["tid"], ["pref_name", "organism"])
    n = t.groupBy("kinase_family").agg(F.count("*").alias("n"))
    return n.join(f, F.coalesce("kinase_family", F.lit("\0")) == F.col("f")).select("kinase_family", "n", F.col("pref_name").alias("first_name"), F.col("organism").alias("first_organism"))


@query(f"WITH {OBS}, g AS (SELECT source, model, target, count(*) AS n_rows, count(DISTINCT compound) AS n_compounds FROM obs GROUP BY 1, 2, 3) SELECT *, CAST(sum(n_rows) OVER (PARTITION BY source) AS BIGINT) AS source_rows, count(*) OVER (PARTITION BY source, model) AS source_targets FROM g")
def source_environments(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    g = obs(spark, d).groupBy("source", "model", "target").agg(F.count("*").alias("n_rows"), F.count_distinct("compound").alias("n_compounds"))
    return g.withColumns({"source_rows": F.sum("n_rows").over(W.partitionBy("source")), "source_targets": F.count("*").over(W.partitionBy("source", "model"))})


@query(f"WITH {OBS} SELECT compound, target, count(DISTINCT assay) AS n_assays, count(DISTINCT CASE WHEN source <> 'N' THEN source END) AS n_sources, count(DISTINCT assay) > 1 AS several_assays, count(DISTINCT CASE WHEN source <> 'N' THEN source END) > 1 AS several_sources FROM obs GROUP BY 1, 2")
def pair_support(spark: SparkSession, d: str) -> DataFrame:
    g = obs(spark, d).groupBy("compound", "target").agg(F.count_distinct("assay").alias("n_assays"), F.count_distinct(F.when(F.col("source") != "N", F.col("source"))).alias("n_sources"))
    return g.withColumns({"several_assays": F.col("n_assays") > 1, "several_sources": F.col("n_sources") > 1})


@query(f"""WITH {FACT}, cs AS (SELECT p_partkey AS compound, p_brand AS scaffold, count(*) OVER (PARTITION BY p_brand) AS scaffold_size FROM part), ts AS (SELECT target, count(DISTINCT compound) AS target_compounds FROM fact GROUP BY 1), cf AS (SELECT compound, count(*) AS compound_targets FROM fact GROUP BY 1)
SELECT compound, target, round(pki, 6) AS pki, n, scaffold, scaffold_size, n_name AS target_name, n_regionkey AS family, target_compounds, compound_targets FROM fact JOIN cs USING (compound) JOIN nation ON target = n_nationkey JOIN ts USING (target) JOIN cf USING (compound)""")
def annotated_long(spark: SparkSession, d: str) -> DataFrame:
    """The fact with compound, target and pair annotation."""
    f, p, n = fact(spark, d), table(spark, d, "part"), table(spark, d, "nation")
    size = p.groupBy("p_brand").agg(F.count("*").alias("scaffold_size"))
    comp = p.join(size, "p_brand").select(F.col("p_partkey").alias("compound"), F.col("p_brand").alias("scaffold"), "scaffold_size")
    ts = f.groupBy("target").agg(F.count_distinct("compound").alias("target_compounds"))
    cf = f.groupBy("compound").agg(F.count("*").alias("compound_targets"))
    tgt = n.select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("target_name"), F.col("n_regionkey").alias("family"))
    return f.join(comp, "compound").join(tgt, "target").join(ts, "target").join(cf, "compound").select("compound", "target", F.round("pki", 6).alias("pki"), "n", "scaffold", "scaffold_size", "target_name", "family", "target_compounds", "compound_targets")


DESC = "SELECT '{c}' AS column_name, count({v}) AS n, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(stddev_pop({v}), 6) AS std FROM curated_measurements"


@query(" UNION ALL ".join(DESC.format(c=c, v=f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END") for c in ("pKi", "median_ki_nM", "pKi_std", "n_source_records")))
def numeric_description(spark: SparkSession, d: str) -> DataFrame:
    return r6(measures.describe(table(spark, d, "curated_measurements"), ["pKi", "median_ki_nM", "pKi_std", "n_source_records"]), "min", "max", "mean", "median", "std")


@query("SELECT 'source' AS field, coalesce(curation_source, 'missing') AS value, count(*) AS n FROM curated_measurements GROUP BY 2 UNION ALL SELECT 'duplicate', coalesce(CAST(is_duplicate_measurement AS VARCHAR), 'missing'), count(*) FROM curated_measurements GROUP BY 2")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "curated_measurements")
    a = measures.value_counts(m, "curation_source").select(F.lit("source").alias("field"), "value", "n")
    return a.unionByName(measures.value_counts(m, "is_duplicate_measurement").select(F.lit("duplicate").alias("field"), "value", "n"))


@query(f"""WITH s AS (SELECT *, lower({PRESENT('split_strategy')}) AS st FROM split_assignments) SELECT task_name, st AS strategy, count(*) AS n_rows, count(DISTINCT upper({PRESENT('compound_id', True)})) AS n_compounds, count(DISTINCT upper({PRESENT('target_chembl_id', True)})) AS n_targets,
count(*) FILTER (pKi IS NULL OR isnan(pKi)) AS n_missing FROM s GROUP BY 1, 2""")
def task_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "split_assignments")
    return s.groupBy("task_name", F.lower(present(F.col("split_strategy"))).alias("strategy")).agg(
        F.count("*").alias("n_rows"), F.count_distinct(key(F.col("compound_id"))).alias("n_compounds"), F.count_distinct(key(F.col("target_chembl_id"))).alias("n_targets"), F.count_if(known("pKi").isNull()).alias("n_missing")
    )


@query(f"""WITH {CURATE}, k AS (SELECT c, t, count(*) AS n FROM c WHERE c IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2)
SELECT (SELECT count(*) FROM c) AS n_rows, (SELECT count(*) FROM c WHERE c IS NULL OR t IS NULL) AS n_missing, (SELECT count(*) FROM k WHERE n > 1) AS n_repeated_keys""")
def key_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rows without a whole key, and keys that stand in several rows."""
    m = table(spark, d, "curated_measurements").select(key(F.col("compound_id")).alias("c"), key(F.col("target_chembl_id")).alias("t"))
    return clean.key_report(m, ["c", "t"]).select("n_rows", "n_missing", "n_repeated_keys")


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS in_both, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k""")
def key_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Whether two sources hold the same keys: one full outer join instead of reading them in step."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("j")).distinct()
    return a.join(b, F.col("k") == F.col("j"), "full").agg(F.count_if(F.col("k").isNotNull() & F.col("j").isNotNull()).alias("in_both"), F.count_if(F.col("j").isNull()).alias("only_left"), F.count_if(F.col("k").isNull()).alias("only_right"))


@query(f"""WITH e AS (SELECT screening_compound_id AS id, {PRESENT('standardized_smiles')} AS s, source_library_name AS lib FROM environment_features)
SELECT lib, s AS structure, count(*) AS n_rows, min(id) AS kept, string_agg(id, '|' ORDER BY id) AS all_ids, coalesce(array_to_string(list_sort(list(id))[2:], '|'), '') AS collapsed FROM e WHERE s IS NOT NULL GROUP BY 1, 2""")
def within_library_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("id"), present(F.col("standardized_smiles")).alias("structure"), F.col("source_library_name").alias("lib")).where("structure IS NOT NULL")
    return clean.collapse_within(e, ["lib", "structure"], "id", "id")


@query(f"""WITH e AS (SELECT screening_compound_id AS item, {PRESENT('standardized_smiles')} AS structure, source_library_name AS lib FROM environment_features), g AS (SELECT structure, count(*) AS n_rows, count(DISTINCT lib) AS n_sources, min(item) AS f FROM e GROUP BY 1)
SELECT e.structure, lib, item, n_rows, n_sources, n_sources > 1 AS across, item = f AS is_first FROM e JOIN g USING (structure)""")
def cross_library_duplicates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "environment_features").select(F.col("screening_compound_id").alias("item"), present(F.col("standardized_smiles")).alias("structure"), F.col("source_library_name").alias("lib"))
    return clean.cross_source(e, "structure", "lib", "item")


LIB_RULES = f"""CASE WHEN {PRESENT('standardized_smiles')} IS NULL THEN 'missing_structure' WHEN rdkit_parse_success IS DISTINCT FROM true THEN 'parse_failed' WHEN heavy_atom_count < 20 THEN 'too_few_atoms' WHEN molecular_weight > 900 THEN 'too_heavy' END"""


@query(f"WITH e AS (SELECT source_library_name AS lib, {LIB_RULES} AS r FROM environment_features) SELECT lib, count(*) AS n_input, count(r) AS n_failed, count(*) - count(r) AS n_kept, " + ", ".join(f"count(*) FILTER (r = '{x}') AS {x}" for x in ("missing_structure", "parse_failed", "too_few_atoms", "too_heavy")) + " FROM e GROUP BY 1")
def library_quality(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each first reason per library."""
    names = ("missing_structure", "parse_failed", "too_few_atoms", "too_heavy")
    rules = list(zip(names, (present(F.col("standardized_smiles")).isNull(), ~F.col("rdkit_parse_success").eqNullSafe(True), F.col("heavy_atom_count") < 20, F.col("molecular_weight") > 900), strict=True))
    e = table(spark, d, "environment_features").withColumn("r", clean.first_reason(rules))
    return e.groupBy(F.col("source_library_name").alias("lib")).agg(F.count("*").alias("n_input"), F.count("r").alias("n_failed"), F.count_if(F.col("r").isNull()).alias("n_kept"), *[F.count_if(F.col("r") == x).alias(x) for x in names])


REASONS = (("no_clogp", "clogp IS NULL"), ("no_scaffold", f"{PRESENT('murcko_scaffold', True)} IS NULL"), ("no_tpsa", "tpsa IS NULL"), ("no_weight", "molecular_weight IS NULL"))


@query("WITH e AS (SELECT screening_compound_id AS id, registered_at, concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in REASONS) + ") AS reasons FROM environment_features) SELECT reasons, count(*) AS n, min(id) AS first_id FROM e WHERE reasons <> '' GROUP BY 1")
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons of a row, sorted and joined."""
    rules = [("no_clogp", F.col("clogp").isNull()), ("no_scaffold", present(F.col("murcko_scaffold"), PLACEHOLDERS).isNull()), ("no_tpsa", F.col("tpsa").isNull()), ("no_weight", F.col("molecular_weight").isNull())]
    e = table(spark, d, "environment_features").withColumn("reasons", clean.all_reasons(rules))
    return e.where("reasons <> ''").groupBy("reasons").agg(F.count("*").alias("n"), F.min("screening_compound_id").alias("first_id"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS k, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 300000 GROUP BY 1")
def mixed_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Ids written as 12 and as 12.0 join after normalization."""
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(clean.merge_key(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(".0 "))).alias("k"))
    li = table(spark, d, "lineitem").select(clean.merge_key(F.col("l_orderkey")).alias("j"))
    return o.join(li, F.col("k") == F.col("j")).groupBy("k").agg(F.count("*").alias("n"))


@query(f"""WITH p AS (SELECT row_uid, upper({PRESENT('compound_id', True)}) AS c, upper({PRESENT('target_chembl_id', True)}) AS t, {PRESENT('standardized_smiles')} AS s FROM split_assignments), m AS (SELECT upper({PRESENT('compound_id', True)}) AS c, upper({PRESENT('target_chembl_id', True)}) AS t, {PRESENT('standardized_smiles')} AS s, curation_source AS v FROM curated_measurements WHERE curation_source IS NOT NULL),
a AS (SELECT c, t, min(v) AS v FROM m WHERE c IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2), b AS (SELECT s, t, min(v) AS v FROM m WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY 1, 2), x AS (SELECT c, min(v) AS v FROM m WHERE c IS NOT NULL GROUP BY 1), y AS (SELECT s, min(v) AS v FROM m WHERE s IS NOT NULL GROUP BY 1)
SELECT row_uid, coalesce(a.v, b.v, x.v, y.v) AS source, CASE WHEN a.v IS NOT NULL THEN 'c+t' WHEN b.v IS NOT NULL THEN 's+t' WHEN x.v IS NOT NULL THEN 'c' WHEN y.v IS NOT NULL THEN 's' END AS found_by FROM p LEFT JOIN a USING (c, t) LEFT JOIN b USING (s, t) LEFT JOIN x USING (c) LEFT JOIN y USING (s)""")
def enriched_by_fallback(spark: SparkSession, d: str) -> DataFrame:
    cols = [key(F.col("compound_id")).alias("c"), key(F.col("target_chembl_id")).alias("t"), present(F.col("standardized_smiles")).alias("s")]
    rows = table(spark, d, "split_assignments").select("row_uid", *cols)
    notes = table(spark, d, "curated_measurements").select(*cols, F.col("curation_source").alias("source"))
    return clean.fallback_join(rows, notes, [("c", "t"), ("s", "t"), ("c",), ("s",)], "source").select("row_uid", "source", "found_by")


@query(f"""WITH s AS (SELECT lower({PRESENT('split_strategy')}) AS x, split_label FROM split_assignments) SELECT CASE x WHEN 'scaffold' THEN 'scaffold_grouped' WHEN 'source_environment_grouped' THEN 'source_grouped' WHEN 'kinase_family_grouped' THEN 'family_grouped' ELSE x END AS strategy,
CASE WHEN lower({PRESENT('split_label')}) = 'validation' THEN 'valid' ELSE lower({PRESENT('split_label')}) END AS label, count(*) AS n FROM s GROUP BY 1, 2""")
def normalized_names(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms by a literal map; unknown names pass through."""
    def mapped(c, pairs):
        low = F.lower(present(F.col(c)))
        return F.coalesce(F.create_map(*[F.lit(x) for kv in pairs for x in kv])[low], low)

    s = table(spark, d, "split_assignments")
    strategy = mapped("split_strategy", [("scaffold", "scaffold_grouped"), ("source_environment_grouped", "source_grouped"), ("kinase_family_grouped", "family_grouped")])
    return s.groupBy(strategy.alias("strategy"), mapped("split_label", [("validation", "valid")]).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT ranking_mode, CASE WHEN contains(lower(target_name), 'kinase') AND contains(lower(ranking_mode), 'target') THEN 'potency' WHEN contains(lower(target_name), 'kinase') THEN 'selectivity' ELSE 'auxiliary' END AS category, count(*) AS n, count(*) FILTER (regexp_matches(lower(coalesce(target_name, '')), 'receptor|tyrosine')) AS n_matching FROM compound_target_ranking GROUP BY 1, 2")
def score_categories(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "compound_target_ranking")
    kin = F.lower("target_name").contains("kinase")
    cat = F.when(kin & F.lower("ranking_mode").contains("target"), "potency").when(kin, "selectivity").otherwise("auxiliary")
    return r.groupBy("ranking_mode", cat.alias("category")).agg(F.count("*").alias("n"), F.count_if(F.lower(F.coalesce("target_name", F.lit(""))).rlike("receptor|tyrosine")).alias("n_matching"))


@query("SELECT n_nationkey, upper(n_name) AS name, trim(regexp_replace(translate(upper(n_name), '-/', '  '), '\\s+', ' ', 'g')) AS normalized, CASE WHEN contains(upper(n_name), 'UNITED') THEN 'U' WHEN contains(upper(n_name), 'NATION') THEN 'N' WHEN contains(upper(n_name), 'A') THEN 'A' ELSE 'other' END AS family FROM nation")
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    """Normalized target names and the first of ordered substring rules."""
    up = F.upper("n_name")
    rules = [("U", up.contains("UNITED")), ("N", up.contains("NATION")), ("A", up.contains("A"))]
    return table(spark, d, "nation").select("n_nationkey", up.alias("name"), F.trim(F.regexp_replace(F.translate(up, "-/", "  "), "\\s+", " ")).alias("normalized"), F.coalesce(clean.first_reason(rules), F.lit("other")).alias("family"))


@query(f"""WITH v AS (SELECT DISTINCT upper({PRESENT('target_chembl_id', True)}) AS t FROM curated_measurements UNION SELECT DISTINCT upper({PRESENT('target_chembl_id', True)}) FROM split_assignments) SELECT t AS target, dense_rank() OVER (ORDER BY t) AS index FROM v WHERE t IS NOT NULL""")
def target_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct values of two tables, numbered from 1; 0 is left for unknown ones. The window runs over the
    vocabulary of targets, not over rows."""
    v = table(spark, d, "curated_measurements").select(key(F.col("target_chembl_id")).alias("target")).union(table(spark, d, "split_assignments").select(key(F.col("target_chembl_id")))).where("target IS NOT NULL").distinct()
    return v.withColumn("index", windows.row_rank([F.col("target")]).cast("long"))


@query(f"""WITH t AS (SELECT DISTINCT {PRESENT('murcko_scaffold', True)} AS m FROM final_shortlist), e AS (SELECT screening_compound_id AS id, {PRESENT('murcko_scaffold', True)} AS m FROM environment_features) SELECT source_library_name AS lib, count(*) AS n, count(*) FILTER (t.m IS NULL AND e.m IS NOT NULL) AS n_novel FROM environment_features f JOIN (SELECT DISTINCT id, m FROM e) e ON f.screening_compound_id = e.id AND {PRESENT('f.murcko_scaffold', True)} IS NOT DISTINCT FROM e.m LEFT JOIN t ON e.m = t.m GROUP BY 1""")
def scaffold_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Scaffolds not in a reference set: a left join on distinct keys and a null test."""
    ref = table(spark, d, "final_shortlist").select(present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("r")).where("r IS NOT NULL").distinct()
    e = table(spark, d, "environment_features").select(F.col("source_library_name").alias("lib"), present(F.col("murcko_scaffold"), PLACEHOLDERS).alias("m"))
    return e.join(ref, F.col("m") == F.col("r"), "left").groupBy("lib").agg(F.count("*").alias("n"), F.count_if(F.col("r").isNull() & F.col("m").isNotNull()).alias("n_novel"))


@query("""WITH c AS (SELECT DISTINCT screening_compound_id AS id FROM final_shortlist), t AS (SELECT unnest(['CHEMBL2000001', 'CHEMBL2100000', 'CHEMBL2100001']) AS target), r AS (SELECT screening_compound_id AS id, target_chembl_id AS target, max(final_strategic_score) AS score FROM final_shortlist WHERE NOT isnan(final_strategic_score) GROUP BY 1, 2)
SELECT id, target, score FROM c CROSS JOIN t LEFT JOIN r USING (id, target)""")
def compounds_by_targets(spark: SparkSession, d: str) -> DataFrame:
    """Every compound with each of a given list of targets: the list is a literal array, exploded in place."""
    s = table(spark, d, "final_shortlist")
    c = s.select(F.col("screening_compound_id").alias("id")).distinct().withColumn("target", F.explode(F.array(*map(F.lit, ("CHEMBL2000001", "CHEMBL2100000", "CHEMBL2100001")))))
    r = s.groupBy(F.col("screening_compound_id").alias("id"), F.col("target_chembl_id").alias("target")).agg(F.max(known("final_strategic_score")).alias("score"))
    return c.join(r, ["id", "target"], "left")
