"""The pN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANKS, PLACEHOLDERS
from ..session import Workspace, table
from .abuse import rates, score_documents
from .group_split import related_pairs, scaffold_split, split_errors
from .leaks import LeakIndex
from .overlap import cross_split_pairs, overlap_report, structure_classes
from .packing import fill_report, pack, packing_errors
from .survivors import best_supported, surviving_records
from .top_n import top_n_per_group
from .varied_subset import varied_subset

B = "concat(" + ", ".join(f"chr({ord(c)})" for c in BLANKS) + ")"
WORDS = ", ".join(f"'{w}'" for w in PLACEHOLDERS)


def _present(c: str, words: bool = False) -> str:
    gone = f"trim({c}, {B}) = ''" + (f" OR lower(trim({c}, {B})) IN ({WORDS})" if words else "")
    return f"CASE WHEN NOT ({gone}) THEN trim({c}, {B}) END"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_leaders(spark, sf_dir).select("target_chembl_id", "screening_compound_id")


def p1_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_n_per_group(table(spark, sf_dir, "compound_target_ranking"), "target_chembl_id", "screening_compound_id", "final_strategic_score", "potency_component_raw")
    return best.select(F.col("group_key").alias("target_chembl_id"), F.col("item").alias("screening_compound_id"), "score", "tie", "rank")


P1 = f"""
WITH r AS (SELECT upper({_present('target_chembl_id')}) AS target_chembl_id, screening_compound_id, final_strategic_score AS score, potency_component_raw AS tie
    FROM compound_target_ranking WHERE final_strategic_score IS NOT NULL AND NOT isnan(final_strategic_score)),
one AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id, screening_compound_id ORDER BY score DESC, tie DESC NULLS LAST) AS k FROM r WHERE target_chembl_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY target_chembl_id ORDER BY score DESC, tie DESC NULLS LAST, screening_compound_id) AS rank FROM one WHERE k = 1)
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, sf_dir, "split_assignments"))
    return pairs.select(F.least("train_uid", "other_uid").alias("row_uid_a"), F.greatest("train_uid", "other_uid").alias("row_uid_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "split_assignments"))


P2 = f"""
WITH r AS (SELECT row_uid, concat_ws('|', lower(trim(task_name, {B})), lower(trim(split_strategy, {B})), lower(trim(split_id, {B})), lower(trim(fold_id, {B}))) AS p,
    CASE lower(trim(split_label, {B})) WHEN 'train' THEN 'train' WHEN 'valid' THEN 'valid' WHEN 'validation' THEN 'valid' WHEN 'test' THEN 'test' END AS label,
    lower({_present('compound_id', True)}) AS c, string_split(translate(standardized_smiles, {B}, ''), '.') AS parts, source_environment AS source FROM split_assignments),
k AS (SELECT row_uid, p, label, c, source, nullif(list_filter(parts, lambda x: length(x) = list_max(list_transform(parts, lambda y: length(y))))[1], '') AS s FROM r WHERE label IS NOT NULL),
pairs AS (SELECT a.row_uid AS t, b.row_uid AS o FROM k a JOIN k b ON a.p = b.p AND a.label = 'train' AND b.label <> 'train' WHERE a.c = b.c OR a.s = b.s
    OR (abs(length(a.s) - length(b.s)) * 10 <= greatest(length(a.s), length(b.s)) AND levenshtein(a.s, b.s) * 10 <= greatest(length(a.s), length(b.s))))
"""

def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_classes(table(spark, sf_dir, "split_assignments"))


P2_CLASSES = P2[: P2.index("pairs AS (")].replace("WITH r AS", "WITH RECURSIVE r AS", 1) + """
u AS (SELECT * FROM k WHERE row_uid IS NOT NULL AND s IS NOT NULL AND p IS NOT NULL),
l AS (SELECT DISTINCT a.s AS a, b.s AS b FROM u a JOIN u b ON a.p = b.p AND a.label = 'train' AND b.label <> 'train' WHERE a.s <> b.s AND abs(length(a.s) - length(b.s)) * 10 <= greatest(length(a.s), length(b.s))
    AND levenshtein(a.s, b.s) * 10 <= greatest(length(a.s), length(b.s))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT DISTINCT s AS a, s AS b FROM u UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
cls AS (SELECT a, min(b) AS class_structure FROM reach GROUP BY 1),
deg AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT s AS structure, class_structure, coalesce(n_links, 0) AS n_links, n_rows FROM (SELECT s, count(*) AS n_rows FROM u GROUP BY 1) JOIN cls ON cls.a = s LEFT JOIN deg ON deg.a = s
"""


# The rolling hash cuts behind the third character of a window; a chunk counts where the training structure has it too.
P2_REPORT = P2.rstrip() + """,
texts AS (SELECT DISTINCT s, list_transform(string_split(s, ''), lambda x: unicode(x)::BIGINT) AS u FROM k WHERE row_uid IN (SELECT t FROM pairs UNION SELECT o FROM pairs) AND s IS NOT NULL),
ends AS (SELECT s, list_append(list_filter(range(3, length(s)), lambda i: ((u[i - 2] * 31 + u[i - 1]) * 31 + u[i]) * 40503 % 65536 < 16384), length(s)) AS e FROM texts),
cut AS (SELECT s, list_transform(range(1, len(e) + 1), lambda i: s[coalesce(e[i - 1], 0) + 1 : e[i]]) AS chunks FROM ends),
shares AS (SELECT o, coalesce(list_sum(list_transform(list_filter(co.chunks, lambda x: list_contains(ct.chunks, x)), lambda x: length(x))) / length(b.s), 0) AS v
    FROM pairs JOIN k a ON a.row_uid = t JOIN k b ON b.row_uid = o LEFT JOIN cut ct ON ct.s = a.s LEFT JOIN cut co ON co.s = b.s),
hit AS (SELECT o, max(v) AS v FROM shares GROUP BY o)
SELECT replace(p, '|', chr(31)) AS place, label, source, count(*) AS n_rows, count(v) AS n_overlapping, round(avg(v), 6) AS mean_overlap
FROM k LEFT JOIN hit ON k.row_uid = o WHERE label <> 'train' GROUP BY ALL
"""


def p3_varied_48(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_subset(table(spark, sf_dir, "final_shortlist"), 48)


def p3_varied_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    shortlist = table(spark, sf_dir, "final_shortlist")
    return varied_subset(shortlist, -(-shortlist.count() // 10))


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a subset of 48 must have: its size, as many scaffolds as there can be, no record twice."""
    s = p3_varied_48(spark, sf_dir)
    return s.agg(F.count("*").alias("n_rows"), F.count_distinct(F.coalesce("murcko_scaffold", F.lit(""))).alias("n_scaffolds"), (F.count("*") - F.count_distinct("entity_id")).alias("n_repeated"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_supported(table(spark, sf_dir, "curated_measurements"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_records(table(spark, sf_dir, "curated_measurements"))


P4 = f"""
WITH RECURSIVE r AS (SELECT record_id, upper({_present('target_chembl_id', True)}) AS t, upper({_present('compound_id', True)}) AS c, {_present('standardized_smiles')} AS s,
    pKi, n_source_records AS ns, n_unique_assays AS na FROM curated_measurements),
k AS (SELECT * FROM r WHERE t IS NOT NULL AND (c IS NOT NULL OR s IS NOT NULL)),
node AS (SELECT record_id, t || '|c|' || c AS x FROM k WHERE c IS NOT NULL UNION ALL SELECT record_id, t || '|s|' || s FROM k WHERE s IS NOT NULL),
near AS (SELECT DISTINCT a.x AS u, b.x AS v FROM node a JOIN node b USING (record_id)),
reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
root AS (SELECT u AS x, min(v) AS g FROM reach GROUP BY u),
lab AS (SELECT record_id, min(g) AS g FROM node JOIN root USING (x) GROUP BY record_id),
w AS (SELECT k.*, count(*) OVER p AS n, row_number() OVER (PARTITION BY g ORDER BY coalesce(ns, -1) DESC) AS i, max(coalesce(ns, -1)) OVER p AS ms, max(coalesce(na, -1)) OVER p AS ma,
    count(*) OVER (PARTITION BY g, coalesce(ns, -1)) AS cs, count(*) OVER (PARTITION BY g, coalesce(na, -1)) AS ca
    FROM k JOIN lab USING (record_id) WINDOW p AS (PARTITION BY g))
SELECT record_id FROM w WHERE n > 1 AND pKi IS NOT NULL AND NOT isnan(pKi) AND ns = ms AND na = ma AND cs = 1 AND ca = 1
"""


# Of each group: two candidate measurements of equal support, the identity that fits one of them best, the best origin that
# does not contradict the number of source records.
P4_SURVIVORS = P4[: P4.index("w AS (SELECT k.*")].replace("pKi, n_source_records AS ns, n_unique_assays AS na FROM", "pKi, n_source_records AS ns, n_unique_assays AS na, * EXCLUDE (record_id, pKi) FROM") + """
x AS (SELECT k.*, g, pKi IS NOT NULL AND NOT isnan(pKi) AS p, pKi_std IS NOT NULL AND NOT isnan(pKi_std) AS d, coalesce(abs(9.0 - log10(CASE WHEN median_ki_nM > 0 THEN median_ki_nM END) - pKi) < 0.05, false) AS e,
    CAST(c IS NOT NULL AS INTEGER) + CAST(s IS NOT NULL AS INTEGER) AS k, is_duplicate_measurement AS mark,
    CAST(curation_source IS NOT NULL AS INTEGER) + CAST(is_duplicate_measurement IS NOT NULL AS INTEGER) + CAST(curated_at IS NOT NULL AS INTEGER) + CAST(loaded_at IS NOT NULL AS INTEGER) AS filled FROM k JOIN lab USING (record_id)),
sizes AS (SELECT g, count(*) AS n_records FROM x GROUP BY g HAVING count(*) > 1),
m AS (SELECT 1 AS m, x.* FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC, ns DESC NULLS LAST, na DESC NULLS LAST, d DESC, e DESC, loaded_at DESC NULLS LAST, record_id) = 1
    UNION ALL SELECT 2, x.* FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY p DESC, ns DESC NULLS LAST, na DESC NULLS LAST, k DESC, d DESC, e DESC, loaded_at DESC NULLS LAST, record_id) = 1),
i AS (SELECT * FROM (SELECT g, c, s, k, count(*) AS n, min(record_id) AS r FROM x GROUP BY g, c, s, k) QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, n DESC, r) = 1),
options AS (SELECT g, 0 AS o, c, s, k, n, r FROM i UNION ALL SELECT g, m, c, s, k, 1, record_id FROM m),
fit AS (SELECT m.g, m.m, m.record_id, m.ns, o.k, o.n, o.r FROM m JOIN options o ON m.g = o.g AND coalesce(m.c = o.c, true) AND coalesce(m.s = o.s, true) QUALIFY row_number() OVER (PARTITION BY m.g, m.m ORDER BY o.k DESC, o.n DESC, o.o) = 1),
chosen AS (SELECT * FROM fit QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC, n DESC, m) = 1),
origins AS (SELECT x.g, x.record_id FROM x JOIN chosen ON x.g = chosen.g AND coalesce(mark = (chosen.ns > 1), true) QUALIFY row_number() OVER (PARTITION BY x.g ORDER BY filled DESC, curated_at DESC NULLS LAST, x.record_id) = 1)
SELECT n_records, ch.record_id AS measurement_record, ch.r AS identity_record, o.record_id AS origin_record, a.t AS target, a.median_ki_nM, a.pKi, a.pKi_std, a.n_source_records, a.n_unique_assays, b.compound_id, b.standardized_smiles,
    z.curation_source, z.is_duplicate_measurement, z.curated_at, z.loaded_at
FROM chosen ch JOIN sizes USING (g) LEFT JOIN origins o ON ch.g = o.g JOIN x a ON a.record_id = ch.record_id JOIN x b ON b.record_id = ch.r LEFT JOIN x z ON z.record_id = o.record_id
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_pairs(table(spark, sf_dir, "environment_features"))


def p5_scaffold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold_split(table(spark, sf_dir, "environment_features"))


def p5_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    compounds = table(spark, sf_dir, "environment_features")
    return split_errors(compounds, scaffold_split(compounds))


P5 = f"""
WITH RECURSIVE r AS (SELECT DISTINCT screening_compound_id AS i, {_present('murcko_scaffold', True)} AS a, {_present('standardized_smiles')} AS b FROM environment_features WHERE screening_compound_id IS NOT NULL),
node AS (SELECT i, 'a' || a AS x FROM r WHERE a IS NOT NULL UNION SELECT i, 'b' || b FROM r WHERE b IS NOT NULL),
near AS (SELECT DISTINCT p.x AS u, q.x AS v FROM node p JOIN node q USING (i)),
reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
root AS (SELECT u AS x, min(v) AS g FROM reach GROUP BY u),
lab AS (SELECT i, min(g) AS g FROM node JOIN root USING (x) GROUP BY i),
anchor AS (SELECT g, min(i) AS anchor_id FROM lab GROUP BY g)
SELECT anchor_id, i AS member_id FROM lab JOIN anchor USING (g) WHERE i <> anchor_id
"""


def _leaks(spark: SparkSession, sf_dir: str) -> LeakIndex:
    return LeakIndex(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_passages").select("item_id", "text"), Workspace(spark, "leaks"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).matches().select("doc_id", "item_id")


def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).proximity()


P7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

P7_PROXIMITY = r"""
WITH d AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
e AS (SELECT item_id, unnest(w) AS term, unnest(range(len(w))) AS ipos FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_passages)),
n AS (SELECT term, count(*) AS n FROM d WHERE term IN (SELECT term FROM e) GROUP BY 1),
top AS (SELECT item_id, term FROM (SELECT item_id, term, n, min(ipos) AS ipos FROM e JOIN n USING (term) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, ipos) <= 10),
f AS (SELECT doc_id, item_id, count(DISTINCT term) OVER (PARTITION BY doc_id, item_id ORDER BY pos RANGE BETWEEN 39 PRECEDING AND CURRENT ROW) AS found FROM d JOIN top USING (term))
SELECT doc_id, item_id, max(found) AS found FROM f WHERE found >= 6 GROUP BY ALL
"""


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(pack(table(spark, sf_dir, "documents")))


def p6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return packing_errors(pack(documents), documents)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("abusive").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(_scored(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_leaders, p2_found, p2_report, p2_classes, p3_varied_48, p3_varied_tenth, p3_errors, p4_found, p4_survivors, p5_found, p5_scaffold_split, p5_errors,
        p6_containers, p6_fill, p6_errors, p7_found, p7_proximity, p8_found, p8_scores, p8_rates,
    )
}
SQL = {
    "p1_found": P1 + "SELECT target_chembl_id, screening_compound_id FROM ranked WHERE rank <= 5",
    "p1_leaders": P1 + "SELECT target_chembl_id, screening_compound_id, score, tie, rank FROM ranked WHERE rank <= 5",
    "p2_found": P2 + "SELECT DISTINCT least(t, o) AS row_uid_a, greatest(t, o) AS row_uid_b FROM pairs",
    "p2_report": P2_REPORT,
    "p2_classes": P2_CLASSES,
    "p3_errors": f"SELECT least(48, count(*)) AS n_rows, least(48, count(DISTINCT coalesce({_present('murcko_scaffold', True)}, ''))) AS n_scaffolds, 0 AS n_repeated FROM final_shortlist WHERE entity_id IS NOT NULL",
    "p4_found": P4,
    "p4_survivors": P4_SURVIVORS,
    "p5_found": P5,
    "p5_errors": "SELECT count(DISTINCT screening_compound_id) AS n_compounds, count(DISTINCT screening_compound_id) AS n_labelled, 0 AS n_twice, 0 AS n_torn, true AS near_shares FROM environment_features",
    "p6_errors": "SELECT count(*) FILTER (text <> '') AS n_texts, 0 AS n_overfull, count(*) FILTER (text <> '') AS n_packed, 0 AS n_torn FROM documents",
    "p7_found": P7,
    "p7_proximity": P7_PROXIMITY,
}
