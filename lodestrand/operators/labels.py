"""Threshold labels with a gray zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Parts of a kinase's name and its family, in the order in which they are tried.
FAMILY_RULES = (
    ("MAPK", "CMGC"), ("CDK", "CMGC"), ("GSK", "CMGC"), ("DYRK", "CMGC"), ("CLK", "CMGC"), ("ERK", "CMGC"), ("JNK", "CMGC"), ("P38", "CMGC"),
    ("AKT", "AGC"), ("PKC", "AGC"), ("PKA", "AGC"), ("ROCK", "AGC"), ("RSK", "AGC"), ("SGK", "AGC"),
    ("ABL", "TK"), ("SRC", "TK"), ("JAK", "TK"), ("EGFR", "TK"), ("ERBB", "TK"), ("FGFR", "TK"), ("MET", "TK"), ("RET", "TK"), ("FLT", "TK"),
    ("KIT", "TK"), ("DDR", "TK"), ("TEC", "TK"), ("BMX", "TK"), ("BTK", "TK"), ("SYK", "TK"), ("ZAP70", "TK"),
    ("PIK3", "PIKK"), ("MTOR", "PIKK"), ("ATM", "PIKK"), ("ATR", "PIKK"), ("DNA PK", "PIKK"),
    ("AUR", "CAMK"), ("CAMK", "CAMK"), ("DAPK", "CAMK"), ("CHEK", "CAMK"), ("CHK", "CAMK"), ("PIM", "CAMK"), ("NUAK", "CAMK"), ("MARK", "CAMK"), ("MELK", "CAMK"),
    ("STK", "STE"), ("RAF", "TKL"), ("BRAF", "TKL"), ("ALK", "TK"), ("IRAK", "TKL"), ("MLK", "TKL"), ("NEK", "NEK"), ("PLK", "OTHER"),
)


def normalized_name(c: Column) -> Column:
    """Upper case, hyphens and slashes as blanks, runs of blanks as one, none outside."""
    return F.trim(F.regexp_replace(F.translate(F.upper(c), "-/", "  "), r"\s+", " "))


def first_rule(name: Column, rules: tuple[tuple[str, str], ...] = FAMILY_RULES, otherwise: str = "Unclassified") -> Column:
    """Struct (family, provenance) by the first rule whose text stands in the name; the rules are a parameter."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<family:string,provenance:string>"))
    for token, family in rules:
        out = out.when(F.contains(name, F.lit(token)), F.struct(F.lit(family).alias("family"), F.lit(f"name_match:{token}").alias("provenance")))
    return out.otherwise(F.struct(F.lit(otherwise).alias("family"), F.lit("name_match:unclassified").alias("provenance")))


def truthy(c: Column) -> Column:
    """Whether a value says yes: 1, true or yes in any case, or a number above 0; null says no."""
    text = F.lower(F.trim(c.cast("string")))
    return F.coalesce(text.isin("1", "true", "yes") | (text.try_cast("double") > 0), F.lit(False))


def strict_boolean(c: Column) -> Column:
    """True or false from 1, 0, true, false, yes and no in any case; null from anything else."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False)


def binary_label(value: Column, positive: float, negative: float, gray: str = "unlabel") -> Column:
    """1 from `positive` on, 0 below `negative`; in between by `gray`: `assign` gives 0, `unlabel` and `exclude` null."""
    between = F.lit(0) if gray == "assign" else F.lit(None).cast("int")
    return F.when(value.isNull(), F.lit(None).cast("int")).when(value >= positive, 1).when(value < negative, 0).otherwise(between)


def label_name(label: Column, positive: str, negative: str) -> Column:
    return F.when(label == 1, positive).when(label == 0, negative).otherwise("unlabeled")


def rule_text(positive: float, negative: float, gray: str) -> str:
    return f"1 if value >= {positive:g}; 0 if value < {negative:g}; gray zone: {gray}"


def frequency_bin(count: Column, edges: tuple[int, int, int]) -> Column:
    """singleton, rare, common or frequent by upper edges."""
    a, b, c = edges
    return F.when(count <= a, "singleton").when(count <= b, "rare").when(count <= c, "common").otherwise("frequent")
