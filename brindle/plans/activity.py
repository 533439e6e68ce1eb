"""Cleaning of activity exports: relation prefixes, units, variants, unit errors, repeated measurements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.checks import require_columns
from brindle.functions.expr import contains_any, number_after_relation, strip_chars
from brindle.operators.dedup import mad_duplicates, unit_errors
from brindle.operators.relational import keep_first

# Texts that mark a variant's measurement.
VARIANT_WORDS = ("mutant", "mutation", "variant")
# The activity types, and export columns with the names they are given.
ACTIVITIES = ("IC50", "Kd", "Ki")
RENAMED = {
    "Smiles": "SMILES", "Standard Type": "Type", "Standard Relation": "Relation", "Standard Units": "Units", "pChEMBL Value": "pChEMBL_Value",
    "Data Validity Comment": "Validity", "Target Type": "Type_Target", "Assay Organism": "Assay_Organism", "Assay Description": "Assay_Desc",
}


def clean_binding(df: DataFrame, structure: str = "SMILES", ic50: str = "IC50 (nM)", canonical: Callable[[Column], Column] | None = None, value_range: float = 1.0, z: float = 3.5) -> DataFrame:
    """(structure, pIC50): exact nanomolar values as -log10(molar), one copy of exact duplicates, no keys with unit errors,
    then one agreed value a structure. Empty texts count as missing. canonical maps structures to their standard form."""
    require_columns(df, structure, ic50)
    rows = df.select(F.nullif(F.trim(structure), F.lit("")).alias(structure), number_after_relation(ic50).alias("_v")).dropna(subset=[structure])
    rows = rows.where((F.col("_v.relation") == "=") & (F.col("_v.value") > 0)).select(structure, (-F.log10(F.col("_v.value") / 1e9)).alias("pIC50"))
    if canonical is not None:
        rows = rows.withColumn(structure, canonical(F.col(structure))).dropna(subset=[structure])
    return _agree(rows.distinct(), structure, "pIC50", value_range, z)


def _agree(rows: DataFrame, key: str, value: str, value_range: float, z: float) -> DataFrame:
    good = unit_errors(rows, key, value).where(~F.col("unit_error"))
    rows = mad_duplicates(rows.join(good.select(key), key, "left_semi"), key, value, value_range, z).dropna(subset=[value])
    rest = [c for c in rows.columns if c not in (key, value)]
    return keep_first(rows, [key], value, *rest) if rest else rows.distinct()


def clean_chembl(df: DataFrame, activity: str = "IC50", structure: str = "SMILES", canonical: Callable[[Column], Column] | None = None, value_range: float = 1.0, z: float = 3.5) -> DataFrame:
    """(structure, pChEMBL_Value): exact, valid, wild-type, human, single-protein measurements of one activity type, one agreed value a structure.

    Export columns get their short names (RENAMED). Empty texts are null, quotes around relations go. Rows need the activity
    type, relation =, nM, a pChEMBL value, no validity remark, the target type SINGLE PROTEIN, the organism Homo sapiens, and
    an assay description without a variant's word; a null description passes.
    """
    if activity not in ACTIVITIES:
        raise ValueError(f"the activity is one of {ACTIVITIES}")
    df = df.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in df.columns and v not in df.columns})
    require_columns(df, structure, "Type", "Relation", "Units", "pChEMBL_Value", "Validity", "Type_Target", "Assay_Organism", "Assay_Desc")
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    rows = df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in texts}).withColumn("Relation", strip_chars("Relation", "'"))
    wanted = (F.col("Type") == activity) & (F.col("Relation") == "=") & F.col("Validity").isNull() & (F.col("Units") == "nM")
    wanted = wanted & (F.col("Type_Target") == "SINGLE PROTEIN") & (F.col("Assay_Organism") == "Homo sapiens")
    rows = rows.where(wanted & F.col("pChEMBL_Value").isNotNull() & F.col(structure).isNotNull())
    rows = rows.where(~F.coalesce(contains_any("Assay_Desc", VARIANT_WORDS), F.lit(False)))
    if canonical is not None:
        rows = rows.withColumn(structure, canonical(F.col(structure))).dropna(subset=[structure])
    return _agree(rows.select(structure, F.col("pChEMBL_Value").cast("double").alias("pChEMBL_Value")).distinct(), structure, "pChEMBL_Value", value_range, z)
