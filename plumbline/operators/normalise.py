"""Normalisation of extracted records, with a log of every change beside the rewritten rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import trimmed

# Surface labels of entity types and what they stand for.
TYPE_ALIASES = {
    "equipment": "equipment_or_component",
    "component": "equipment_or_component",
    "fault": "fault_mechanism_or_condition",
    "phenomenon": "fault_mechanism_or_condition",
    "fault_concept": "fault_mechanism_or_condition",
    "fault_consequence": "protection_or_outcome",
    "outcome": "protection_or_outcome",
    "protection": "protection_or_outcome",
    "protection_or_overhaul": "protection_or_outcome",
    "action": "corrective_action",
    "process": "corrective_action",
}


def canonical_type(spelt: Column, aliases: bool = True) -> Column:
    """The type that a label stands for, else the label without its outer blanks; null where it is blank."""
    plain = F.nullif(trimmed(spelt), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, plain), plain) if aliases else plain


def canonical_types(claims: DataFrame, aliases: bool = True) -> DataFrame:
    """``claims`` with both types rewritten and the column changes: array<struct<field, original, canonical>>."""
    fields = ("subject_type", "object_type")
    logged = [F.when(canonical_type(F.col(f), aliases).isNotNull() & (canonical_type(F.col(f), aliases) != F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f).alias("original"), canonical_type(F.col(f), aliases).alias("canonical"))) for f in fields]
    return claims.withColumns({"changes": F.array_compact(F.array(*logged)), **{f: canonical_type(F.col(f), aliases) for f in fields}})


def claim_ids(claims: DataFrame) -> DataFrame:
    """``claims`` with a default for each missing claim_id: run, ``claim`` and the claim's place, from 001 on."""
    return claims.withColumn("claim_id", F.coalesce("claim_id", F.format_string("%s-claim-%03d", "run_id", "claim_index")))


def evidence_aliases(evidence: DataFrame, only: Column | None = None) -> DataFrame:
    """``evidence`` (source_type, source_file, source_id, evidence_id) in its one form, with the column changes.

    processed_data means input_text, as does a missing type of a file below processed_data/; evidence_id stands in for a
    missing source_id, and so does the one id of ``only`` (a list) where it holds exactly one.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    from_path = empty("source_type") & F.coalesce(F.startswith("source_file", F.lit("processed_data/")), F.lit(False))
    from_id = empty("source_id") & ~empty("evidence_id")
    single = empty("source_id") & empty("evidence_id") & (F.size(only) == 1) if only is not None else F.lit(False)
    kind = F.when((F.col("source_type") == "processed_data") | from_path, "input_text").otherwise(F.col("source_type"))
    source = F.when(from_id, F.col("evidence_id")).when(single, F.get(only, F.lit(0)) if only is not None else F.lit(None)).otherwise(F.col("source_id"))
    change = lambda when, field, original, now: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(original).alias("original"), now.alias("canonical")))
    changes = F.array_compact(F.array(
        change(F.col("source_type") == "processed_data", "source_type", "processed_data", F.lit("input_text")), change(from_path, "source_type", "missing_processed_data_path", F.lit("input_text")),
        change(from_id, "source_id", "evidence_id", F.col("evidence_id")), change(single, "source_id", "missing_singleton_context", F.get(only, F.lit(0)) if only is not None else F.lit(None).cast("string")),
    ))
    return evidence.withColumns({"changes": changes, "source_type": kind, "source_id": source})


def evidence_block(excerpts: Column) -> Column:
    """The lines ``[id] excerpt`` of array<struct<source_id, excerpt>>, as a prompt gives them."""
    return F.array_join(F.transform(excerpts, lambda e: F.concat(F.lit("["), e["source_id"], F.lit("] "), F.coalesce(e["excerpt"], F.lit("")))), "\n")
