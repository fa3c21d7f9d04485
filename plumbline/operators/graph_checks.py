"""Integrity checks of claims within their run: evidence, duplicates, polarity, reverse edges, types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import comparison_key, filled, trimmed

# Spellings of the two polarities.
POSITIVE = ("positive", "affirmed", "true", "肯定", "存在")
NEGATIVE = ("negative", "negated", "false", "否定", "不存在")
# The qualifiers that scope a claim, in order.
SCOPES = ("case_id", "document_id", "source_id", "time_window")


def predicate_aliases(terms: DataFrame) -> DataFrame:
    """(k, code): the controlled predicate that each comparison key means; its code and its labels do."""
    spelt = terms.where("term_kind = 'predicate'").select("term_code", F.explode(F.array("term_code", "label_en", "label_zh")).alias("v")).where("v is not null")
    return spelt.groupBy(comparison_key("v").alias("k")).agg(F.min("term_code").alias("code"))


def keyed_claims(claims: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Claims with s_key, raw_key, o_key (comparison keys of subject, predicate and object, null where empty), p_key, scope
    and polarity.

    p_key is the controlled predicate that the normalised spelling or else the raw one means among ``terms``, null where
    neither does; without ``terms`` it is the key of the first spelling that isn't empty.
    """
    spelt = {f"q_{q}": F.try_element_at("qualifiers", F.lit(q)) for q in (*SCOPES, "polarity")}
    spelt |= {"s_key": F.col("subject"), "raw_key": F.col("predicate"), "n_key": F.col("predicate_normalized"), "o_key": F.col("object")}
    kept = [c for c in ("claim_row", "run_id", "claim_index", "subject_id", "object_id", "subject_type", "object_type", "confidence", "evidence_ids") if c in claims.columns]
    keyed = claims.select(*kept, *[filled(comparison_key(c)).alias(name) for name, c in spelt.items()])
    keyed = keyed.withColumn("scope", F.coalesce(*[f"q_{q}" for q in SCOPES], F.lit("global")))
    keyed = keyed.withColumn("positive", F.when(F.col("q_polarity").isin(*POSITIVE), True).when(F.col("q_polarity").isin(*NEGATIVE), False)).drop(*[c for c in spelt if c.startswith("q_")])
    if terms is None:
        return keyed.withColumn("p_key", F.coalesce("n_key", "raw_key")).drop("n_key")
    aliases = predicate_aliases(terms)
    by = lambda c: aliases.select(F.col("k").alias(c), F.col("code").alias(f"{c}_code"))
    return keyed.join(by("n_key"), "n_key", "left").join(by("raw_key"), "raw_key", "left").withColumn("p_key", F.coalesce("n_key_code", "raw_key_code")).drop("n_key", "n_key_code", "raw_key_code")


def incomplete(keyed: DataFrame) -> DataFrame:
    return keyed.where("s_key is null or raw_key is null or o_key is null")


def self_loops(keyed: DataFrame) -> DataFrame:
    return keyed.where("s_key = o_key")


def duplicates(keyed: DataFrame, within: tuple[str, ...] = ("run_id", "scope")) -> DataFrame:
    """(.. within, s_key, p_key, o_key, n): triples claimed more than once within a scope of a run."""
    whole = keyed.where("s_key is not null and p_key is not null and o_key is not null")
    return whole.groupBy(*within, "s_key", "p_key", "o_key").agg(F.count("*").alias("n")).where("n > 1")


def polarity_conflicts(keyed: DataFrame, within: tuple[str, ...] = ("run_id", "scope"), triple: tuple[str, ...] = ("s_key", "p_key", "o_key")) -> DataFrame:
    """Triples (or the parts of them that are named) that are both affirmed and denied within a scope of a run."""
    whole = keyed.where("s_key is not null and o_key is not null and p_key is not null and positive is not null")
    return whole.groupBy(*within, *triple).agg(F.count_if("positive").alias("affirmed"), F.count_if(~F.col("positive")).alias("denied")).where("affirmed > 0 and denied > 0")


def reverse_edges(keyed: DataFrame, within: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(.. within, p_key, low, high) with low < high: edges that also stand the other way round.

    Both directions fall into one group under their sorted ends, so one aggregate replaces the self-join.
    """
    edges = keyed.where("s_key is not null and o_key is not null and p_key is not null and s_key <> o_key")
    ends = edges.groupBy(*within, "p_key", F.least("s_key", "o_key").alias("low"), F.greatest("s_key", "o_key").alias("high")).agg(F.bool_or(F.col("s_key") < F.col("o_key")).alias("up"), F.bool_or(F.col("s_key") > F.col("o_key")).alias("down"))
    return ends.where("up and down").select(*within, "p_key", "low", "high")


def evidence_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_row, run_id, status): ``missing`` (nothing cited, or something that the run doesn't hold), ``unverifiable`` (the
    run holds no evidence at all), else ``verified``."""
    unknown = missing_evidence(claims, evidence).select("claim_row").distinct().withColumn("unknown", F.lit(True))
    bundles = evidence.select("run_id").distinct().withColumn("bundle", F.lit(True))
    rows = claims.select("claim_row", "run_id", (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0).alias("cites")).join(bundles, "run_id", "left").join(unknown, "claim_row", "left")
    return rows.select("claim_row", "run_id", F.when(~F.col("cites"), "missing").when(F.col("bundle").isNull(), "unverifiable").when(F.col("unknown"), "missing").otherwise("verified").alias("status"))


def missing_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_row, run_id, evidence_id): cited ids that the claim's run doesn't hold (anti-join)."""
    cited = claims.select("claim_row", "run_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    held = evidence.select("run_id", F.col("source_id").alias("evidence_id")).distinct()
    return cited.join(held, ["run_id", "evidence_id"], "left_anti").select("claim_row", "run_id", "evidence_id")


def named_types(claims: DataFrame) -> DataFrame:
    """(run_id, name, type, id) of all claim ends with a type; the name is a comparison key."""
    ends = F.array(*[F.struct(F.col(n).alias("spelt"), F.col(f"{n}_type").alias("type"), F.col(f"{n}_id").alias("id")) for n in ("subject", "object")])
    rows = claims.select("run_id", F.explode(ends).alias("e")).select("run_id", "e.*").where(F.coalesce(trimmed(F.col("type")), F.lit("")) != "")
    return rows.select("run_id", filled(comparison_key("spelt")).alias("name"), "type", "id")


def type_conflicts(claims: DataFrame) -> DataFrame:
    """(run_id, name, types): names that bear more than one type within a run."""
    return named_types(claims).where("name is not null").groupBy("run_id", "name").agg(F.countDistinct("type").alias("types")).where("types > 1")


def resolved_types(claims: DataFrame) -> DataFrame:
    """(claim_row, subject_type, object_type): the explicit one, else the only one that the run gives the id, else the name."""
    types = named_types(claims)
    only = lambda key: types.where(F.coalesce(trimmed(F.col(key)), F.lit("")) != "").groupBy("run_id", key).agg(F.countDistinct("type").alias("n"), F.min("type").alias(f"by_{key}")).where("n = 1").drop("n")
    by_id, by_name = only("id"), only("name")
    found = claims.select("claim_row", "run_id", *[c for n in ("subject", "object") for c in (F.col(f"{n}_id"), filled(comparison_key(n)).alias(f"{n}_name"), filled(F.col(f"{n}_type")).alias(f"{n}_type"))])
    for n in ("subject", "object"):
        found = found.join(by_id.select("run_id", F.col("id").alias(f"{n}_id"), F.col("by_id").alias(f"{n}_by_id")), ["run_id", f"{n}_id"], "left")
        found = found.join(by_name.select("run_id", F.col("name").alias(f"{n}_name"), F.col("by_name").alias(f"{n}_by_name")), ["run_id", f"{n}_name"], "left")
    return found.select("claim_row", *[F.coalesce(f"{n}_type", f"{n}_by_id", f"{n}_by_name").alias(f"{n}_type") for n in ("subject", "object")])


def cited_evidence(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_row, evidence): what a claim cites, in order, as array<struct<source_id, excerpt>>; the run's last excerpt of an
    id counts, an unknown id is empty."""
    last = evidence.groupBy("run_id", "source_id").agg(F.max_by(F.coalesce("excerpt", F.lit("")), "evidence_row").alias("excerpt"))
    cited = claims.select("claim_row", "run_id", F.posexplode("evidence_ids").alias("pos", "source_id"))
    met = cited.join(last, ["run_id", "source_id"], "left")
    placed = met.groupBy("claim_row").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("excerpt", F.lit("")).alias("excerpt")))).alias("x"))  # a claim's own citations
    return placed.select("claim_row", F.transform("x", lambda e: F.struct(e["source_id"].alias("source_id"), e["excerpt"].alias("excerpt"))).alias("evidence"))


def cited_excerpts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_row, excerpts): the excerpts that a claim cites, in order, joined by blanks."""
    return cited_evidence(claims, evidence).select("claim_row", F.array_join(F.transform("evidence", lambda e: e["excerpt"]), " ").alias("excerpts"))
