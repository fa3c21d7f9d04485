"""Integrity of claims and their evidence, run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import case_label, edge_id
from plumbline.functions.text import trimmed as trim_text
from plumbline.operators import graph_checks as checks
from plumbline.operators.candidate_edges import TRIGGERS, document_sentences, mentions
from plumbline.operators.candidate_edges import candidate_edges as edges_of
from plumbline.operators.metrics import micro_prf, ratio, set_counts
from plumbline.operators.normalise import TYPE_ALIASES, canonical_types, claim_ids, evidence_block
from plumbline.plans.catalogue import query
from plumbline.plans.sql import KEYED, comparison_keys, key, trimmed
from plumbline.session import spread, table


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "graph_claims")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.keyed_claims(_claims(spark, sf_dir), table(spark, sf_dir, "ref_terms"))


@query(f"WITH {KEYED} SELECT claim_row, run_id FROM keyed WHERE s_key IS NULL OR raw_key IS NULL OR o_key IS NULL")
def claims_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.incomplete(_keyed(spark, sf_dir)).select("claim_row", "run_id")


@query(f"WITH {KEYED} SELECT claim_row, run_id FROM keyed WHERE s_key = o_key")
def claims_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.self_loops(_keyed(spark, sf_dir)).select("claim_row", "run_id")


_DUPLICATES = "SELECT run_id, scope, s_key, p_key, o_key, count(*) AS n FROM keyed WHERE s_key IS NOT NULL AND p_key IS NOT NULL AND o_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1"


@query(f"WITH {KEYED} {_DUPLICATES}")
def claims_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(_keyed(spark, sf_dir))


@query(f"""WITH {KEYED} SELECT s_key, p_key, count(*) FILTER (WHERE positive) AS affirmed, count(*) FILTER (WHERE NOT positive) AS denied FROM keyed
WHERE s_key IS NOT NULL AND o_key IS NOT NULL AND p_key IS NOT NULL AND positive IS NOT NULL GROUP BY ALL HAVING bool_or(positive) AND bool_or(NOT positive)""")
def claims_polarity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of which a predicate is affirmed in one place and denied in another, over all runs."""
    return checks.polarity_conflicts(_keyed(spark, sf_dir), within=(), triple=("s_key", "p_key"))


_EDGES = "edge AS (SELECT DISTINCT p_key, s_key, o_key FROM keyed WHERE s_key IS NOT NULL AND p_key IS NOT NULL AND o_key IS NOT NULL)"
_REVERSED = "FROM edge a JOIN edge b ON a.p_key = b.p_key AND a.s_key = b.o_key AND a.o_key = b.s_key WHERE a.s_key < a.o_key"


@query(f"WITH {KEYED}, {_EDGES} SELECT a.p_key, a.s_key AS low, a.o_key AS high {_REVERSED}")
def claims_reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that also stand the other way round, over all runs."""
    return checks.reverse_edges(_keyed(spark, sf_dir), within=())


@query("""SELECT c.claim_row, c.run_id, c.evidence_id FROM (SELECT DISTINCT claim_row, run_id, unnest(evidence_ids) AS evidence_id FROM graph_claims) c
WHERE c.evidence_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence_refs e WHERE e.run_id = c.run_id AND e.source_id = c.evidence_id)""")
def claims_missing_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.missing_evidence(_claims(spark, sf_dir), table(spark, sf_dir, "evidence_refs")).where("evidence_id is not null")


_NAMES = comparison_keys("SELECT unnest([subject, object]) FROM graph_claims")
_NAMED = f"""type AS (
  SELECT run_id, subject AS v, subject_type AS type, subject_id AS id FROM graph_claims UNION ALL SELECT run_id, object, object_type, object_id FROM graph_claims),
named AS (SELECT t.run_id, nullif(c.k, '') AS name, t.type, t.id FROM type t LEFT JOIN compared c USING (v) WHERE {trimmed("t.type")} <> '')"""
_CONFLICTS = "SELECT run_id, name, count(DISTINCT type) AS types FROM named WHERE name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT type) > 1"


@query(f"WITH {_NAMES}, {_NAMED} {_CONFLICTS}")
def claims_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.type_conflicts(_claims(spark, sf_dir))


@query(f"""WITH {_NAMES}, {_NAMED}, by_id AS (SELECT run_id, id, min(type) AS type FROM named WHERE {trimmed("id")} <> '' GROUP BY ALL HAVING count(DISTINCT type) = 1),
by_name AS (SELECT run_id, name, min(type) AS type FROM named WHERE name IS NOT NULL GROUP BY run_id, name HAVING count(DISTINCT type) = 1)
SELECT c.claim_row, coalesce(nullif(c.subject_type, ''), si.type, sn.type) AS subject_type, coalesce(nullif(c.object_type, ''), oi.type, o_n.type) AS object_type FROM graph_claims c
LEFT JOIN compared sk ON sk.v = c.subject LEFT JOIN compared ok ON ok.v = c.object
LEFT JOIN by_id si ON si.run_id = c.run_id AND si.id = c.subject_id LEFT JOIN by_name sn ON sn.run_id = c.run_id AND sn.name = sk.k
LEFT JOIN by_id oi ON oi.run_id = c.run_id AND oi.id = c.object_id LEFT JOIN by_name o_n ON o_n.run_id = c.run_id AND o_n.name = ok.k""")
def claims_resolved_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.resolved_types(_claims(spark, sf_dir))


_STATUS = """unknown AS (SELECT DISTINCT claim_row FROM (SELECT claim_row, run_id, unnest(evidence_ids) AS source_id FROM graph_claims) c WHERE source_id IS NULL OR NOT EXISTS (SELECT 1 FROM evidence_refs e WHERE e.run_id = c.run_id AND e.source_id = c.source_id)),
state AS (SELECT c.claim_row, c.run_id, CASE WHEN coalesce(len(c.evidence_ids), 0) = 0 THEN 'missing' WHEN c.run_id NOT IN (SELECT run_id FROM evidence_refs WHERE run_id IS NOT NULL) THEN 'unverifiable' WHEN u.claim_row IS NOT NULL THEN 'missing' ELSE 'verified' END AS status
  FROM graph_claims c LEFT JOIN unknown u USING (claim_row))"""


@query(f"WITH {_STATUS} SELECT * FROM state")
def claims_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what a claim cites stands in its run's evidence, doesn't, or can't be told because the run has none."""
    return checks.evidence_status(_claims(spark, sf_dir), table(spark, sf_dir, "evidence_refs"))


@query("""WITH last AS (SELECT run_id, source_id, arg_max(coalesce(excerpt, ''), evidence_row) AS excerpt FROM evidence_refs GROUP BY ALL),
cited AS (SELECT claim_row, run_id, unnest(evidence_ids) AS source_id, generate_subscripts(evidence_ids, 1) AS pos FROM graph_claims)
SELECT c.claim_row, md5(string_agg(coalesce(l.excerpt, ''), ' ' ORDER BY c.pos)) AS excerpts FROM cited c LEFT JOIN last l ON l.run_id = c.run_id AND l.source_id = c.source_id GROUP BY c.claim_row""")
def claims_cited_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = checks.cited_excerpts(_claims(spark, sf_dir), table(spark, sf_dir, "evidence_refs"))
    return cited.select("claim_row", F.md5("excerpts").alias("excerpts"))


@query("""SELECT claim_row, 'e-' || substr(sha256(concat_ws('|', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))), 1, 12) AS edge_id FROM graph_claims""")
def claims_edge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("claim_row", edge_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("edge_id"))


@query(f"""WITH {KEYED}, {_STATUS} SELECT k.run_id, count(*) AS claims, round(count_if(coalesce(len(evidence_ids), 0) > 0) / count(*), 6) AS evidence_coverage_rate, round(count_if(status = 'verified') / count(*), 6) AS verified_rate,
round(count_if(p_key IS NOT NULL) / count(*), 6) AS predicate_rate, round(count_if({trimmed("subject_type")} <> '' AND {trimmed("object_type")} <> '') / count(*), 6) AS typed_rate, round(avg(confidence), 6) AS mean_confidence
FROM keyed k JOIN state s USING (claim_row) GROUP BY k.run_id""")
def claims_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: how many of its claims cite evidence, cite only what the run holds, have a controlled predicate and two types."""
    status = claims_evidence_status(spark, sf_dir).select("claim_row", "status")
    typed = (F.coalesce(trim_text(F.col("subject_type")), F.lit("")) != "") & (F.coalesce(trim_text(F.col("object_type")), F.lit("")) != "")
    cites = F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0
    rates = {"evidence_coverage_rate": cites, "verified_rate": F.col("status") == "verified", "predicate_rate": F.col("p_key").isNotNull(), "typed_rate": typed}
    return _keyed(spark, sf_dir).join(status, "claim_row").groupBy("run_id").agg(F.count("*").alias("claims"), *[ratio(F.count_if(c), F.count("*")).alias(n) for n, c in rates.items()], F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"""WITH {KEYED}, {_NAMED}, duplicate AS ({_DUPLICATES}), {_EDGES}
SELECT 'incomplete' AS finding, count(*) AS n FROM keyed WHERE s_key IS NULL OR raw_key IS NULL OR o_key IS NULL
UNION ALL SELECT 'self_loop', count(*) FROM keyed WHERE s_key = o_key
UNION ALL SELECT 'duplicate', count(*) FROM duplicate
UNION ALL SELECT 'reverse_edge', count(*) {_REVERSED}
UNION ALL SELECT 'type_conflict', count(*) FROM ({_CONFLICTS})
UNION ALL SELECT 'uncited', count(*) FROM keyed WHERE evidence_ids IS NULL OR len(evidence_ids) = 0""")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity findings of all claims, by kind."""
    claims = _claims(spark, sf_dir)
    keyed = _keyed(spark, sf_dir)
    found = {
        "incomplete": checks.incomplete(keyed), "self_loop": checks.self_loops(keyed), "duplicate": checks.duplicates(keyed), "reverse_edge": checks.reverse_edges(keyed, within=()),
        "type_conflict": checks.type_conflicts(claims), "uncited": keyed.where(F.col("evidence_ids").isNull() | (F.size("evidence_ids") == 0)),
    }
    counts = [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("finding"), "n") for name, frame in found.items()]
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.unionByName(c)
    return whole


_ARM = "split_part(run_id, '--', 1)"


@query(f"""WITH gold AS (SELECT DISTINCT run_id, source_id AS item FROM evidence_refs), cited AS (SELECT DISTINCT run_id, unnest(evidence_ids) AS item FROM graph_claims),
counts AS (SELECT coalesce(g.run_id, p.run_id) AS run_id, count(g.item) AS gold, count(p.item) AS predicted, count_if(g.item IS NOT NULL AND p.item IS NOT NULL) AS correct
  FROM gold g FULL JOIN (SELECT * FROM cited WHERE item IS NOT NULL) p ON g.run_id = p.run_id AND g.item = p.item GROUP BY 1),
total AS (SELECT {_ARM} AS arm, sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM counts GROUP BY 1)
SELECT arm, gold, predicted, correct, round(correct / nullif(predicted, 0), 6) AS precision, round(correct / nullif(gold, 0), 6) AS recall,
  round(2 * (correct / nullif(predicted, 0)) * (correct / nullif(gold, 0)) / nullif(correct / nullif(predicted, 0) + correct / nullif(gold, 0), 0), 6) AS f1 FROM total""")
def evidence_micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the evidence that claims cite matches the evidence of their run, micro-averaged per experiment arm."""
    gold = table(spark, sf_dir, "evidence_refs").select("run_id", F.col("source_id").alias("item"))
    cited = _claims(spark, sf_dir).select("run_id", F.explode("evidence_ids").alias("item")).where("item is not null")
    counts = set_counts(gold, cited, ["run_id"], "item").withColumn("arm", F.split_part("run_id", F.lit("--"), F.lit(1)))
    return micro_prf(counts, ["arm"])


@query(f"""WITH arm AS (SELECT {_ARM} AS arm, qualifiers['case_id'] AS case_id, avg(confidence) AS mean FROM graph_claims WHERE confidence IS NOT NULL GROUP BY ALL)
SELECT a.arm AS arm_a, b.arm AS arm_b, count(*) AS cases, round(avg(b.mean - a.mean), 6) AS mean_delta FROM arm a JOIN arm b ON a.case_id = b.case_id AND a.arm < b.arm GROUP BY ALL""")
def arm_paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of the cases' mean confidence between each two experiment arms, over the cases that both have."""
    arm = _claims(spark, sf_dir).where("confidence is not null").groupBy(F.split_part("run_id", F.lit("--"), F.lit(1)).alias("arm"), F.try_element_at("qualifiers", F.lit("case_id")).alias("case_id")).agg(F.avg("confidence").alias("mean"))
    a, b = arm.select(F.col("arm").alias("arm_a"), "case_id", F.col("mean").alias("ma")), arm.select(F.col("arm").alias("arm_b"), "case_id", F.col("mean").alias("mb"))
    return a.join(b, "case_id").where("arm_a < arm_b").groupBy("arm_a", "arm_b").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("mb") - F.col("ma")), 6).alias("mean_delta"))


_CASE = "nullif('EXT-' || regexp_extract(lower({0}), 'ext-(\\d+)', 1), 'EXT-')"
_MARKERS = ", ".join(f"({no}, '{p}', '{r}', {list(m)})" for no, (p, r, m) in enumerate(TRIGGERS))


@query(f"""WITH part AS (SELECT doc_id, {_CASE.format("case_id")} AS case_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\\n]+'), lambda s: {trimmed("s")}), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL AND {_CASE.format("case_id")} IS NOT NULL),
sent AS (SELECT doc_id, case_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS s_no FROM part),
name AS (SELECT case_id, min(name) AS name FROM (SELECT {_CASE.format("run_id")} AS case_id, unnest([subject, object]) AS name FROM graph_claims) WHERE length(name) > 1 GROUP BY case_id, {key("name")}),
men AS (SELECT DISTINCT s.doc_id, s.s_no, s.sentence, n.name, instr(s.sentence, n.name) AS pos FROM sent s JOIN name n ON s.case_id = n.case_id WHERE length(n.name) > 1 AND instr(s.sentence, n.name) > 0),
trig AS (SELECT * FROM (VALUES {_MARKERS}) t(no, predicate, relation, markers)),
hit AS (SELECT DISTINCT m.doc_id, m.s_no, t.no, t.predicate, t.relation, list_min(list_filter(list_transform(t.markers, lambda k: instr(m.sentence, k)), lambda i: i > 0)) AS at, list_filter(t.markers, lambda k: contains(m.sentence, k))[1] AS trigger FROM men m, trig t WHERE len(list_filter(t.markers, lambda k: contains(m.sentence, k))) > 0),
l AS (SELECT h.*, m.name, m.pos, row_number() OVER (PARTITION BY h.doc_id, h.s_no, h.no ORDER BY m.pos DESC, m.name DESC) AS k FROM hit h JOIN men m ON m.doc_id = h.doc_id AND m.s_no = h.s_no AND m.pos < h.at),
r AS (SELECT h.doc_id, h.s_no, h.no, m.name, m.pos, row_number() OVER (PARTITION BY h.doc_id, h.s_no, h.no ORDER BY m.pos, m.name) AS k FROM hit h JOIN men m ON m.doc_id = h.doc_id AND m.s_no = h.s_no AND m.pos > h.at),
edge AS (SELECT l.doc_id, l.s_no, l.no, l.pos AS lpos, l.name AS subject, r.pos AS rpos, r.name AS object, l.predicate, l.relation, l.trigger, 'e-' || substr(sha256(l.name || '|' || l.predicate || '|' || r.name), 1, 12) AS edge_id
  FROM l JOIN r ON l.doc_id = r.doc_id AND l.s_no = r.s_no AND l.no = r.no WHERE l.k <= 2 AND r.k <= 2 AND {key("l.name")} <> {key("r.name")}),
once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, edge_id ORDER BY s_no, no, lpos, subject, rpos, object) AS o FROM edge)
SELECT doc_id, edge_id, subject, predicate, relation, object, trigger FROM once WHERE o = 1""")
def candidate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between names that the runs on a document's case claim, and that stand on both sides of a trigger word in one of its sentences."""
    ends = F.explode(F.array("subject", "object")).alias("name")
    names = _claims(spark, sf_dir).select(case_label(F.col("run_id")).alias("case_id"), ends).distinct()
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "case_id", "text")).withColumn("case_id", case_label(F.col("case_id")))
    return edges_of(mentions(document_sentences(documents), names))


_PLAIN_TYPE = f"nullif({trimmed('{0}')}, '')"
_MEANT = "coalesce(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TYPE_ALIASES.items()) + "}[{0}], {0})"


@query(f"""WITH t AS (SELECT claim_row, unnest(['subject_type', 'object_type']) AS field, unnest([subject_type, object_type]) AS original FROM graph_claims), n AS (SELECT *, {_PLAIN_TYPE.replace("{0}", "original")} AS plain FROM t)
SELECT claim_row, field, original, {_MEANT.replace("{0}", "plain")} AS canonical FROM n WHERE plain IS NOT NULL AND {_MEANT.replace("{0}", "plain")} <> original""")
def claims_type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of types rewritten: labels that stand for another one, and outer blanks."""
    changed = canonical_types(_claims(spark, sf_dir)).select("claim_row", F.explode("changes").alias("c"))
    return changed.select("claim_row", "c.field", "c.original", "c.canonical")


@query("SELECT claim_row, coalesce(claim_id, run_id || '-claim-' || CASE WHEN claim_index < 1000 THEN lpad(claim_index::VARCHAR, 3, '0') ELSE claim_index::VARCHAR END) AS claim_id FROM graph_claims")
def claims_default_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_ids(_claims(spark, sf_dir)).select("claim_row", "claim_id")


@query("""WITH last AS (SELECT run_id, source_id, arg_max(coalesce(excerpt, ''), evidence_row) AS excerpt FROM evidence_refs GROUP BY ALL),
cited AS (SELECT claim_row, run_id, unnest(evidence_ids) AS source_id, generate_subscripts(evidence_ids, 1) AS pos FROM graph_claims)
SELECT c.claim_row, count(*) AS items, md5(string_agg('[' || coalesce(c.source_id, '') || '] ' || coalesce(l.excerpt, ''), chr(10) ORDER BY c.pos)) AS block FROM cited c LEFT JOIN last l ON l.run_id = c.run_id AND l.source_id = c.source_id GROUP BY c.claim_row""")
def claims_evidence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each claim cites as a prompt gives it, line by line, as a hash."""
    cited = checks.cited_evidence(_claims(spark, sf_dir), table(spark, sf_dir, "evidence_refs"))
    return cited.select("claim_row", F.size("evidence").cast("bigint").alias("items"), F.md5(evidence_block(F.col("evidence"))).alias("block"))
