"""Candidate edges from sentences: names on both sides of a trigger word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import edge_id, metric_key, sentences

# Predicate, relation and markers of each trigger, in order.
TRIGGERS = (
    ("导致", "causes", ("导致", "造成", "引起", "使得")),
    ("表现为", "manifests_as", ("表现为", "出现", "呈现")),
    ("需要", "requires", ("需要", "必须", "应当")),
    ("采用", "diagnosed_by", ("采用", "使用", "通过")),
    ("预防", "prevents", ("预防", "防止", "避免")),
    ("包含", "part_of", ("包含", "包括", "由", "组成")),
)


def document_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, case_id, s_no, sentence) of the documents that belong to a case."""
    rows = documents.where("text is not null and case_id is not null").select("doc_id", "case_id", F.posexplode(sentences(F.col("text"))).alias("s_no", "sentence"))
    return rows


def mentions(sentence_rows: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, s_no, sentence, name, pos): names of a case that stand in its sentences, at their first place.

    Sentences and names meet on case and the name's first two characters, so no sentence is compared with all names of a
    large case. Of names with one key (blanks and letter case aside) the first in order counts.
    """
    places = F.sequence(F.lit(1), F.length("sentence") - 1)
    grams = sentence_rows.where("length(sentence) > 1").select("*", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("sentence"), i, F.lit(2))))).alias("head"))
    distinct = names.where("length(name) > 1").groupBy("case_id", metric_key(F.col("name")).alias("key")).agg(F.min("name").alias("name"))
    headed = distinct.select("case_id", "name", F.substring("name", 1, 2).alias("head"))
    met = grams.join(headed, ["case_id", "head"]).withColumn("pos", F.expr("instr(sentence, name)"))
    return met.where("pos > 0").select("doc_id", "s_no", "sentence", "name", "pos")


def candidate_edges(mention_rows: DataFrame, per_document: int | None = None) -> DataFrame:
    """(doc_id, edge_id, subject, predicate, relation, object, trigger): for each trigger of a sentence the two nearest names
    before it with the first two behind it; the first occurrence of an edge counts; all of a document are kept, or its first ``per_document``."""
    held = mention_rows.groupBy("doc_id", "s_no", "sentence").agg(F.array_sort(F.collect_set(F.struct("pos", "name"))).alias("names")).where("size(names) > 1")
    found = []
    for no, (predicate, relation, markers) in enumerate(TRIGGERS):
        at = F.least(*[F.nullif(F.expr(f"instr(sentence, '{m}')"), F.lit(0)) for m in markers])
        first = F.coalesce(*[F.when(F.col("sentence").contains(m), F.lit(m)) for m in markers])
        found.append(F.when(at.isNotNull(), F.struct(F.lit(no).alias("no"), F.lit(predicate).alias("predicate"), F.lit(relation).alias("relation"), at.alias("at"), first.alias("trigger"))))
    hits = held.select("doc_id", "s_no", "names", F.explode(F.array_compact(F.array(*found))).alias("t")).select("doc_id", "s_no", "names", "t.*")
    before, behind = F.filter("names", lambda n: n["pos"] < F.col("at")), F.filter("names", lambda n: n["pos"] > F.col("at"))
    sided = hits.select("*", F.slice(F.reverse(before), 1, 2).alias("left"), F.slice(behind, 1, 2).alias("right"))
    pairs = sided.select("doc_id", "s_no", "no", "predicate", "relation", "trigger", F.explode("left").alias("l"), "right").select("*", F.explode("right").alias("r"))
    edges = pairs.where(metric_key(F.col("l.name")) != metric_key(F.col("r.name"))).select("doc_id", F.struct("s_no", "no", "l.pos", "l.name", F.col("r.pos").alias("rpos"), F.col("r.name").alias("rname")).alias("place"), edge_id(F.col("l.name"), F.col("predicate"), F.col("r.name")).alias("edge_id"), F.col("l.name").alias("subject"), "predicate", "relation", F.col("r.name").alias("object"), "trigger")
    firsts = edges.groupBy("doc_id", "edge_id").agg(F.min(F.struct("place", "subject", "predicate", "relation", "object", "trigger")).alias("e")).select("doc_id", "edge_id", "e.*")
    if per_document is not None:
        firsts = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).where(F.col("rank") <= per_document)
    return firsts.select("doc_id", "edge_id", "subject", "predicate", "relation", "object", "trigger")
