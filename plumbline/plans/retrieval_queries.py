"""Lexical retrieval over documents: queries are the documents whose id is divisible by 50, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import case_label, lexical_tokens
from plumbline.operators.best_overlap import best_overlaps
from plumbline.operators.lexical import mode_summary, tier_modes, top_k
from plumbline.operators.metrics import ratio
from plumbline.plans.catalogue import query
from plumbline.plans.sql import tokens
from plumbline.session import spread, table

_RANKED = f"""WITH entry AS (SELECT doc_id, source, token, count(*) AS n FROM (SELECT doc_id, source, unnest({tokens("text")}) AS token FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
scored AS (
  SELECT q.doc_id AS query, d.doc_id AS entry, d.source AS entry_source, q.source AS query_source, sum(least(q.n, d.n))::DOUBLE AS score
  FROM entry q JOIN entry d ON q.token = d.token WHERE q.doc_id % 50 = 0 AND @LEFT_OUT GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, entry::VARCHAR) AS rank FROM scored WHERE score > 0)
"""
_OTHER = "d.source IS DISTINCT FROM q.source"


def _documents(spark: SparkSession, sf_dir: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(queries, entries): the tokens of the documents, which are told by id and source; those of one ``group`` don't meet."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where("text is not null")
    named = lambda side: documents.select(F.col("doc_id").alias(side), F.col("source").alias(f"{side}_key"), F.col(group).alias(f"{side}_group"), lexical_tokens(F.col("text")).alias("tokens"))
    return named("query").where("query % 50 = 0"), named("entry")


def ranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return top_k(best_overlaps(*_documents(spark, sf_dir, "source"), k), k)


@query(_RANKED.replace("@LEFT_OUT", _OTHER) + "SELECT query, entry, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10")
def retrieval_topk_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query", "entry", "score", "rank")


@query(_RANKED.replace("@LEFT_OUT", "q.doc_id <> d.doc_id") + """, best AS (SELECT * FROM ranked WHERE rank <= 10),
asked AS (SELECT doc_id AS query, source, EXISTS (SELECT 1 FROM documents o WHERE o.source = q.source AND o.doc_id <> q.doc_id AND o.text IS NOT NULL) AS present FROM documents q WHERE doc_id % 50 = 0 AND text IS NOT NULL),
per AS (SELECT a.query, a.present, count(b.entry) AS n, count(b.entry) FILTER (WHERE b.entry_source IS NOT DISTINCT FROM b.query_source) AS same FROM asked a LEFT JOIN best b USING (query) GROUP BY ALL)
SELECT count(*) AS queries, count(*) FILTER (WHERE present) AS present, round(count(*) FILTER (WHERE same > 0) / count(*), 6) AS same_source_hit_rate, round(avg(n), 6) AS mean_retrieved, sum(same)::BIGINT AS same_source_hits, (sum(n) - sum(same))::BIGINT AS other_source_hits FROM per""")
def retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries, those whose source has other documents, how many find one of them among the ten best, and hits by source. Only
    the query itself is left out."""
    queries, entries = _documents(spark, sf_dir, "doc_id")
    best = top_k(best_overlaps(queries, entries.where("entry is not null"))).groupBy("query").agg(F.count("*").alias("n"), F.count_if(F.col("entry_key").eqNullSafe(F.col("query_key"))).alias("same"))
    documents = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source")
    sources = lambda c: documents.select(F.col("doc_id").alias(c), F.col("source").alias(f"{c}_source"))
    held = documents.where("source is not null").groupBy(F.col("source").alias("query_source")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    asked = sources("query").where("query % 50 = 0").join(held, "query_source", "left").select("query", F.coalesce((F.col("low") != F.col("query")) | (F.col("high") != F.col("query")), F.lit(False)).alias("present"))
    times = asked.groupBy("query", "present").agg(F.count("*").alias("times"))
    per = times.join(best, "query", "left").withColumns({c: F.col("times") * F.col(c) for c in ("n", "same")})
    zero = lambda c: F.coalesce(c, F.lit(0))
    hits = F.sum(zero(F.col("same")))
    return per.agg(F.count("*").alias("queries"), F.count_if("present").alias("present"), ratio(F.count_if(F.col("same") > 0), F.count("*")).alias("same_source_hit_rate"), F.round(F.avg(zero(F.col("n"))), 6).alias("mean_retrieved"), hits.alias("same_source_hits"), (F.sum(zero(F.col("n"))) - hits).alias("other_source_hits"))


_CLAIM = "concat_ws(' ', coalesce(subject, ''), coalesce(predicate, ''), coalesce(object, ''))"
_MODES = f"""WITH tok AS (SELECT claim_row AS entry, nullif('EXT-' || regexp_extract(lower(run_id), 'ext-(\\d+)', 1), 'EXT-') AS grp, coalesce(len(evidence_ids), 0) > 0 AS confirmed, unnest({tokens(_CLAIM)}) AS token FROM graph_claims),
entry AS (SELECT *, count(*) AS n FROM tok GROUP BY ALL), qtok AS (SELECT doc_id AS query, nullif('EXT-' || regexp_extract(lower(case_id), 'ext-(\\d+)', 1), 'EXT-') AS grp, unnest({tokens("text")}) AS token FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0),
q AS (SELECT *, count(*) AS n FROM qtok GROUP BY ALL), scored AS (SELECT q.query, e.entry, e.confirmed, sum(least(q.n, e.n))::DOUBLE AS score FROM q JOIN entry e ON e.token = q.token WHERE e.grp IS DISTINCT FROM q.grp GROUP BY ALL),
moded AS (SELECT s.*, m.mode FROM scored s JOIN (VALUES ('confirmed_only', true), ('confirmed_plus_candidate', true), ('confirmed_plus_candidate', false)) m(mode, c) ON m.c = s.confirmed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mode, query ORDER BY score DESC, entry::VARCHAR)::INTEGER AS rank FROM moded), best AS (SELECT * FROM ranked WHERE rank <= 10)"""


def _moded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, best): documents against claims of other cases, the confirmed ones being those that cite evidence."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("subject", "predicate", "object")])
    claims = spread(table(spark, sf_dir, "graph_claims").select("claim_row", "run_id", "subject", "predicate", "object", (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0).alias("confirmed")))
    entries = claims.select(F.col("claim_row").alias("entry"), F.col("confirmed").alias("entry_key"), case_label(F.col("run_id")).alias("entry_group"), lexical_tokens(text).alias("tokens"))
    documents = spread(table(spark, sf_dir, "documents").where("doc_id % 50 = 0 and text is not null").select("doc_id", "case_id", "text"))
    queries = documents.select(F.col("doc_id").alias("query"), F.lit(None).cast("string").alias("query_key"), case_label(F.col("case_id")).alias("query_group"), lexical_tokens(F.col("text")).alias("tokens"))
    scores = best_overlaps(queries, entries, apart=True).withColumnRenamed("entry_key", "confirmed")
    return queries.select("query"), tier_modes(scores)


@query(_MODES + " SELECT mode, query, entry, confirmed, score, rank FROM best")
def retrieval_tier_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best claims for each query document, among confirmed claims alone and among all; its own case left out."""
    return _moded(spark, sf_dir)[1].select("mode", "query", "entry", "confirmed", "score", "rank")


@query(_MODES + """, per AS (SELECT mode, query, count(*) AS n, count(*) FILTER (WHERE NOT confirmed) AS candidates FROM best GROUP BY ALL), asked AS (SELECT count(DISTINCT doc_id) AS queries FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0)
SELECT mode, queries, round(sum(n) / queries, 6) AS mean_retrieved, round(count(*) / queries, 6) AS answered_rate, round(sum(candidates) / sum(n), 6) AS candidate_share FROM per, asked GROUP BY mode, queries""")
def retrieval_tier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_summary(*_moded(spark, sf_dir))


@query(f"""WITH token AS (SELECT doc_id, source, unnest({tokens("text")}) AS token FROM documents WHERE text IS NOT NULL)
SELECT source, count(*) AS tokens, count(DISTINCT token) AS distinct_tokens, count(DISTINCT doc_id) AS documents FROM token GROUP BY source""")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, distinct tokens and documents with any token per source. One pass: a document's tokens are counted where it is
    read, and each document is told by its first token."""
    listed = spread(table(spark, sf_dir, "documents").select("source", "text")).where("text is not null").select("source", lexical_tokens(F.col("text")).alias("t"))
    each = listed.select("source", F.posexplode("t").alias("place", "token"))
    by_token = each.groupBy("source", "token").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("first"))
    return by_token.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_tokens"), F.sum("first").alias("documents"))
