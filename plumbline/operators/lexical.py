"""Lexical retrieval: postings, multiset overlap, top-k, leaving out each query's own group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_tokens


def postings(frame: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, group, token, n): how often each token stands in each text."""
    rows = frame.where(F.col(text).isNotNull()).select(key, group, F.explode(lexical_tokens(F.col(text))).alias("token"))
    return rows.groupBy(key, group, "token").agg(F.count("*").alias("n"))


def overlap_scores(queries: DataFrame, entries: DataFrame, leave_out_group: bool = True) -> DataFrame:
    """(query, entry, score): the multiset intersection of the tokens, summed inside the join's aggregate.

    ``queries`` (query, query_group, token, n) and ``entries`` (entry, entry_group, token, n) meet on the token alone; no
    pair without a common token is ever formed, and the sum is partial before the shuffle.
    """
    q = queries.withColumnRenamed("n", "qn")
    met = entries.join(q, "token")
    if leave_out_group:
        met = met.where(~F.col("entry_group").eqNullSafe(F.col("query_group")))
    return met.groupBy("query", "entry").agg(F.sum(F.least("qn", "n")).cast("double").alias("score"))


def top_k(scores: DataFrame, k: int = 10, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """The k best entries of each query by falling score, then by the entry's id as text, with their rank. The window's group
    limit keeps k rows a query and task before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("entry").cast("string"))
    return scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tier_modes(scores: DataFrame, k: int = 10) -> DataFrame:
    """The k best of each query in two modes: among the confirmed entries alone, and among all; ``scores`` (query, entry,
    confirmed, score). The overlap is computed once and serves both."""
    modes = F.when(F.col("confirmed"), F.array(F.lit("confirmed_only"), F.lit("confirmed_plus_candidate"))).otherwise(F.array(F.lit("confirmed_plus_candidate")))
    return top_k(scores.withColumn("mode", F.explode(modes)), k, ("mode", "query"))


def mode_summary(queries: DataFrame, best: DataFrame) -> DataFrame:
    """Per mode: queries, mean number retrieved, share of queries that retrieve anything, share of candidates among all
    retrieved (null where nothing is)."""
    per = best.groupBy("mode", "query").agg(F.count("*").alias("n"), F.count_if(~F.col("confirmed")).alias("candidates"))
    total = per.groupBy("mode").agg(F.sum("n").alias("n"), F.count("*").alias("answered"), F.sum("candidates").alias("candidates"))
    asked = queries.select("query").distinct().agg(F.count("*").alias("queries")).withColumn("mode", F.explode(F.array(F.lit("confirmed_only"), F.lit("confirmed_plus_candidate"))))
    joined = asked.join(total, "mode", "left")
    rate = lambda a, b: F.round(F.try_divide(F.coalesce(F.col(a), F.lit(0)), F.col(b)), 6)
    return joined.select("mode", "queries", rate("n", "queries").alias("mean_retrieved"), rate("answered", "queries").alias("answered_rate"), F.round(F.try_divide("candidates", "n"), 6).alias("candidate_share"))
