"""Mixing sources to target weights.

Systematic sampling: within each source every document expects so many copies; the expected copies are summed along the
documents' sizes (and, within a size, a hashed order), one random offset is added, and a document is emitted once for each integer boundary that its stretch
crosses. No document gets more than its expectation rounded up, so at most max_repeats copies.

The total is the largest for which every source that has tokens can supply its target share within max_repeats (or the
total given); a source whose cap binds supplies what it can, and the report shows target and actual share of each.

Prefix sums run in three steps (sums per slice of hashes, offsets of the slices, running sums within a slice), so a
source that holds a third of all rows is spread over as many tasks as it has slices.

Defined results: null and empty texts have no tokens and are never used; sources without a target take no part; a
target without documents appears in the report with a share of 0; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.tokenise import VOCABULARY, token_counts
from plumbline.session import cut, spread, table

#: Rows that one slice of a source holds on average.
SLICE_ROWS = 50_000


def prefix_sums(frame: DataFrame, group: str, order: str, value: str, slice_rows: int = SLICE_ROWS, rank: str | None = None) -> DataFrame:
    """``frame`` with the column before: the sum of ``value`` (decimal) over the rows of the group ahead of this one.

    ``order`` is a non-negative bigint below 2^62, evenly spread (a hash) and unique within the group; rows of a lower ``rank``
    (a small non-negative int of few values) go first.
    """
    rows = frame.count()
    slices = max(1, -(-rows // slice_rows))
    first = F.lit(0) if rank is None else F.col(rank)
    sliced = frame.withColumn("slice", first.cast("bigint") * slices + (F.col(order) / (2**62 // slices + 1)).cast("bigint"))
    sums = sliced.groupBy(group, "slice").agg(F.sum(value).alias("slice_sum"))
    ahead = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "slice", F.coalesce(F.sum("slice_sum").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy(group, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = sliced.withColumn("inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return running.join(offsets, [group, "slice"]).withColumn("before", F.col("offset") + F.col("inner")).drop("slice", "inner", "offset")


def sized_documents(spark: SparkSession, documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the documents whose source has a target and whose text has tokens."""
    named = documents.join(targets.select("source").distinct(), "source", "left_semi").where("text is not null and text <> ''")
    sized = named.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", token_counts(spark, F.col("text"), path).alias("tokens"))
    return cut(sized.where("tokens > 0"))


def mixture_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, times_available: float | None = None) -> DataFrame:
    """Per target source: available tokens and expected copies a document (decimal, at most max_repeats).

    The total is ``total_tokens``, or so many ``times_available`` tokens of the sources with a share, or the most that all of
    them can supply at their shares.
    """
    held = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("documents"))
    plan = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).join(held, "source", "left")
    reach = F.col("available") * F.col("max_repeats") / F.when(F.col("target_share") > 0, F.col("target_share"))
    everywhere = Window.partitionBy(F.lit(1))  # one row a source
    if total_tokens is not None:
        total = F.lit(float(total_tokens))
    elif times_available is not None:
        total = F.sum(F.when(F.col("target_share") > 0, F.col("available"))).over(everywhere) * times_available
    else:
        total = F.min(reach).over(everywhere)
    plan = plan.withColumn("total", total)
    copies = F.least(F.col("total") * F.col("target_share") / F.col("available"), F.col("max_repeats").cast("double"))
    return plan.withColumn("copies", F.coalesce(F.floor(copies * 1e9) / 1e9, F.lit(0.0)).cast("decimal(18,9)"))


def mixed_documents(sized: DataFrame, plan: DataFrame, seed: int = 8) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used, each with the number of its copies."""
    expected = sized.join(plan.select("source", F.col("copies").alias("expected")), "source")
    ordered = expected.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 2))
    # documents of about the same size (an eighth of a power of two) are neighbours, so the sizes of those taken even out
    ordered = ordered.withColumn("class", F.floor(8 * F.log2("tokens")).cast("int"))
    summed = prefix_sums(ordered, "source", "place", "expected", rank="class")
    start = (F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source"), F.lit(10**9)) / 10**9).cast("decimal(18,9)")
    crossed = F.floor(start + F.col("before") + F.col("expected")) - F.floor(start + F.col("before"))
    return summed.select("doc_id", "source", "tokens", crossed.cast("int").alias("copies")).where("copies > 0")


def mixture_report(used: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of every target source, with the copies of its most used document."""
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents_used"))
    whole = plan.select("source", "target_share", "max_repeats", "available").join(got, "source", "left").withColumn("sum", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole.select("source", "target_share", F.round(zero(F.col("tokens") / F.col("sum")), 6).alias("actual_share"), zero(F.col("tokens")).alias("tokens"), zero(F.col("available")).alias("available_tokens"), "max_repeats", zero(F.col("most_copies")).alias("most_copies"), zero(F.col("documents_used")).alias("documents_used"))


def _mixed(spark: SparkSession, sf_dir: str, times_available: float | None = None) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "mix_targets")
    sized = sized_documents(spark, spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), targets)
    plan = mixture_plan(sized, targets, times_available=times_available)
    return mixed_documents(sized, plan), plan


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_report(*_mixed(spark, sf_dir))


def p8_capped_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a mixture of twice the tokens at hand: where a source's max_repeats binds, it supplies what it can."""
    return mixture_report(*_mixed(spark, sf_dir, times_available=2.0))
