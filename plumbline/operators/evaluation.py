"""Evaluation of answers and decisions: set scores of a sample, micro averages, three-way decisions, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import metric_key, trimmed


def prf(correct: Column, predicted: Column, gold: Column) -> dict[str, Column]:
    """precision, recall and f1 of sets: nothing predicted is right where nothing was wanted, nothing wanted is found."""
    p = F.when(predicted > 0, correct / predicted).when(gold == 0, 1.0).otherwise(0.0)
    r = F.when(gold > 0, correct / gold).otherwise(1.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return {"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)}


def keyed_sets(held: Column) -> Column:
    """The struct (entity, claim, statement, evidence) of sets that are compared, from what an answer holds."""
    distinct = lambda names: F.array_distinct(F.transform(names, metric_key))
    claims = F.array_distinct(F.transform(held["claims"], lambda c: F.concat_ws("|", *[metric_key(c[k]) for k in ("subject", "predicate", "object")])))
    return F.struct(distinct(held["entities"]).alias("entity"), claims.alias("claim"), distinct(held["statements"]).alias("statement"), held["evidence"].alias("evidence"))


#: The metrics of a role: those of the extracting one, and those of any other.
EXTRACTING, METRICS, OTHER_METRICS = "a1", ("evidence", "entity", "claim"), ("evidence", "statement")


def scored_samples(pairs: DataFrame, role: str = "role") -> DataFrame:
    """``pairs`` (.., sets, gold_sets) with one row a metric of the role: metric, correct, predicted, gold and the scores."""
    one = lambda m: F.struct(F.lit(m).alias("metric"), F.size(F.array_intersect(f"sets.{m}", f"gold_sets.{m}")).alias("correct"), F.size(f"sets.{m}").alias("predicted"), F.size(f"gold_sets.{m}").alias("gold"))
    metrics = F.when(F.col(role) == EXTRACTING, F.array(*map(one, METRICS))).otherwise(F.array(*map(one, OTHER_METRICS)))
    rows = pairs.withColumn("m", F.explode(metrics)).drop("sets", "gold_sets").select("*", "m.*").drop("m")
    counted = [F.col(c).cast("bigint") for c in ("correct", "predicted", "gold")]
    return rows.withColumns(dict(zip(("correct", "predicted", "gold"), counted))).withColumns(prf(*counted))


def micro_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Scores of scored_samples() from the summed counts, with the number of samples that have the metric."""
    total = scored.groupBy(*by, "metric").agg(F.count("*").alias("available"), *[F.sum(c).alias(c) for c in ("correct", "predicted", "gold")])
    return total.withColumns(prf(F.col("correct"), F.col("predicted"), F.col("gold")))


def decision_evaluation(audits: DataFrame, gold: DataFrame, labels: tuple[str, str, str], strict: bool = True) -> DataFrame:
    """One row: audits (id, decision, place) against gold (id, label, place).

    ``labels`` are the accepting, the undecided and the rejecting decision. Of several audits of an id the last counts, of
    several gold rows the first, even if its label is blank; blank ids count nowhere, audits with another decision neither.
    A blank label is pending; any other label raises, or is counted as unknown if not ``strict``. Rates without a denominator
    are null, and macro_f1 is the mean of the classes that have an F1.
    """
    accept, undecided, reject = labels
    plain = lambda c: F.lower(trimmed(F.col(c)))
    blank = lambda c: F.coalesce(trimmed(F.col(c)), F.lit("")) == ""
    audited = audits.where(~blank("id") & plain("decision").isin(*labels)).groupBy("id").agg(F.max_by(plain("decision"), "place").alias("predicted"), F.count("*").alias("audits"))
    firsts = gold.where(~blank("id")).groupBy(trimmed(F.col("id")).alias("id")).agg(F.min_by(F.struct(F.coalesce(plain("label"), F.lit("")).alias("label")), "place")["label"].alias("label"), F.count("*").alias("rows"))
    joined = firsts.join(audited, "id", "full")
    known = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    if strict:
        joined = joined.withColumn("label", F.when(known | F.col("label").isNull() | (F.col("label") == ""), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), "label")).cast("string")))
    met = known & F.col("predicted").isNotNull()
    cells = {(g, p): F.count_if(met & (F.col("label") == g) & (F.col("predicted") == p)).alias(f"n_{i}{j}") for i, g in enumerate(labels) for j, p in enumerate(labels)}
    counts = joined.agg(
        F.count("label").alias("gold_ids"), F.count_if(F.col("label") == "").alias("pending"), F.count_if(~known & (F.col("label") != "")).alias("unknown"), F.count_if(known & F.col("predicted").isNull()).alias("missing_audits"),
        F.sum(F.col("rows") - 1).alias("repeated_gold_rows"), F.count_if(F.col("audits") > 1).alias("repeated_audit_ids"), F.count_if(met).alias("evaluated"), *cells.values(),
    )
    n = {(g, p): F.col(f"n_{i}{j}") for i, g in enumerate(labels) for j, p in enumerate(labels)}
    support = {g: sum((n[g, p] for p in labels), F.lit(0)) for g in labels}
    chosen = {p: sum((n[g, p] for g in labels), F.lit(0)) for p in labels}

    def class_f1(label: str) -> Column:
        p, r = F.try_divide(n[label, label], chosen[label]), F.try_divide(n[label, label], support[label])
        return F.try_divide(2 * p * r, p + r)

    f1s = F.filter(F.array(*map(class_f1, labels)), lambda x: x.isNotNull())
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    return counts.select(
        "gold_ids", "pending", "unknown", "missing_audits", "repeated_gold_rows", "repeated_audit_ids", "evaluated",
        rate(sum((n[g, g] for g in labels), F.lit(0)), F.col("evaluated")).alias("accuracy"),
        F.round(F.try_divide(F.aggregate(f1s, F.lit(0.0), lambda a, x: a + x), F.size(f1s)), 6).alias("macro_f1"),
        F.round(1 - F.try_divide(n[accept, accept], chosen[accept]), 6).alias("accepted_error_rate"),
        rate(n[reject, accept], support[reject]).alias("unsafe_accept_rate"), rate(n[accept, reject], support[accept]).alias("over_rejection_rate"),
        rate(n[undecided, undecided] + n[undecided, reject], support[undecided]).alias("undecided_capture_rate"),
    )


def run_summary(results: DataFrame, by: list[str], status: str, complete: str, terminal: tuple[str, ...], latency: str) -> DataFrame:
    """Per group: results, those that have ended, the share of these that are complete (null if none has), mean latency of the
    results that have one."""
    ended, done = F.count_if(F.col(status).isin(*terminal)), F.count_if(F.col(status) == complete)
    return results.groupBy(*by).agg(F.count("*").alias("results"), done.alias("complete"), ended.alias("ended"), F.round(F.try_divide(done, ended), 6).alias("completion_rate"), F.round(F.avg(latency), 6).alias("mean_latency"))


def latest_status(results: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """(key, status, attempts): the status of each key's last result; a partial aggregate, no window over a hot key."""
    return results.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count("*").alias("attempts"))


def resume_plan(planned: DataFrame, results: DataFrame, key: str, order: list[str], status: str, terminal: tuple[str, ...]) -> DataFrame:
    """Every planned key with its last status and whether it still has to run: it has no result, or its last one hasn't ended."""
    latest = latest_status(results, key, order, status)
    return planned.select(key).distinct().join(latest, key, "left").select(key, "status", F.coalesce("attempts", F.lit(0)).alias("attempts"), (~F.coalesce(F.col("status").isin(*terminal), F.lit(False))).alias("to_run"))


def first_success(attempts: DataFrame, key: str, order: list[str], done: Column) -> DataFrame:
    """(key, attempts, successful_at): the number of a key's attempts and which of them was the first successful one, null if
    none was. Counted, not collected: a key may have any number of attempts."""
    placed = attempts.select(key, F.struct(*order).alias("at"), done.alias("done"))
    first = placed.where("done").groupBy(key).agg(F.min("at").alias("first"))
    return placed.join(first, key, "left").groupBy(key).agg(F.count("*").alias("attempts"), F.nullif(F.count_if(F.col("at") <= F.col("first")), F.lit(0)).alias("successful_at"))


def matched(left: DataFrame, right: DataFrame, on: list[str], what: str) -> DataFrame:
    """Left join whose right side must exist for every row: a miss raises and names what is missing."""
    marked = right.withColumn("_there", F.lit(True))
    joined = left.join(marked, on, "left")
    missing = F.raise_error(F.concat(F.lit(f"{what}: no match for "), F.concat_ws("/", *[F.col(c).cast("string") for c in on])))
    return joined.where(F.when(F.col("_there"), True).otherwise(missing.cast("boolean"))).drop("_there")
