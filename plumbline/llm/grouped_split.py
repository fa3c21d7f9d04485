"""Splits that keep related records together.

Hash-to-min components, then weighted rendezvous hashing of whole components onto the splits.

Nodes are case numbers and, for the splits, sample_ids. A record ties the cases and the sample_id that it names; cases
that share an author or a source document are tied to the smallest case of that author or document, so a shared value
costs one edge a case and never a pair of cases. Cluster members are rows, not arrays: no component is ever held by one
task as a whole, and the members of a large cluster never meet on one join key.

Defined results: a record that names neither a case nor a sample_id is a group by itself; null, blank and placeholder
sample_ids, authors and documents tie nothing; empty tables give empty results; without a positive share the split is
null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import cut, table

#: A case name: ``ext``, any letter case, optional separator and zeros, a number; not inside a longer word.
CASE = r"(?i)(?<![\p{L}\p{N}])ext[\s_.:#/\-]*0*(\d{1,18})(?![\p{L}\p{N}])"
#: What stands for no value.
PLACEHOLDERS = ("", "unknown", "n/a", "none", "-")


def case_number(column: Column) -> Column:
    """The number of the first case that a text names, or null."""
    found = F.regexp_extract(column, CASE, 1)
    return F.when(found != "", found.cast("bigint"))


def tie_value(column: Column) -> Column:
    """A shared value in the form that is compared, or null where it ties nothing."""
    plain = F.lower(F.trim(F.regexp_replace(column, r"^[\s 　]+|[\s 　]+$", "")))
    return F.when(~plain.isin(*PLACEHOLDERS), plain)


def _ties(cases: DataFrame, value: str) -> DataFrame:
    """Edges (a, b) from each case to the smallest case with the same ``value``."""
    held = cases.select("case", F.col(value).alias("value")).where("value is not null").distinct()
    least = held.groupBy("value").agg(F.min("case").alias("b"))
    return held.join(least, "value").where("case <> b").select(F.col("case").alias("a"), "b")


#: Members from which a cluster counts as large, or this part of all members, whichever is more: at most 10,000 are large.
LARGE_CLUSTER, LARGE_PART = 100_000, 10_000


def _with_least(members: DataFrame, total: int, large_cluster: int = LARGE_CLUSTER) -> DataFrame:
    """``members`` (v, u) with m, the smallest member of v's cluster.

    The clusters that are large, of which there can only be LARGE_PART, are sent to all tasks; so their members needn't
    be brought together. The others meet their minimum by an ordinary join.
    """
    least = members.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    bound = max(large_cluster, total // LARGE_PART)
    if total <= bound:
        return members.join(least.drop("n"), "v")
    large = F.broadcast(least.where(F.col("n") > bound).drop("n"))
    rest = members.join(large.select("v"), "v", "left_anti")
    return members.join(large, "v").unionByName(rest.join(least.where(F.col("n") <= bound).drop("n"), "v"))


def hash_to_min(edges: DataFrame, max_rounds: int = 60, large_cluster: int = LARGE_CLUSTER) -> DataFrame:
    """(node, component): the smallest node of each node's connected component.

    Each round every node sends its cluster to the cluster's minimum, and the minimum to every member, until no row
    changes: as many rows as before, none of them new. ``edges`` (a, b) are bigint pairs; self-loops and repeats do no harm.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    members = cut(both.union(both.select("a", F.col("a").alias("b"))).toDF("v", "u").distinct())
    size = members.count()
    for _ in range(max_rounds):
        sent = _with_least(members, size, large_cluster)
        # the cluster goes to its minimum, the minimum to the members; a node that is no minimum keeps just that link
        grown = cut(sent.select(F.col("m").alias("v"), "u").union(sent.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct())
        now = grown.count()
        stable = now == size and grown.join(members, ["v", "u"], "left_anti").isEmpty()
        members, size = grown, now
        if stable:
            return members.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")
    raise RuntimeError(f"no stable components after {max_rounds} rounds over {size} rows")


def record_cases(records: DataFrame) -> DataFrame:
    """(record_id, sample_id, by_case, by_sample): the case numbers that each record names."""
    return records.select(
        F.col("record_id").cast("bigint").alias("record_id"),
        F.col("metadata.sample_id").alias("sample_id"),
        case_number(F.col("metadata.case_id")).alias("by_case"),
        case_number(F.regexp_replace(F.col("metadata.sample_id"), "_", "-")).alias("by_sample"),
    )


def _case_edges(named: DataFrame, registry: DataFrame) -> DataFrame:
    """(a, b): the cases that records or the registry tie together."""
    both = named.where("by_case <> by_sample").select(F.greatest("by_case", "by_sample").alias("a"), F.least("by_case", "by_sample").alias("b")).distinct()
    cases = registry.select(
        case_number(F.col("case_id")).alias("case"), tie_value(F.col("author_id")).alias("author"), tie_value(F.col("source_document")).alias("document")
    ).where("case is not null")
    return both.union(_ties(cases, "author")).union(_ties(cases, "document"))


def case_components(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(node, component) over all case numbers that records or the registry tie together."""
    return hash_to_min(_case_edges(record_cases(records), registry))


def record_groups(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(record_id, sample_id, group_case): the smallest case of each record's group, null where it names none."""
    named = record_cases(records).withColumn("case", F.coalesce("by_case", "by_sample"))
    found = named.join(case_components(records, registry), named["case"] == F.col("node"), "left")
    return found.select("record_id", "sample_id", F.coalesce("component", "case").alias("group_case"))


def sample_node(sample_id: Column) -> Column:
    """The node of a sample_id: 60 bits of its MD5 above all case numbers, or null where it ties nothing. Should two
    sample_ids ever share a node, their groups merge and nothing is torn apart."""
    return F.conv(F.substring(F.md5(tie_value(sample_id)), 1, 15), 16, 10).cast("bigint") + F.lit(2**62)


def split_groups(records: DataFrame, registry: DataFrame) -> DataFrame:
    """(record_id, split_group): the group of each record over cases and sample_ids alike, named by its smallest node."""
    named = record_cases(records).withColumn("sample", sample_node(F.col("sample_id"))).withColumn("case", F.coalesce("by_case", "by_sample"))
    through = named.where("case is not null and sample is not null").select(F.col("sample").alias("a"), F.col("case").alias("b")).distinct()
    keyed = named.withColumn("key", F.coalesce("case", "sample"))
    found = keyed.join(hash_to_min(_case_edges(named, registry).union(through)), keyed["key"] == F.col("node"), "left")
    name = F.coalesce(F.concat(F.lit("g"), F.coalesce("component", "key").cast("string")), F.concat(F.lit("r"), F.col("record_id").cast("string")))
    return found.select("record_id", name.alias("split_group"))


def assign_splits(groups: DataFrame, targets: DataFrame, seed: int = 20) -> DataFrame:
    """``groups`` with a column split: weighted rendezvous hashing of each split_group over the rows of ``targets``.

    A split's score is -weight / ln(h), h the hash of group and split in (0, 1); the largest wins. A change of one
    weight moves only the groups that this split gains or loses.
    """
    shares = [{"name": r["split_name"], "weight": float(r["target_share"])} for r in targets.where("target_share > 0").orderBy("split_name").collect()]
    if not shares:
        return groups.withColumn("split", F.lit(None).cast("string"))

    def score(t: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), t["name"], "split_group")), 1, 13), 16, 10).cast("double")
        return F.struct((-t["weight"] / F.log((bits + 0.5) / float(2**52))).alias("score"), t["name"].alias("name"))

    table = F.from_json(F.lit(json.dumps(shares, ensure_ascii=False)), "array<struct<name:string,weight:double>>")
    return groups.withColumn("split", F.array_max(F.transform(table, score))["name"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = record_groups(table(spark, sf_dir, "chat_records"), table(spark, sf_dir, "case_registry"))
    return groups.where("group_case is not null").select("record_id", "group_case")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = split_groups(table(spark, sf_dir, "chat_records"), table(spark, sf_dir, "case_registry"))
    return assign_splits(groups, table(spark, sf_dir, "split_targets")).select("record_id", "split_group", "split")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: its target and actual share of the records and the groups it holds."""
    counts = p5_splits(spark, sf_dir).groupBy("split", "split_group").agg(F.count("*").alias("n"))
    counts = counts.groupBy("split").agg(F.sum("n").alias("records"), F.count("*").alias("groups"), F.max("n").alias("largest_group"))
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    shared = targets.join(counts, "split", "left").withColumn("total", F.sum("records").over(Window.partitionBy(F.lit(1))))  # one row a split
    return shared.select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("groups", F.lit(0)).alias("groups"), "largest_group", F.round(F.coalesce("records", F.lit(0)) / F.col("total"), 6).alias("actual_share"))


def p5_torn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind of tie: its values, those that several records name, and those whose records lie in two splits (none)."""
    records, registry = table(spark, sf_dir, "chat_records"), table(spark, sf_dir, "case_registry")
    named = record_cases(records).select("record_id", tie_value(F.col("sample_id")).alias("sample"), F.array_distinct(F.array_compact(F.array("by_case", "by_sample"))).alias("cases"))
    placed = named.join(p5_splits(spark, sf_dir).select("record_id", "split"), "record_id")
    by_sample = placed.where("sample is not null").select(F.lit("sample_id").alias("tie"), F.col("sample").alias("value"), "split")
    of_case = placed.select(F.explode("cases").alias("case"), "split").groupBy("case", "split").agg(F.count("*").alias("n"))
    by_case = of_case.select(F.lit("case_id").alias("tie"), F.col("case").cast("string").alias("value"), "split", "n")
    shared = F.explode(F.array(*[F.struct(F.lit(c).alias("tie"), tie_value(F.col(c)).alias("value")) for c in ("author_id", "source_document")])).alias("t")
    through = registry.select(case_number(F.col("case_id")).alias("case"), shared).select("case", "t.*").where("value is not null").distinct().join(of_case, "case").select("tie", "value", "split", "n")
    each = by_sample.withColumn("n", F.lit(1).cast("bigint")).unionByName(by_case).unionByName(through).groupBy("tie", "value").agg(F.sum("n").alias("n"), F.min("split").alias("a"), F.max("split").alias("b"))
    return each.groupBy("tie").agg(F.count("*").alias("values"), F.count_if(F.col("n") > 1).alias("shared"), F.count_if(F.col("a") != F.col("b")).alias("in_two_splits"))


_NUMBER = r"try_cast(nullif(regexp_extract({}, '(?i)(?:^|[^\p{{L}}\p{{N}}])ext[\s_.:#/\-]*0*(\d{{1,18}})(?:$|[^\p{{L}}\p{{N}}])', 1), '') AS BIGINT)"
_TIE = "nullif(CASE WHEN lower(trim({0}, ' \t\n\r\u00a0\u3000')) IN ('', 'unknown', 'n/a', 'none', '-') THEN '' ELSE lower(trim({0}, ' \t\n\r\u00a0\u3000')) END, '')"
_NAMED = f"""named AS (SELECT record_id, {_TIE.format("metadata.sample_id")} AS sample, {_NUMBER.format("metadata.case_id")} AS by_case, {_NUMBER.format("replace(metadata.sample_id, '_', '-')")} AS by_sample FROM chat_records),
cases AS (SELECT {_NUMBER.format("case_id")} AS c, {_TIE.format("author_id")} AS author, {_TIE.format("source_document")} AS document FROM case_registry)"""
_EDGES = """SELECT by_case AS a, by_sample AS b FROM named WHERE by_case <> by_sample
  UNION SELECT c, min(c) OVER (PARTITION BY author) FROM cases WHERE author IS NOT NULL AND c IS NOT NULL UNION SELECT c, min(c) OVER (PARTITION BY document) FROM cases WHERE document IS NOT NULL AND c IS NOT NULL"""
_REACH = """link AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON r.seen = l.a),
least AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
#: The same result by reachability, for DuckDB on small tables.
P5_FOUND_SQL = f"""WITH RECURSIVE {_NAMED}, edge AS ({_EDGES}), {_REACH}
SELECT n.record_id, coalesce(l.component, coalesce(n.by_case, n.by_sample)) AS group_case FROM named n LEFT JOIN least l ON l.node = coalesce(n.by_case, n.by_sample) WHERE coalesce(n.by_case, n.by_sample) IS NOT NULL"""
_SPLITS = f"""WITH RECURSIVE {_NAMED}, keyed AS (SELECT record_id, coalesce(by_case, by_sample) AS c, ('0x' || substr(md5(sample), 1, 15))::BIGINT + {2**62} AS s FROM named),
edge AS ({_EDGES} UNION SELECT s, c FROM keyed WHERE s IS NOT NULL AND c IS NOT NULL), {_REACH},
grouped AS (SELECT k.record_id, coalesce('g' || coalesce(l.component, k.c, k.s), 'r' || k.record_id) AS split_group FROM keyed k LEFT JOIN least l ON l.node = coalesce(k.c, k.s)),
scored AS (SELECT record_id, split_group, split_name, -target_share / ln((('0x' || substr(md5('20:' || split_name || ':' || split_group), 1, 13))::BIGINT + 0.5) / {2**52}) AS score FROM grouped, split_targets WHERE target_share > 0),
placed AS (SELECT record_id, any_value(split_group) AS split_group, arg_max(split_name, score) AS split FROM scored GROUP BY record_id)"""
P5_SPLITS_SQL = f"{_SPLITS} SELECT record_id, split_group, split FROM placed"
P5_SHARES_SQL = f"""{_SPLITS}, held AS (SELECT split, split_group, count(*) AS n FROM placed GROUP BY ALL), per AS (SELECT split, sum(n)::BIGINT AS records, count(*) AS groups, max(n) AS largest_group FROM held GROUP BY split)
SELECT t.split_name AS split, t.target_share, coalesce(records, 0) AS records, coalesce(groups, 0) AS groups, largest_group, round(coalesce(records, 0) / (SELECT sum(records) FROM per), 6) AS actual_share FROM split_targets t LEFT JOIN per ON per.split = t.split_name"""
#: What ties records, counted without any split; no value may lie in two of them.
P5_TORN_SQL = f"""WITH {_NAMED}, case_of AS (SELECT DISTINCT record_id, unnest([by_case, by_sample]) AS c FROM named),
held AS (SELECT 'sample_id' AS tie, sample AS value, count(*) AS n FROM named WHERE sample IS NOT NULL GROUP BY ALL UNION ALL SELECT 'case_id', c::VARCHAR, count(*) FROM case_of WHERE c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'author_id', author, count(*) FROM (SELECT DISTINCT c, author FROM cases) JOIN case_of USING (c) WHERE author IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'source_document', document, count(*) FROM (SELECT DISTINCT c, document FROM cases) JOIN case_of USING (c) WHERE document IS NOT NULL GROUP BY ALL)
SELECT tie, count(*) AS values, count(*) FILTER (WHERE n > 1) AS shared, 0::BIGINT AS in_two_splits FROM held GROUP BY tie"""
