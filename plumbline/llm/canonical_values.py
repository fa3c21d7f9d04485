"""Mapping free-entered values to a canonical list.

Built-in SQL functions only. Each distinct value is brought to a comparable form and then meets the reference list
through equality joins alone, in this order of trust: equal forms (either label, or the words in another order),
abbreviated words, and strings within k edits. For the edits each reference string is cut into k+1 segments; a value
within k edits holds one of them unchanged, at most k places off, so an equality join on positional substrings finds
every candidate, which the built-in levenshtein then verifies. Values without a match are reported through an anti-join.

Defined results: null and blank values and values that are already a code of their kind give no row; everything else
gives one, with the term ``none`` where nothing matches. Of equally near terms the smaller id wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.charforms import folded
from plumbline.session import cut, table

#: Edits allowed for a reference string of at least so many characters; an adjacent swap costs two.
EDITS = ((4, 1), (6, 2), (9, 3), (12, 4))
#: Words that people put before or after a value.
BEFORE = r"^(?:\d+\)|type:|the\b|an?\b|is[_\s](?=\S{3}))\s*"
AFTER = r"(?:\(tbc\)|\(待定\)|待定|#\d+|类)\s*$"


def max_edits(length: Column) -> Column:
    k = F.lit(0)
    for least, edits in EDITS:
        k = F.when(length >= least, F.lit(edits)).otherwise(k)
    return k


def _bare(column: Column) -> Column:
    """Lower-case, folded, without what surrounds the value."""
    plain = F.trim(F.regexp_replace(folded(column), r"[\s\x{a0}]+", " "))
    for _ in range(2):
        plain = F.trim(F.regexp_replace(F.regexp_replace(plain, AFTER, ""), BEFORE, ""))
        plain = F.regexp_replace(plain, r"^[\s\[\]<>【】“”\"'~?;:,.。!()/]+|[\s\[\]<>【】“”\"'~?;:,。!()/]+$", "")
    return plain


def _words(bare: Column) -> Column:
    """The Latin words of a form, in order."""
    return F.regexp_extract_all(bare, F.lit(r"([a-z]+)"), F.lit(1))


def _latin(bare: Column) -> Column:
    return F.regexp_replace(bare, r"[^a-z]", "")


def _han(bare: Column) -> Column:
    return F.regexp_replace(bare, r"[^\p{IsHan}]", "")


def _rotations(words: Column) -> Column:
    """The words joined, in every rotation and backwards, around a middle ``or``, and with two words swapped around ``of``."""
    n = F.size(words)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.concat(F.slice(words, i + 1, n), F.slice(words, F.lit(1), i)), ""))
    around = F.transform(
        F.filter(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda i: (i < n) & (F.try_element_at(words, i) == "or")),
        lambda i: F.array_join(F.concat(F.slice(words, i + 1, n), F.array(F.lit("or")), F.slice(words, F.lit(1), i - 1)), ""),
    )
    of = F.when(n == 2, F.array(F.array_join(F.array(F.try_element_at(words, F.lit(2)), F.lit("of"), F.try_element_at(words, F.lit(1))), ""))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(turned, F.array(F.array_join(F.reverse(words), "")), around, of))


def reference_strings(terms: DataFrame) -> DataFrame:
    """(term_id, kind, ref, k): every string that stands for a term, cut off from its separators."""
    bare = terms.select("term_id", F.col("term_kind").alias("kind"), F.explode(F.array_distinct(F.array("term_code", "label_en", "label_zh"))).alias("text")).where("text is not null")
    bare = bare.withColumn("bare", _bare(F.col("text")))
    words = _words(F.col("bare"))
    latin = bare.where(F.size(words) > 0).select("term_id", "kind", F.explode(_rotations(words)).alias("ref"))
    han = bare.select("term_id", "kind", _han(F.col("bare")).alias("ref")).where("ref <> ''")
    refs = latin.union(han).groupBy("kind", "ref").agg(F.min("term_id").alias("term_id"))
    return refs.withColumn("k", F.when(F.col("ref").rlike(r"^[a-z]"), max_edits(F.length("ref"))).otherwise(F.when(F.length("ref") >= 4, 1).otherwise(0)))


def _segments(refs: DataFrame) -> DataFrame:
    """Each reference string cut into k+1 segments of nearly equal length: (.., segment, at)."""
    segments = F.transform(
        F.sequence(F.lit(0), F.col("k")),
        lambda i: F.struct(
            F.floor(i * F.length("ref") / (F.col("k") + 1)).cast("int").alias("at"),
            (F.floor((i + 1) * F.length("ref") / (F.col("k") + 1)) - F.floor(i * F.length("ref") / (F.col("k") + 1))).cast("int").alias("len"),
        ),
    )
    return refs.where("length(ref) > k").select("*", F.explode(segments).alias("c")).select("kind", "ref", "term_id", "k", F.col("c.at").alias("at"), F.col("ref").substr(F.col("c.at") + 1, F.col("c.len")).alias("segment"))


def match_values(values: DataFrame, terms: DataFrame) -> DataFrame:
    """``values`` (kind, value; distinct) with the column term_id of the entry meant, or ``none``."""
    bare = values.withColumn("bare", _bare(F.col("value")))
    forms = bare.select("kind", "value", F.explode(F.array_distinct(F.array(_latin(F.col("bare")), _han(F.col("bare"))))).alias("form"), _words(F.col("bare")).alias("words")).where("form <> ''")
    forms = cut(forms)  # each distinct value is brought to its form once; all steps below read that
    refs = cut(reference_strings(terms))
    equal = forms.join(refs.select("kind", F.col("ref").alias("form"), "term_id"), ["kind", "form"]).select("kind", "value", "term_id", F.lit(0).alias("rank"), F.lit(0).alias("edits"))

    # abbreviated words: as many words, each the beginning (three letters at least, or all) of the word meant
    stems = lambda w: F.array_join(F.transform(w, lambda x: F.substring(x, 1, 3)), " ")
    full = terms.select("term_id", F.col("term_kind").alias("kind"), _words(_bare(F.col("term_code"))).alias("full")).withColumn("stems", stems(F.col("full")))
    short = forms.where(F.col("form").rlike("^[a-z]")).withColumn("stems", stems(F.col("words"))).join(full, ["kind", "stems"])
    short = short.where(F.forall(F.zip_with("full", "words", lambda a, b: F.startswith(a, b) & ((F.length(b) >= 3) | (a == b))), lambda x: x))
    short = short.select("kind", "value", "term_id", F.lit(1).alias("rank"), F.lit(0).alias("edits"))
    known = equal.union(short)

    # k edits: equality join of the segments with the substrings of the values that nothing has matched yet
    left = forms.join(known.select("kind", "value").distinct(), ["kind", "value"], "left_anti")
    segments = _segments(refs)
    spans = segments.groupBy("kind").agg(F.collect_set(F.length("segment")).alias("lens"), F.max(F.length("ref") + F.col("k")).alias("longest"))
    fit = left.join(spans, "kind").where("length(form) <= longest")  # a longer value is more than k edits from every entry
    pieces = fit.select("kind", "value", "form", "lens", F.explode(F.sequence(F.lit(1), F.length("form"))).alias("p"))
    pieces = pieces.select("kind", "value", "form", "p", F.explode("lens").alias("len")).where("p + len - 1 <= length(form)")
    pieces = pieces.select("kind", "value", "form", (F.col("p") - 1).alias("from"), F.expr("substring(form, p, len)").alias("segment"))
    near = pieces.join(segments, ["kind", "segment"]).where("abs(`from` - at) <= k and abs(length(form) - length(ref)) <= k")
    near = near.select("kind", "value", "form", "ref", "term_id", "k").distinct().withColumn("edits", F.expr("levenshtein(form, ref, k)")).where("edits >= 0")
    near = near.select("kind", "value", "term_id", F.lit(2).alias("rank"), "edits")

    best = known.union(near).groupBy("kind", "value").agg(F.min(F.struct("rank", "edits", "term_id"))["term_id"].alias("term_id"))
    missed = values.join(best, ["kind", "value"], "left_anti").select("kind", "value", F.lit("none").alias("term_id"))
    return best.unionByName(missed)


def entered_values(claims: DataFrame, terms: DataFrame) -> DataFrame:
    """(claim_row, field_name, kind, value) of each value that is neither null nor blank nor a code of its kind."""
    fields = (("subject_type", "entity_type"), ("object_type", "entity_type"), ("predicate", "predicate"))
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in fields])
    rows = claims.select(F.col("claim_row").cast("bigint").alias("claim_row"), F.explode(each).alias("x")).select("claim_row", "x.*")
    rows = rows.where(F.col("value").isNotNull() & (F.trim(F.regexp_replace("value", r"[\s\x{a0}　]+", "")) != ""))
    return rows.join(terms.select(F.col("term_kind").alias("kind"), F.col("term_code").alias("value")), ["kind", "value"], "left_anti")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "ref_terms")
    rows = entered_values(table(spark, sf_dir, "graph_claims"), terms)
    matched = match_values(rows.select("kind", "value").distinct(), terms)
    return rows.join(matched, ["kind", "value"]).select("claim_row", "field_name", "term_id")


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean no entry, with how often and in which field each occurs."""
    terms = table(spark, sf_dir, "ref_terms")
    rows = entered_values(table(spark, sf_dir, "graph_claims"), terms)
    counted = rows.groupBy("kind", "value", "field_name").agg(F.count("*").alias("n"))
    matched = match_values(counted.select("kind", "value").distinct(), terms).where("term_id = 'none'")
    return counted.join(matched.select("kind", "value"), ["kind", "value"], "left_semi").select("field_name", "value", "n")
