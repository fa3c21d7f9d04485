"""Text cut off by field limits.

Intact values are cut artificially to make positives; a hashed logistic regression learns from closing characters,
punctuation and the length against the field limits; then every record is scored. Everything but the fit on a bounded
sample (TRAIN_ROWS rows) is built-in SQL over all rows: features, limits and scores.

Defined results: null, empty and blank texts are never truncated; columns of the input are left alone; with no intact
text to learn from nothing is flagged.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.charforms import folded
from plumbline.session import cut, spread, table

#: Bound of the rows that the classifier is fitted on (before they are cut artificially).
TRAIN_ROWS = 24_000
#: Partitions of the (bounded) rows of the fit; each iteration sends one gradient from each.
FIT_PARTITIONS = 4
#: Probability of the first fit from which a label without a stop counts as a cut sentence.
SURELY_CUT = 0.75
#: Size of the hashed feature space.
FEATURES = 1 << 15
#: Iterations of the two fits at most, and the change of the loss at which they stop.
ITERATIONS, TOLERANCE = (15, 25), 1e-4
#: A length is a field limit of its source if so many standard deviations more texts end there without a stop than the source's
#: rate lets expect, and most of the texts of that length do.
LIMIT_DEVIATIONS = 4.0
# Marks of omission that a text may end with.
MARKS = ("…", "...", " […]", "[truncated]", " [cut]", " [...]", " (cut)", "……")
MARK = r"(\s?(?:…+|\.{3,}|\[(?:…|\.{3}|cut|truncated|truncated text|more|continued|snip|\p{IsHan}{1,4})\]|\((?:cut|truncated|more|continued)\)))$"
_DIGIT = r"\d"


def _shape(token: Column) -> Column:
    """A token with a digit by its shape, any other as it is."""
    shape = F.regexp_replace(F.regexp_replace(token, r"\p{L}+", "a"), r"\d", "0")
    return F.when(token.rlike(_DIGIT), F.regexp_replace(F.regexp_replace(shape, r"^0+(?=\D|$)", "0"), r"^0\.0+", "0.0")).otherwise(token)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


#: A text in which a sentence ends before the last one; a point behind a short opening word is an abbreviation's.
_SEVERAL = r"(?s)[.!?](?<!^\p{L}{1,4}[.!?]|, \p{L}{1,4}[.!?])\s+\S|[。！？…\n]\s*[^\s…]"
#: Where one sentence ends and the next begins; a break that something follows.
_BETWEEN = r"(?<=[.!?])(?<!^\p{L}{1,4}\.|, \p{L}{1,4}\.)\s+|(?<=。)|\n|……|(?<=…)\s*"
_BREAK = r"(?:(?<=[.!?])(?<!, \p{L}{1,4}\.)\s+|(?<=。)|\n)(?=[\p{L}\p{N}])"
#: Closing characters that are folded if a sentence begins in them; else the whole text is. The last sentence is whole either way.
FOLDED = 160
#: Blanks that don't count at the end of a text.
BLANKS_BEHIND = " \n\t\r\u00a0\u3000\u200b\ufeff"


def _closing(text: Column) -> Column:
    """The struct (mark, body, words, end, whole, item) of a text: its mark of omission, the text before it, the
    words of its last sentence, the class of its last character, and whether that sentence is the whole text or the last
    line an item of a list."""

    def parts(tail: Column) -> Column:
        return _let(F.regexp_extract(tail, MARK, 1), lambda mark: _let(F.left(tail, F.length(tail) - F.length(mark)), lambda body: struct(mark, body)))

    def struct(mark: Column, body: Column) -> Column:
        last = F.right(body, F.lit(1))
        kind = F.when(last.isin(".", "。", "!", "?"), "stop")
        for name, pattern in (("comma", "[,;:、]"), ("open", r"[(\[{“‘«<]"), ("close", r"[)\]}”’»>\"']"), ("digit", _DIGIT), ("lost", "�"), ("han", r"\p{IsHan}"), ("letter", r"\p{L}")):
            kind = kind.when(last.rlike(pattern), name)
        segment = F.element_at(F.filter(F.concat(F.array(F.lit("")), F.split(body, _BETWEEN)), lambda x: (F.trim(x) != "") | (x == "")), -1)
        segment = F.regexp_replace(segment, r"^\s*(?:[-*•]\s+)?", "")
        words = F.regexp_extract_all(segment, F.lit(r"(\p{IsHan}|[^\s\p{IsHan}]+)"), F.lit(1))
        return F.struct(mark.alias("mark"), body.alias("body"), words.alias("words"), F.when(mark != "", "mark").otherwise(kind.otherwise("sign")).alias("end"), (~text.rlike(_SEVERAL)).alias("whole"), F.substring_index(text, "\n", -1).rlike(r"^\s*[-*•]\s").alias("item"))

    def ending(trimmed: Column) -> Column:
        tail = F.right(trimmed, F.lit(FOLDED))
        return F.when((F.length(trimmed) <= FOLDED) | ~F.substring(tail, 9, FOLDED).rlike(_BREAK), trimmed).otherwise(tail)

    return _let(F.rtrim(folded(_let(F.rtrim(text, F.lit(BLANKS_BEHIND)), ending)), F.lit(BLANKS_BEHIND)), parts)


def _source(name: str | None) -> Column:
    return F.lit(None).cast("string") if name is None else F.col(name)


def _limits_of(source: Column, limits: dict[str, list[int]]) -> Column:
    """The field limits of a row's source."""
    table = F.from_json(F.lit(json.dumps(limits, ensure_ascii=False)), "map<string,array<int>>")
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit(""))), F.array().cast("array<int>"))


def _features(c: Column, at_limit: Column) -> Column:
    words, end, mark = c["words"], c["end"], c["mark"]
    n = F.size(words)
    at = lambda i: F.coalesce(F.when(n >= i, _shape(F.try_element_at(words, F.lit(-i)))), F.lit("^"))
    first = F.coalesce(F.try_element_at(words, F.lit(1)), F.lit(""))
    opening = F.when(first.rlike(r"^\p{IsHan}"), F.concat(first, F.coalesce(F.try_element_at(words, F.lit(2)), F.lit("")))).otherwise(_shape(first))
    second = F.coalesce(F.when(n > 2, _shape(F.try_element_at(words, F.lit(2)))), F.lit("^"))
    item = F.when(c["item"], "item").otherwise("flow")
    whole = F.when(c["whole"], "w").otherwise("p")
    size = F.when(n > 12, 13).when(n > 8, 9).otherwise(n).cast("string")
    near = F.when(at_limit, "at").otherwise("off")
    tail = F.regexp_replace(F.right(c["body"], F.lit(6)), _DIGIT, "0")

    def named(v: Column) -> Column:
        made = {
            "c": [end], "m": [mark], "1": [v["a"]], "2": [v["b"], v["a"]], "3": [v["c"], v["b"], v["a"]], "4": [v["d"], v["c"], v["b"], v["a"]],
            "e2": [F.right(v["tail"], F.lit(2))], "e3": [F.right(v["tail"], F.lit(3))], "e5": [F.right(v["tail"], F.lit(5))],
            "o": [v["o"], end], "oo": [v["o"], v["w"], v["a"]], "w": [v["w"], end, v["n"]], "ow": [v["o"], v["w"], end, v["n"]],
            "d": [v["w"], end, F.when(v["b"].rlike("0"), "n").otherwise("t"), F.when(v["a"].rlike("0"), v["a"]).otherwise("t")],
            "l": [near, end], "ob": [v["o"], v["p"], end], "k": [v["w"], v["q"], end],
        }
        return F.array(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *x)), 16, "0") for k, x in made.items()])

    return _let(F.struct(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"), at(4).alias("d"), opening.alias("o"), whole.alias("w"), size.alias("n"), tail.alias("tail"), second.alias("p"), item.alias("q")), named)


def closing_features(frame: DataFrame, text: str, limits: dict[str, list[int]], source: str | None = None, name: str = "features") -> DataFrame:
    """``frame`` with the column ``name``: the features that hold of the text, as hashes of 16 hexadecimal digits."""
    column = F.col(text)
    at_limit = F.array_contains(_limits_of(_source(source), limits), F.length(column))
    return frame.withColumn(name, _let(_closing(column), lambda c: _features(c, at_limit)))


def field_limits(frame: DataFrame, text: str, source: str | None = None) -> tuple[dict[str, list[int]], int]:
    """For each source all lengths at which its texts are cut, and the number of texts: one row a length goes to the driver."""
    last = F.right(F.rtrim(F.col(text), F.lit(BLANKS_BEHIND)), F.lit(1))
    rows = frame.where(F.col(text).isNotNull()).select(F.coalesce(_source(source), F.lit("")).alias("source"), F.length(text).alias("n"), last.isin(*".。!?！？…").alias("stopped"))
    counts = rows.groupBy("source", "n").agg(F.count_if(~F.col("stopped")).alias("open"), F.count("*").alias("all"))
    by = Window.partitionBy("source")  # over lengths, not texts
    usual = 2 * F.col("open") < F.col("all")  # lengths at which most texts have a stop tell the source's rate
    rate = F.coalesce(F.try_divide(F.sum(F.when(usual, F.col("open"))).over(by), F.sum(F.when(usual, F.col("all"))).over(by)), F.lit(0.0))
    rated = counts.withColumn("rate", rate).withColumn("texts", F.sum("all").over(by))
    expected = F.col("all") * F.col("rate")
    often = (F.col("n") >= 60) & (F.col("open") >= 5) & (2 * F.col("open") >= F.col("all")) & (F.col("open") - expected >= LIMIT_DEVIATIONS * F.sqrt(expected * (1 - F.col("rate"))))
    found = rated.groupBy("source").agg(F.first("texts").alias("texts"), F.array_sort(F.collect_list(F.when(often, F.col("n")))).alias("limits")).collect()
    return {r["source"]: r["limits"] for r in found if r["limits"]}, sum(r["texts"] for r in found)


def _cut_values(intact: DataFrame, limits: dict[str, list[int]]) -> DataFrame:
    """Positives: each intact value cut inside a sentence, sometimes with a mark or a broken character behind."""
    h = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "text", "copy"), F.lit(n)).cast("int")
    size = F.length("text")
    spots = F.filter(_limits_of(F.col("source"), limits), lambda n: n < F.length("text") - 1)
    chosen = F.try_element_at(spots, h("limit", 1000) % F.greatest(F.size(spots), F.lit(1)) + 1)
    anywhere = F.greatest(F.lit(4), F.lit(1) + h("at", 1_000_003) % F.greatest(size - 2, F.lit(1)))
    at = F.when((h("which", 2) == 0) & (F.size(spots) > 0), chosen).otherwise(anywhere)
    cuts = intact.where(size >= 8).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("at", at)
    cuts = cuts.withColumn("next", F.substring("text", F.col("at") + 1, F.lit(1))).withColumn("part", F.substring("text", F.lit(1), F.col("at")))
    last = F.right(F.rtrim("part"), F.lit(1))
    inside = ~last.isin(".", "。", "!", "?", "！", "？", "…", "\n") | (F.col("part").endswith(".") & F.col("next").rlike(r"\d"))
    told = ~(last.rlike(_DIGIT) & F.col("text").rlike(r"[\d]\s*$")) & ~F.col("next").isin(".", "。", "\n", "")
    mark = F.array(*[F.lit(m) for m in MARKS])
    tail = F.when(h("mark", 4) == 0, F.element_at(mark, h("kind", len(MARKS)) + 1)).when(h("mark", 16) == 1, "�").otherwise("")
    return cuts.where(inside & told).select(F.concat("part", tail).alias("text"), "source", F.lit(1.0).alias("label"))


class ClosingModel:
    """A fitted classifier; ``score`` adds the probability that a text stops before its end."""

    def __init__(self, weights: list[float], intercept: float | None, limits: dict[str, list[int]]):
        self.weights, self.intercept, self.limits = weights, intercept, limits

    def score(self, frame: DataFrame, text: str, source: str | None = None, name: str = "cut_probability") -> DataFrame:
        """Built-in SQL: the weights of the features that hold, looked up in one constant array, are added up."""
        own = frame.columns
        if self.intercept is None:
            return frame.withColumn(name, F.lit(0.0))
        blank = F.coalesce(~F.col(text).rlike(r"[^\s\x{a0}\x{200b}\x{feff}]"), F.lit(True))
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        # terms of a multiple of four bytes have the same place here as in HashingTF
        places = F.array_distinct(F.transform("_features", lambda term: F.pmod(F.hash(term), F.lit(FEATURES))))
        summed = F.aggregate(places, F.lit(self.intercept), lambda total, i: total + F.get(weights, i))
        featured = closing_features(frame, text, self.limits, source, "_features")
        return featured.select(*own, F.when(blank, 0.0).otherwise(1 / (1 + F.exp(-summed))).alias(name))


def fit_closing(frame: DataFrame, text: str, source: str | None = None, train_rows: int = TRAIN_ROWS) -> ClosingModel:
    """Learns from the intact values among ``frame[text]``; the fit sees at most about ``train_rows`` of them."""
    limits, texts = field_limits(frame, text, source)
    rows = frame.select(F.col(text).alias("text"), _source(source).alias("source")).where("text is not null")
    share = min(1.0, train_rows / max(1, texts))
    sample = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    text = F.col("text")

    def judged(c: Column) -> Column:
        """Whether a text counts as intact: ``stopped``, ``numbered`` (a stop behind a number), ``label``, or null."""
        unfinished = c["end"].isin("lost", "comma", "open", "mark", "stop")
        label = c["whole"] & (F.size(c["words"]) <= 12) & c["body"].rlike(_DIGIT) & ~unfinished & (F.length(text) <= 64)
        listed = ~c["whole"] & (F.size(c["words"]) <= 10) & c["item"] & ~unfinished & c["body"].rlike(_DIGIT)
        stopped = c["end"] == "stop"
        return F.when(c["body"] == "", None).when(stopped & c["body"].rlike(r"\s\d+\.$"), "numbered").when(stopped, "stopped").when(label | listed, "label")

    intact = cut(sample.select("text", "source", _let(_closing(text), judged).alias("kind"))).where("kind is not null")
    positives = _cut_values(intact.where("kind <> 'numbered'").select("text", "source"), limits)
    examples = intact.select("text", "source", "kind", F.lit(0.0).alias("label")).unionByName(positives.withColumn("kind", F.lit("cut")))
    featured = cut(closing_features(examples, "text", limits, "source").select("label", "kind", "features").repartition(FIT_PARTITIONS))
    featured = HashingTF(numFeatures=FEATURES, binary=True, inputCol="features", outputCol="vector").transform(featured)
    if featured.agg(F.countDistinct("label")).first()[0] < 2:
        return ClosingModel([], None, limits)
    fit = LogisticRegression(featuresCol="vector", labelCol="label", elasticNetParam=0.0, standardization=False, tol=TOLERANCE)
    # some labels without a stop are cut sentences; a strongly regularised first fit tells which, the second does without
    first = fit.setParams(regParam=0.0005, maxIter=ITERATIONS[0]).fit(featured)
    told = first.transform(featured).withColumn("p", vector_to_array("probability")[1])
    kept = told.where((F.col("kind") != "label") | (F.col("p") < SURELY_CUT)).select("label", "vector")
    model = fit.setParams(regParam=0.00005, maxIter=ITERATIONS[1]).fit(kept)
    return ClosingModel([round(float(w), 9) for w in model.coefficients.toArray()], float(model.intercept), limits)


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, row_id, reporter, text, truncated) of both tables; the reporter is the profile or the source type."""
    evidence = table(spark, sf_dir, "evidence_refs").select(F.lit("evidence_refs").alias("tbl"), F.col("evidence_row").cast("bigint").alias("row_id"), F.col("source_type").alias("reporter"), F.col("excerpt").alias("text"))
    issues = table(spark, sf_dir, "review_issues").select(F.lit("review_issues").alias("tbl"), F.col("issue_row").cast("bigint").alias("row_id"), F.col("teacher_model_profile").alias("reporter"), F.col("message").alias("text"))
    rows = spread(evidence).unionByName(spread(issues)).withColumn("source", F.concat_ws(":", "tbl", "reporter"))
    scored = fit_closing(rows, "text", "source").score(rows, "text", "source")
    return scored.withColumn("truncated", F.col("cut_probability") >= 0.5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_texts(spark, sf_dir).where("truncated").select("tbl", "row_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and reporter: texts that aren't blank, truncated ones and their rate."""
    filled = truncated_texts(spark, sf_dir).where("trim(text) <> ''")
    counted = filled.groupBy("tbl", "reporter").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"))
    return counted.withColumn("truncation_rate", F.round(F.col("truncated") / F.col("texts"), 6))
