"""Chat records, reviews, documents and events: validation, leakage, sampling, order-dependent results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.jsonwalk import canonical_json, json_held, json_in_prose
from plumbline.functions.text import BLANK, bracketed_ids, case_label, given_ids, metric_key, question_answers, redacted, role, run_name, safe_name
from plumbline.operators.evaluation import decision_evaluation, first_success, keyed_sets, micro_scores, prf, resume_plan, run_summary, scored_samples
from plumbline.operators.metrics import class_metrics, confusion, ratio
from plumbline.operators.sampling import budgeted, padded, round_robin, weighted_draws
from plumbline.plans.catalogue import query
from plumbline.plans.sql import BLANK as SQL_BLANK
from plumbline.plans.sql import PAIRS, key
from plumbline.plans.sql import role as role_sql
from plumbline.session import spread, table

_DECISIONS = ["approve", "revise", "reject"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chat_records")


_ROLES = f"list_transform(messages, lambda m: {role_sql('m.role')})"
_SHAPE = ("system", "user", "assistant")


@query(f"""SELECT array_to_string({_ROLES}, '>') AS roles, count(*) AS records, count(*) FILTER (WHERE {_ROLES} = {list(_SHAPE)}) AS well_formed,
count(*) FILTER (WHERE metadata.source_name IS NULL) AS unnamed FROM chat_records GROUP BY 1""")
def chat_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role sequences of the records, how many have the plain three-message form, and how many lack a source."""
    roles = F.transform("messages", lambda m: role(m["role"]))
    rows = _records(spark, sf_dir).select(F.array_join(roles, ">").alias("roles"), F.col("metadata.source_name").alias("source_name"))
    return rows.groupBy("roles").agg(F.count("*").alias("records"), F.count_if(F.col("roles") == ">".join(_SHAPE)).alias("well_formed"), F.count_if(F.col("source_name").isNull()).alias("unnamed"))


_LAST = "messages[-1].content"


@query(f"""WITH part AS (SELECT record_id, {_ROLES} AS roles, metadata, {_LAST} AS answer FROM chat_records),
found AS (SELECT record_id, unnest([CASE WHEN roles IS DISTINCT FROM {list(_SHAPE)} THEN 'shape' END, CASE WHEN coalesce(metadata.role, '') = '' THEN 'role' END, CASE WHEN coalesce(metadata.source_name, '') = '' THEN 'source' END,
  CASE WHEN coalesce(metadata.split, '') NOT IN ('train', 'validation', 'test') THEN 'split' END, CASE WHEN roles[-1] = 'assistant' AND NOT coalesce(json_valid(answer), false) THEN 'answer_json' END]) AS violation FROM part)
SELECT record_id, violation FROM found WHERE violation IS NOT NULL""")
def chat_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record lacks of the form of a training record, one row a violation."""
    roles = F.transform("messages", lambda m: role(m["role"]))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    answer = F.try_element_at("messages", F.lit(-1))
    broken = {
        "shape": ~roles.eqNullSafe(F.array(*map(F.lit, _SHAPE))), "role": empty("metadata.role"), "source": empty("metadata.source_name"),
        "split": ~F.coalesce(F.col("metadata.split"), F.lit("")).isin("train", "validation", "test"), "answer_json": (role(answer["role"]) == "assistant") & F.try_parse_json(answer["content"]).isNull(),
    }
    return _records(spark, sf_dir).select("record_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))).alias("violation"))


_PARTS = """part AS (SELECT record_id, lower(trim(metadata.split)) AS split, md5(regexp_replace(lower(array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), ' ')), '%s', '', 'g')) AS content FROM chat_records WHERE metadata.split IS NOT NULL)""" % SQL_BLANK


@query(f"""WITH {_PARTS}, held AS (SELECT DISTINCT split, content FROM part)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM held a JOIN held b ON a.content = b.content AND a.split < b.split GROUP BY ALL""")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each two splits, how many distinct contents stand in both.

    Each content meets the few splits that hold it within its own group, so no pairs of records are formed.
    """
    content = F.md5(F.regexp_replace(F.lower(F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " ")), BLANK + "+", ""))
    held = _records(spark, sf_dir).select(F.lower(F.trim(F.col("metadata.split"))).alias("split"), content.alias("content")).where("split is not null")
    splits = held.groupBy("content").agg(F.array_sort(F.collect_set("split")).alias("splits")).where("size(splits) > 1")
    a = splits.select("content", "splits", F.explode("splits").alias("split_a"))
    pairs = a.select("split_a", F.explode("splits").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query("""SELECT lower(trim(metadata.split)) AS split, metadata.source_name AS source_name, count(*) AS records, count(DISTINCT metadata.sample_id) AS samples,
count(DISTINCT CASE WHEN regexp_matches(lower(metadata.sample_id), 'ext-(\\d+)') THEN regexp_extract(lower(metadata.sample_id), 'ext-(\\d+)', 1) END) AS cases FROM chat_records GROUP BY ALL""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).select(F.lower(F.trim(F.col("metadata.split"))).alias("split"), "metadata.source_name", "metadata.sample_id")
    return rows.groupBy("split", "source_name").agg(F.count("*").alias("records"), F.countDistinct("sample_id").alias("samples"), F.countDistinct(case_label(F.col("sample_id"))).alias("cases"))


_GIVEN = "list_sort(list_distinct(regexp_extract_all(asked, '(?m)^\\[([A-Za-z0-9_.:-]+)\\]', 1)))"
_CITED = "list_distinct(regexp_extract_all(answer, '\\[([A-Za-z0-9_.:-]+)\\]', 1))"


def _pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, role, case_id, pos, asked, answer): every question of the records with the answer behind it."""
    rows = spread(_records(spark, sf_dir)).select("record_id", F.col("metadata.role").alias("role"), case_label(F.col("metadata.case_id")).alias("case_id"), F.explode(question_answers(F.col("messages"))).alias("p"))
    return rows.select("record_id", "role", "case_id", "p.*")


@query(f"""WITH {PAIRS}, named AS (SELECT record_id, pos, {_GIVEN} AS given, {_CITED} AS cited FROM pair WHERE asked IS NOT NULL AND answer IS NOT NULL)
SELECT record_id, pos, len(cited) AS cited, len(list_filter(cited, lambda x: NOT list_contains(given, x))) AS unknown FROM named WHERE len(cited) > 0""")
def citation_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that an answer cites, and those of them that its question doesn't give at the start of a line."""
    sides = _pairs_of(spark, sf_dir).select("record_id", "pos", given_ids(F.col("asked")).alias("given"), bracketed_ids(F.col("answer")).alias("cited"))
    rows = sides.where("given is not null and size(cited) > 0")
    return rows.select("record_id", "pos", F.size("cited").cast("bigint").alias("cited"), F.size(F.array_except("cited", "given")).cast("bigint").alias("unknown"))


_OBJECT = "CASE WHEN json_valid(answer) THEN json_type(answer) = 'OBJECT' ELSE false END"
_HELD = f"""obj AS (SELECT record_id, pos, metadata.role AS role, nullif('EXT-' || regexp_extract(lower(metadata.case_id), 'ext-(\\d+)', 1), 'EXT-') AS case_id, asked, answer FROM pair WHERE answer IS NOT NULL AND {_OBJECT}),
node AS (SELECT o.record_id, o.pos, t.fullkey, t.key, t.type, json_extract_string(t.value, '$') AS text FROM obj o, json_tree(o.answer) t),
item AS (SELECT record_id, pos, 'evidence' AS metric, text AS item FROM node WHERE type = 'VARCHAR' AND regexp_matches(fullkey, '\\.evidence_ids\\[\\d+\\]$')
  UNION SELECT record_id, pos, 'statement', {key("text")} FROM node WHERE type = 'VARCHAR' AND key IN ('statement', 'content', 'evidence_summary') AND NOT regexp_matches(text, '^\\s*$')
  UNION SELECT record_id, pos, 'entity', {key("e->>'$.name'")} FROM (SELECT record_id, pos, unnest(json_extract(answer, '$.entities[*]')) AS e FROM obj) WHERE coalesce(e->>'$.name', '') <> ''
  UNION SELECT record_id, pos, 'claim', {key("e->>'$.subject'")} || '|' || {key("e->>'$.predicate'")} || '|' || {key("e->>'$.object'")} FROM (SELECT record_id, pos, unnest(json_extract(answer, '$.claims[*]')) AS e FROM obj)
    WHERE coalesce(e->>'$.subject', '') <> '' AND coalesce(e->>'$.predicate', '') <> '' AND coalesce(e->>'$.object', '') <> '')"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs with what their answers hold as JSON objects (column held)."""
    return _pairs_of(spark, sf_dir).where("answer is not null").withColumn("held", json_held("answer"))


@query(f"""WITH {PAIRS}, {_HELD} SELECT record_id, pos, count(*) FILTER (WHERE metric = 'entity') AS entities, count(*) FILTER (WHERE metric = 'claim') AS claims, count(*) FILTER (WHERE metric = 'statement') AS statements,
  count(*) FILTER (WHERE metric = 'evidence') AS evidence FROM obj LEFT JOIN item USING (record_id, pos) GROUP BY ALL""")
def answer_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are JSON objects, with how many entities, claims, statements and evidence ids they hold at any depth."""
    sets = _held(spark, sf_dir).where("held.valid").select("record_id", "pos", keyed_sets(F.col("held")).alias("s"))
    return sets.select("record_id", "pos", *[F.size(f"s.{m}").cast("bigint").alias(n) for m, n in (("entity", "entities"), ("claim", "claims"), ("statement", "statements"), ("evidence", "evidence"))])


@query(f"""WITH {PAIRS}, {_HELD}, side AS (SELECT record_id, pos, role, {_GIVEN} AS given FROM obj),
cited AS (SELECT record_id, pos, list(item) AS cited FROM item WHERE metric = 'evidence' GROUP BY ALL),
total AS (SELECT role, sum(len(given))::BIGINT AS gold, sum(coalesce(len(cited), 0))::BIGINT AS predicted, sum(coalesce(len(list_intersect(given, cited)), 0))::BIGINT AS correct FROM side LEFT JOIN cited USING (record_id, pos) WHERE given IS NOT NULL GROUP BY role)
SELECT role, gold, predicted, correct, round(correct / nullif(predicted, 0), 6) AS precision, round(correct / nullif(gold, 0), 6) AS recall FROM total""")
def answer_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids at any depth of JSON answers against those that the question gives, micro-averaged per role."""
    rows = _held(spark, sf_dir).where("held.valid and asked is not null").select("role", given_ids(F.col("asked")).alias("given"), F.col("held.evidence").alias("cited"))
    total = rows.groupBy("role").agg(F.sum(F.size("given")).alias("gold"), F.sum(F.size("cited")).alias("predicted"), F.sum(F.size(F.array_intersect("given", "cited"))).alias("correct"))
    return total.select("role", "gold", "predicted", "correct", ratio(F.col("correct"), F.col("predicted")).alias("precision"), ratio(F.col("correct"), F.col("gold")).alias("recall"))


def _against_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid answers (sets, keys) against the first valid answer of the same case and role (gold_sets, gold_keys)."""
    valid = _held(spark, sf_dir).where("held.valid and case_id is not null and role is not null").select("record_id", "pos", "role", "case_id", keyed_sets(F.col("held")).alias("sets"), F.col("held.keys").alias("keys"))
    place = F.struct("record_id", "pos")
    gold = valid.groupBy("case_id", "role").agg(F.min(place).alias("first"), F.min_by("sets", place).alias("gold_sets"), F.min_by("keys", place).alias("gold_keys"))
    return valid.join(gold, ["case_id", "role"]).where(place != F.col("first")).drop("first")


_FIRSTS = """gold AS (SELECT case_id, role, min((record_id, pos)) AS first FROM obj WHERE case_id IS NOT NULL AND role IS NOT NULL GROUP BY ALL),
sample AS (SELECT o.record_id, o.pos, o.role, o.case_id, o.answer, g.first[1] AS gold_record, g.first[2] AS gold_pos FROM obj o JOIN gold g USING (case_id, role) WHERE (o.record_id, o.pos) <> g.first)"""
_SCORED = f"""{_FIRSTS}, wanted AS (SELECT s.*, unnest(CASE WHEN role = 'a1' THEN ['evidence', 'entity', 'claim'] ELSE ['evidence', 'statement'] END) AS metric FROM sample s),
scored AS (SELECT w.record_id, w.pos, w.role, w.metric, (SELECT count(*) FROM item p JOIN item g ON g.item = p.item AND g.metric = p.metric WHERE p.record_id = w.record_id AND p.pos = w.pos AND p.metric = w.metric AND g.record_id = w.gold_record AND g.pos = w.gold_pos) AS correct,
  (SELECT count(*) FROM item p WHERE p.record_id = w.record_id AND p.pos = w.pos AND p.metric = w.metric) AS predicted, (SELECT count(*) FROM item g WHERE g.record_id = w.gold_record AND g.pos = w.gold_pos AND g.metric = w.metric) AS gold FROM wanted w)"""


def _prf_sql(source: str, columns: str) -> str:
    return f"""SELECT {columns}, correct, predicted, gold, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted WHEN gold = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p, CASE WHEN gold > 0 THEN correct / gold ELSE 1.0::DOUBLE END AS r FROM {source})"""


@query(f"WITH {PAIRS}, {_HELD}, {_SCORED} {_prf_sql('scored', 'record_id, pos, role, metric')}")
def role_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each answer agrees with the first one on its case and role: sets of evidence, entities, claims or statements."""
    return scored_samples(_against_first(spark, sf_dir).drop("keys", "gold_keys", "case_id")).select("record_id", "pos", "role", "metric", "correct", "predicted", "gold", "precision", "recall", "f1")


@query(f"""WITH {PAIRS}, {_HELD}, {_SCORED}, total AS (SELECT role, metric, count(*) AS available, sum(correct)::BIGINT AS correct, sum(predicted)::BIGINT AS predicted, sum(gold)::BIGINT AS gold FROM scored GROUP BY ALL)
{_prf_sql("total", "role, metric, available")}""")
def role_prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_scores(role_scores(spark, sf_dir), ["role"]).select("role", "metric", "available", "correct", "predicted", "gold", "precision", "recall", "f1")


@query(f"""WITH {PAIRS} SELECT metadata.role AS role, count(*) AS samples, count(*) FILTER (WHERE {_OBJECT}) AS valid, count(*) FILTER (WHERE NOT ({_OBJECT})) AS failures, round(count(*) FILTER (WHERE {_OBJECT}) / count(*), 6) AS json_valid_rate
FROM pair WHERE answer IS NOT NULL GROUP BY ALL""")
def role_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role: answers, those that are JSON objects and those that aren't."""
    valid = F.count_if("held.valid")
    return _held(spark, sf_dir).groupBy("role").agg(F.count("*").alias("samples"), valid.alias("valid"), F.count_if(~F.col("held.valid")).alias("failures"), ratio(valid, F.count("*")).alias("json_valid_rate"))


@query(f"""WITH {PAIRS}, {_HELD}, {_SCORED}, cover AS (SELECT s.record_id, s.pos, s.role, len(list_intersect(json_keys(s.answer), json_keys(g.answer))) / len(json_keys(g.answer)) AS coverage FROM sample s JOIN obj g ON g.record_id = s.gold_record AND g.pos = s.gold_pos),
ev AS (SELECT record_id, pos, CASE WHEN predicted > 0 THEN correct / predicted WHEN gold = 0 THEN 1 ELSE 0 END AS p, CASE WHEN gold > 0 THEN correct / gold ELSE 1 END AS r FROM scored WHERE metric = 'evidence')
SELECT role, count(*) AS samples, round(avg(coverage), 6) AS mean_key_coverage, round(avg(p), 6) AS mean_evidence_precision, round(avg(r), 6) AS mean_evidence_recall FROM cover JOIN ev USING (record_id, pos) GROUP BY role""")
def report_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per role: how many of the wanted top-level keys answers have, and their mean precision and recall of evidence."""
    pairs = _against_first(spark, sf_dir)
    size = lambda c: F.size(c).cast("double")
    coverage = F.when(F.size("gold_keys") > 0, size(F.array_intersect("keys", "gold_keys")) / size("gold_keys")).otherwise(1.0)
    ev = prf(F.size(F.array_intersect("sets.evidence", "gold_sets.evidence")), F.size("sets.evidence"), F.size("gold_sets.evidence"))
    each = pairs.select("role", coverage.alias("coverage"), ev["precision"].alias("p"), ev["recall"].alias("r"))
    return each.groupBy("role").agg(F.count("*").alias("samples"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("coverage", "mean_key_coverage"), ("p", "mean_evidence_precision"), ("r", "mean_evidence_recall"))])


@query(f"""WITH {PAIRS} SELECT record_id, pos, {_OBJECT} AS whole, json_extract_string(answer, '$') IS NOT NULL AS parsed FROM pair WHERE answer LIKE '{{%"entities"%"claims"%}}' AND {_OBJECT}""")
def json_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers inside which a JSON object with entities and claims stands: whether it is the whole answer."""
    rows = _pairs_of(spark, sf_dir).where("answer is not null").withColumn("found", json_in_prose(F.col("answer"), ("entities", "claims"))).where("found is not null")
    return rows.select("record_id", "pos", F.col("found").eqNullSafe(canonical_json("answer")).alias("whole"), F.lit(True).alias("parsed"))


@query("""WITH place AS (SELECT record_id, coalesce(metadata.source_name, '') AS source_name, row_number() OVER (PARTITION BY coalesce(metadata.source_name, '') ORDER BY record_id) AS turn FROM chat_records)
SELECT record_id, source_name, turn FROM place ORDER BY turn, source_name LIMIT 500""")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 records, taken from the sources in turn."""
    rows = _records(spark, sf_dir).select("record_id", F.coalesce("metadata.source_name", F.lit("")).alias("source_name"))
    return round_robin(rows, "source_name", "record_id", 500).select("record_id", "source_name", F.col("turn").cast("bigint").alias("turn"))


_BUDGET, _MASK = 120, -100


@query(rf"""WITH {PAIRS}, word AS (SELECT record_id, pos, regexp_extract_all(asked, '[^ \t\n]+') AS p, regexp_extract_all(answer, '[^ \t\n]+') AS a FROM pair WHERE asked IS NOT NULL AND answer IS NOT NULL),
kept AS (SELECT record_id, pos, a, len(p) AS n, CASE WHEN len(p) + len(a) > {_BUDGET} THEN p[len(p) - ({_BUDGET} - len(a)) + 1:] ELSE p END AS p FROM word WHERE len(a) > 0 AND (len(p) + len(a) <= {_BUDGET} OR len(a) < {_BUDGET}))
SELECT record_id, pos, len(p) AS prompt_words, len(a) AS answer_words, n - len(p) AS cut_words, md5(array_to_string(list_concat(p, a), ' ')) AS words, md5(array_to_string(list_concat(list_transform(p, lambda x: '{_MASK}'), a), ' ')) AS labels FROM kept""")
def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer words fitted into a budget: the answer whole, the question cut at its front, its labels masked."""
    word = lambda c: F.regexp_extract_all(c, F.lit(r"([^ \t\n]+)"), F.lit(1)).alias(c)
    rows = _pairs_of(spark, sf_dir).where("asked is not null and answer is not null").select("record_id", "pos", word("asked"), word("answer"))
    fitted = budgeted(rows, "asked", "answer", _BUDGET, str(_MASK))
    return fitted.select("record_id", "pos", F.size("prompt").cast("bigint").alias("prompt_words"), F.size("answer").cast("bigint").alias("answer_words"), F.col("cut").cast("bigint").alias("cut_words"), F.md5(F.array_join("words", " ")).alias("words"), F.md5(F.array_join("labels", " ")).alias("labels"))


@query(rf"""WITH {PAIRS}, word AS (SELECT record_id // 32 AS batch, record_id, pos, len(regexp_extract_all(answer, '[^ \t\n]+')) AS n FROM pair WHERE answer IS NOT NULL), widest AS (SELECT batch, max(n) AS width FROM word GROUP BY batch)
SELECT batch, width, count(*) AS rows, sum(n)::BIGINT AS words, sum(width - n)::BIGINT AS padding FROM word JOIN widest USING (batch) GROUP BY ALL""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of 32 neighbouring records padded to the longest of them: how much of each batch is padding."""
    words = F.regexp_extract_all("answer", F.lit(r"([^ \t\n]+)"), F.lit(1))
    rows = _pairs_of(spark, sf_dir).where("answer is not null").select(F.expr("record_id div 32").alias("batch"), words.alias("words"))
    each = padded(rows, "batch", "words", "<pad>")
    padding = F.size("words") - F.aggregate("attention", F.lit(0), lambda a, x: a + x)
    return each.groupBy("batch").agg(F.max(F.size("words")).cast("bigint").alias("width"), F.count("*").alias("rows"), F.sum(F.size("words") - padding).alias("words"), F.sum(padding).alias("padding"))


@query("""WITH ranked AS (SELECT run_id, decision, row_number() OVER (PARTITION BY run_id ORDER BY created_at, issue_row) AS first, row_number() OVER (PARTITION BY run_id ORDER BY created_at DESC, issue_row DESC) AS last FROM review_issues)
SELECT f.run_id, f.decision AS first_decision, l.decision AS last_decision FROM ranked f JOIN ranked l ON f.run_id = l.run_id WHERE f.first = 1 AND l.last = 1""")
def review_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last decision on each run, by time and row; one aggregate, no window over a hot run."""
    order = F.struct("created_at", "issue_row", "decision")
    ends = table(spark, sf_dir, "review_issues").groupBy("run_id").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    return ends.select("run_id", F.col("a.decision").alias("first_decision"), F.col("b.decision").alias("last_decision"))


_FIRST_LAST = """ends AS (SELECT run_id, arg_min(decision, (created_at, issue_row)) AS predicted, arg_max(decision, (created_at, issue_row)) AS gold FROM review_issues GROUP BY run_id),
label AS (SELECT unnest(['approve', 'revise', 'reject']) AS label), grid AS (SELECT g.label AS gold, p.label AS predicted, count(e.run_id) AS n FROM label g CROSS JOIN label p LEFT JOIN ends e ON e.gold = g.label AND e.predicted = p.label GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_first_last(spark, sf_dir).select(F.col("last_decision").alias("gold"), F.col("first_decision").alias("predicted"))


@query(f"WITH {_FIRST_LAST} SELECT * FROM grid")
def decision_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a run's first decision foretells its last one."""
    return confusion(_pairs(spark, sf_dir), _DECISIONS)


@query(f"""WITH {_FIRST_LAST}, c AS (SELECT l.label, sum(CASE WHEN gold = label AND predicted = label THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN gold <> label AND predicted = label THEN n ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN gold = label AND predicted <> label THEN n ELSE 0 END)::BIGINT AS fn FROM label l CROSS JOIN grid GROUP BY l.label)
SELECT label, tp + fn AS support, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
  round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM c""")
def decision_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_metrics(confusion(_pairs(spark, sf_dir), _DECISIONS))


_NEAR, _FAR = "teacher_model_profile LIKE 'local%'", "teacher_model_profile LIKE 'remote%'"


@query(f"""WITH audit AS (SELECT run_id AS id, arg_max(decision, issue_row) AS predicted, count(*) AS n FROM review_issues WHERE {_NEAR} AND trim(run_id) <> '' GROUP BY run_id),
gold AS (SELECT run_id AS id, arg_min(coalesce(decision, ''), issue_row) AS label, count(*) AS n FROM review_issues WHERE {_FAR} AND trim(run_id) <> '' GROUP BY run_id),
met AS (SELECT g.label, a.predicted FROM gold g JOIN audit a USING (id) WHERE g.label <> ''), label AS (SELECT unnest(['approve', 'revise', 'reject']) AS label),
cell AS (SELECT l.label, count(*) FILTER (WHERE m.label = l.label AND m.predicted = l.label) AS tp, count(*) FILTER (WHERE m.predicted = l.label) AS chosen, count(*) FILTER (WHERE m.label = l.label) AS support FROM label l, met m GROUP BY l.label),
f AS (SELECT label, 2 * (tp / nullif(chosen, 0)) * (tp / nullif(support, 0)) / nullif(tp / nullif(chosen, 0) + tp / nullif(support, 0), 0) AS f1, tp / nullif(chosen, 0) AS p FROM cell)
SELECT (SELECT count(*) FROM gold) AS gold_ids, (SELECT count(*) FROM gold WHERE label = '') AS pending, 0::BIGINT AS unknown, (SELECT count(*) FROM gold g WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM audit a WHERE a.id = g.id)) AS missing_audits,
  (SELECT sum(n - 1)::BIGINT FROM gold) AS repeated_gold_rows, (SELECT count(*) FROM audit WHERE n > 1) AS repeated_audit_ids, (SELECT count(*) FROM met) AS evaluated,
  (SELECT round(count(*) FILTER (WHERE label = predicted) / count(*), 6) FROM met) AS accuracy, (SELECT round(avg(f1), 6) FROM f) AS macro_f1, (SELECT round(1 - p, 6) FROM f WHERE label = 'approve') AS accepted_error_rate,
  (SELECT round(count(*) FILTER (WHERE predicted = 'approve') / count(*), 6) FROM met WHERE label = 'reject') AS unsafe_accept_rate, (SELECT round(count(*) FILTER (WHERE predicted = 'reject') / count(*), 6) FROM met WHERE label = 'approve') AS over_rejection_rate,
  (SELECT round(count(*) FILTER (WHERE predicted IN ('revise', 'reject')) / count(*), 6) FROM met WHERE label = 'revise') AS undecided_capture_rate""")
def decision_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the local reviewers' last decisions on runs compare with the remote reviewer's first ones."""
    issues = table(spark, sf_dir, "review_issues")
    audits = issues.where(_NEAR).select(F.col("run_id").alias("id"), "decision", F.col("issue_row").alias("place"))
    gold = issues.where(_FAR).select(F.col("run_id").alias("id"), F.col("decision").alias("label"), F.col("issue_row").alias("place"))
    return decision_evaluation(audits, gold, ("approve", "revise", "reject"))


_ENDED = "('approve', 'reject')"


@query(f"""SELECT split_part(run_id, '--', 1) AS arm, count(*) AS results, count(*) FILTER (WHERE decision = 'approve') AS complete, count(*) FILTER (WHERE decision IN {_ENDED}) AS ended,
round(count(*) FILTER (WHERE decision = 'approve') / nullif(count(*) FILTER (WHERE decision IN {_ENDED}), 0), 6) AS completion_rate, round(avg(latency_ms), 6) AS mean_latency FROM review_issues GROUP BY ALL""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per experiment arm: reviews, those that ended, the approved share of these, mean latency."""
    issues = table(spark, sf_dir, "review_issues").withColumn("arm", F.split_part("run_id", F.lit("--"), F.lit(1)))
    return run_summary(issues, ["arm"], "decision", "approve", ("approve", "reject"), "latency_ms")


@query(f"""WITH last AS (SELECT run_id, arg_max(decision, (created_at, issue_row)) AS status, count(*) AS attempts FROM review_issues GROUP BY run_id), planned AS (SELECT DISTINCT run_id FROM graph_claims WHERE run_id IS NOT NULL)
SELECT p.run_id, l.status, coalesce(l.attempts, 0) AS attempts, coalesce(l.status NOT IN {_ENDED}, true) AS to_run FROM planned p LEFT JOIN last l USING (run_id)""")
def latest_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run that has claims with its last review, and whether it has to be reviewed (again)."""
    return resume_plan(table(spark, sf_dir, "graph_claims").where("run_id is not null"), table(spark, sf_dir, "review_issues"), "run_id", ["created_at", "issue_row"], "decision", ("approve", "reject"))


@query("""WITH placed AS (SELECT run_id, decision, row_number() OVER (PARTITION BY run_id ORDER BY created_at, issue_row) AS n FROM review_issues)
SELECT run_id, count(*) AS attempts, min(n) FILTER (WHERE decision = 'approve') AS successful_at FROM placed GROUP BY run_id""")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: the number of reviews and which of them was the first to approve."""
    return first_success(table(spark, sf_dir, "review_issues"), "run_id", ["created_at", "issue_row"], F.col("decision") == "approve")


@query("""SELECT teacher_model_profile, count(*) AS issues, count_if(decision = 'approve') AS approved, round(count_if(decision = 'approve') / count(*), 6) AS approval_rate,
round(avg(latency_ms), 6) AS mean_latency_ms, count(latency_ms) AS timed FROM review_issues GROUP BY ALL""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = F.count_if(F.col("decision") == "approve")
    return table(spark, sf_dir, "review_issues").groupBy("teacher_model_profile").agg(F.count("*").alias("issues"), approved.alias("approved"), ratio(approved, F.count("*")).alias("approval_rate"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.count("latency_ms").alias("timed"))


@query("""SELECT CASE WHEN grouping(category) = 1 THEN '*' ELSE category END AS category, CASE WHEN grouping(severity) = 1 THEN '*' ELSE severity END AS severity, count(*) AS issues, round(avg(latency_ms), 6) AS mean_latency_ms
FROM review_issues WHERE category IS NOT NULL AND severity IS NOT NULL GROUP BY GROUPING SETS ((category, severity), (category), ())""")
def review_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by category and severity, by category, and over all, in one pass."""
    rows = table(spark, sf_dir, "review_issues").where("category is not null and severity is not null")
    grouped = rows.groupingSets([["category", "severity"], ["category"], []], "category", "severity").agg(F.grouping("category").alias("gc"), F.grouping("severity").alias("gs"), F.count("*").alias("issues"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"))
    return grouped.select(F.when(F.col("gc") == 1, "*").otherwise(F.col("category")).alias("category"), F.when(F.col("gs") == 1, "*").otherwise(F.col("severity")).alias("severity"), "issues", "mean_latency_ms")


@query("""SELECT r.case_id, count(*) AS registered FROM case_registry r WHERE NOT EXISTS (SELECT 1 FROM graph_claims c WHERE c.qualifiers['case_id'] = r.case_id) GROUP BY r.case_id""")
def cases_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered cases without any claim yet: what a resumed run still has to do (anti-join)."""
    done = table(spark, sf_dir, "graph_claims").select(F.try_element_at("qualifiers", F.lit("case_id")).alias("case_id")).where("case_id is not null").distinct()
    return table(spark, sf_dir, "case_registry").join(done, "case_id", "left_anti").groupBy("case_id").agg(F.count("*").alias("registered"))


@query("""WITH have AS (SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT coalesce(t.source, h.source) AS source, t.source IS NOT NULL AS listed, coalesce(h.documents, 0) AS documents, CASE WHEN t.source IS NULL THEN 'unlisted' WHEN h.source IS NULL THEN 'missing' ELSE 'ok' END AS state
FROM mix_targets t FULL JOIN have h ON t.source = h.source""")
def catalogue_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed sources against those that have documents."""
    have = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("documents"))
    listed = table(spark, sf_dir, "mix_targets").select("source", F.lit(True).alias("listed"))
    both = listed.join(have, "source", "full")
    state = F.when(F.col("listed").isNull(), "unlisted").when(F.col("documents").isNull(), "missing").otherwise("ok")
    return both.select("source", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("documents", F.lit(0)).alias("documents"), state.alias("state"))


@query("""WITH have AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), met AS (SELECT coalesce(t.source, h.source) AS source, t.source AS listed, t.target_share AS share, t.max_repeats AS repeats, h.n FROM mix_targets t FULL JOIN have h ON t.source = h.source)
SELECT source, unnest(list_filter([CASE WHEN listed IS NULL THEN 'unlisted' END, CASE WHEN n IS NULL THEN 'missing' END, CASE WHEN share <= 0 THEN 'weight' END, CASE WHEN repeats < 1 THEN 'repeats' END], lambda x: x IS NOT NULL)) AS violation FROM met""")
def catalogue_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the catalogue of sources, one row a violation."""
    have = table(spark, sf_dir, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    both = table(spark, sf_dir, "mix_targets").withColumn("listed", F.lit(True)).join(have, "source", "full")
    wrong = {"unlisted": F.col("listed").isNull(), "missing": F.col("n").isNull(), "weight": F.col("target_share") <= 0, "repeats": F.col("max_repeats") < 1}
    return both.select("source", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]))).alias("violation"))


@query(r"""SELECT doc_id, md5(regexp_replace(text, '[A-Z]{2,4}-\d[A-D]-\d{3}', '[TAG]', 'g')) AS redacted, len(regexp_extract_all(text, '[A-Z]{2,4}-\d[A-D]-\d{3}'))::BIGINT AS tags FROM documents WHERE text IS NOT NULL""")
def documents_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with every equipment tag replaced, as hashes, and how many tags each had."""
    tag = r"[A-Z]{2,4}-\d[A-D]-\d{3}"
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(redacted(F.col("text"), tag, "[TAG]")).alias("redacted"), F.size(F.regexp_extract_all("text", F.lit(f"({tag})"), F.lit(1))).cast("bigint").alias("tags"))


@query(f"""WITH hashed AS (SELECT doc_id, source, md5({key("text")}) AS content FROM documents WHERE text IS NOT NULL) SELECT content, min(doc_id) AS first_id, count(*) AS copies, count(DISTINCT source) AS sources FROM hashed GROUP BY content HAVING count(*) > 1""")
def documents_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with the same text, white space and letter case aside; the first one stands for its group."""
    hashed = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.md5(metric_key(F.col("text"))).alias("content"))
    return hashed.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources")).where("copies > 1")


@query(r"""SELECT run_id, regexp_replace(run_id, '[^\p{L}\p{N}_-]', '-', 'g') AS safe_name, CASE WHEN regexp_matches(lower(run_id), 'ext-(\d+)') THEN 'EXT-' || regexp_extract(lower(run_id), 'ext-(\d+)', 1) END AS case_id, count(*) AS claims FROM graph_claims GROUP BY ALL""")
def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "graph_claims").groupBy("run_id").agg(F.count("*").alias("claims"))
    return runs.select("run_id", safe_name(F.col("run_id")).alias("safe_name"), case_label(F.col("run_id")).alias("case_id"), "claims")


@query(r"""SELECT record_id, 'x1--' || CASE WHEN trim(coalesce(metadata.sample_id, '')) <> '' THEN regexp_replace(metadata.sample_id, '[^\p{L}\p{N}_-]', '-', 'g') ELSE 'unlabeled-' || substr(sha256(record_id::VARCHAR || ':' || coalesce(messages[1].content, '')), 1, 12) END AS name FROM chat_records""")
def record_run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of the run of each record in an experiment."""
    record = F.concat_ws(":", F.col("record_id").cast("string"), F.coalesce(F.get("messages", F.lit(0))["content"], F.lit("")))
    return _records(spark, sf_dir).select("record_id", run_name(F.lit("x1"), F.col("metadata.sample_id"), record).alias("name"))


@query("""WITH step AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, event_type, count(*) AS n FROM step WHERE before IS NOT NULL GROUP BY ALL""")
def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often one kind of event follows another of the same user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(order).alias("before"))
    return steps.where("before is not null").groupBy("before", "event_type").agg(F.count("*").alias("n"))


@query("""WITH best AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WHERE value IS NOT NULL)
SELECT user_id, count(*) AS records, min(value) AS best FROM best WHERE before IS NULL OR value < before GROUP BY user_id""")
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user, how often a value fell below all earlier ones, and the lowest."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    best = table(spark, sf_dir, "events").where("value is not null").select("user_id", "value", F.min("value").over(order).alias("before"))
    return best.where("before is null or value < before").groupBy("user_id").agg(F.count("*").alias("records"), F.min("value").alias("best"))


@query()
def weighted_source_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document a source drawn with the target shares, counted: seeded sampling with replacement."""
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share")
    drawn = weighted_draws(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", targets, "source", "target_share")
    return drawn.groupBy("source").agg(F.count("*").alias("draws"))
