import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as x
from plumbline.operators import graph_checks as checks
from plumbline.operators.lexical import overlap_scores, postings, top_k
from plumbline.operators.metrics import class_metrics, confusion, micro_prf, set_counts
from plumbline.operators.sampling import round_robin, weighted_draws

CLAIM = "claim_row bigint, run_id string, claim_index int, subject_id string, subject string, predicate string, predicate_normalized string, object_id string, object string, subject_type string, object_type string, confidence double, evidence_ids array<string>, qualifiers map<string,string>"


def claim(row, s, p, o, run="r", st="a", ot="b", ids=(), q=None, sid=None):
    return (row, run, row, sid, s, p, None, None, o, st, ot, 0.5, list(ids), q)


def test_tokens(spark):
    texts = {"阀门卡涩 AB-1": ["阀门", "门卡", "卡涩", "ab", "1"], "轴": [], "hello world": ["helloworld"], "": [], None: None, "A阀门b": ["阀门", "a", "b"]}
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", x.lexical_tokens(F.col("t")).alias("k")).collect()}
    assert got == texts


def test_text_keys(spark):
    frame = spark.createDataFrame([(" Straße　１ ",), (None,), ("",)], "t string").select(x.comparison_key(F.col("t")).alias("c"), x.metric_key(F.col("t")).alias("m"), x.case_label(F.col("t")).alias("e"))
    assert [tuple(r) for r in frame.collect()] == [("strasse 1", "straße１", None), (None, None, None), ("", "", None)]


def test_retrieval_against_loops(spark):
    docs = [(1, "a", "pump valve pump"), (2, "b", "pump, pump, pump"), (3, "b", "valve,gear"), (4, "a", "gear"), (5, None, "pump")]
    entries = postings(spark.createDataFrame([(i, g, t.replace(" ", ",")) for i, g, t in docs], "entry bigint, entry_group string, t string"), "entry", "entry_group", "t")
    asked = entries.where("entry = 1").select(F.col("entry").alias("query"), F.col("entry_group").alias("query_group"), "token", "n")
    got = [(r.entry, r.score, r["rank"]) for r in top_k(overlap_scores(asked, entries), 2).orderBy("rank").collect()]
    assert got == [(2, 2.0, 1), (3, 1.0, 2)]


def test_checks(spark):
    claims = spark.createDataFrame(
        [
            claim(1, "A", "causes", "B", q={"polarity": "positive"}), claim(2, " a ", "Causes", "b", q={"polarity": "denied"}), claim(3, "b", "causes", "A", q={"polarity": "negated"}), claim(4, "b", "causes", "b", ids=["e1", "e2", "e2"]),
            claim(5, None, "causes", "", st=None), claim(6, "a", "causes", "b", run="other", q={"polarity": "negative"}), claim(7, "A", "causes", "B", st="c", q={"polarity": "negative"}),
        ], CLAIM,
    )
    keyed = checks.keyed_claims(claims)
    assert {r.claim_row: r.s_key for r in checks.keyed_claims(spark.createDataFrame([claim(1, " Ｖａｌｖｅ  A ", "x", "STRASSE"), claim(2, None, "x", "")], CLAIM)).collect()} == {1: "valve a", 2: None}
    assert [r.claim_row for r in checks.incomplete(keyed).collect()] == [5]
    assert [r.claim_row for r in checks.self_loops(keyed).collect()] == [4]
    assert [(r.run_id, r.s_key, r.n) for r in checks.duplicates(keyed).collect()] == [("r", "a", 3)]
    assert [(r.run_id, r.low, r.high) for r in checks.reverse_edges(keyed).collect()] == [("r", "a", "b")]
    assert [(r.s_key, r.affirmed, r.denied) for r in checks.polarity_conflicts(keyed).collect()] == [("a", 1, 1)]
    evidence = spark.createDataFrame([(1, "r", "e1", "one"), (2, "r", "e1", "last"), (3, "other", "e2", "x")], "evidence_row bigint, run_id string, source_id string, excerpt string")
    assert [tuple(r) for r in checks.missing_evidence(claims, evidence).collect()] == [(4, "r", "e2")]
    assert {(r.claim_row, r.excerpts) for r in checks.cited_excerpts(claims, evidence).collect()} == {(4, "last  ")}
    assert checks.type_conflicts(claims).count() == 2
    assert checks.duplicates(checks.keyed_claims(claims.limit(0))).count() == 0


def test_candidate_edges(spark):
    from plumbline.operators.candidate_edges import candidate_edges, document_sentences, mentions

    docs = spark.createDataFrame([(1, "c", "甲泵老化，乙阀泄漏，最终造成丙机跳闸。无关句。甲泵由乙阀组成"), (2, "d", "甲泵造成丙机跳闸"), (3, None, "甲泵造成丙机"), (4, "c", None)], "doc_id bigint, case_id string, text string")
    names = spark.createDataFrame([("c", "甲泵"), ("c", "乙阀"), ("c", "丙机"), ("c", "丁"), ("d", "甲泵"), ("c", None)], "case_id string, name string")
    got = {(r.doc_id, r.subject, r.predicate, r.object, r.trigger) for r in candidate_edges(mentions(document_sentences(docs), names)).collect()}
    assert got == {(1, "甲泵", "导致", "丙机", "造成"), (1, "乙阀", "导致", "丙机", "造成"), (1, "甲泵", "包含", "乙阀", "由")}


def test_metrics(spark):
    gold = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "c")], "key string, item string")
    pred = spark.createDataFrame([("k", "a"), ("k", "a"), ("k", "z")], "key string, item string")
    got = micro_prf(set_counts(gold, pred, ["key"], "item").withColumn("all", F.lit(1)), ["all"]).first()
    assert (got.gold, got.predicted, got.correct, got.precision, got.recall, got.f1) == (3, 2, 1, 0.5, 0.333333, 0.4)
    pairs = spark.createDataFrame([("x", "x"), ("x", "y")], "gold string, predicted string")
    grid = confusion(pairs, ["x", "y", "z"])
    assert grid.count() == 9
    by = {r.label: r for r in class_metrics(grid).collect()}
    assert (by["x"].precision, by["x"].recall, by["z"].precision, by["z"].support) == (1.0, 0.5, None, 0)


def test_sampling(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "id bigint, g string")
    got = [(r.g, r.turn) for r in round_robin(rows, "g", "id", 5).collect()]
    assert got == [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("a", 3)]
    weights = spark.createDataFrame([("p", 3.0), ("q", 1.0), ("r", 0.0)], "name string, w double")
    share = weighted_draws(spark.range(20000), "id", weights, "name", "w").groupBy("name").count().collect()
    assert {r.name for r in share} == {"p", "q"} and abs({r.name: r["count"] for r in share}["p"] / 20000 - 0.75) < 0.02
    many = spark.createDataFrame([(f"s{i:04d}", 1.0) for i in range(1001)], "name string, w double")
    drawn = weighted_draws(spark.range(50000), "id", many, "name", "w")
    assert drawn.where("name is null").count() == 0 and drawn.select("name").distinct().count() == 1001
    assert weighted_draws(spark.range(3), "id", weights.where("w < 0"), "name", "w").where("name is null").count() == 3


def test_jsonl_source(spark, tmp_path):
    from plumbline.sources.jsonl import read_jsonl, write_jsonl

    path = tmp_path / "in.jsonl"
    path.write_text('{"id": 1, "tags": ["a"]}\n\n   \n{"id": 2, "tags": null}\n', encoding="utf-8")
    rows = read_jsonl(spark, str(path), "id bigint, tags array<string>")
    assert sorted((r.id, r.tags) for r in rows.collect()) == [(1, ["a"]), (2, None)]
    write_jsonl(rows, str(tmp_path / "out"))
    assert read_jsonl(spark, str(tmp_path / "out"), "id bigint, tags array<string>").count() == 2
    with pytest.raises(Exception):
        write_jsonl(rows, str(tmp_path / "out"), fresh=True)
    path.write_text('{"id": 1}\n{"id": broken\n', encoding="utf-8")
    with pytest.raises(Exception):
        read_jsonl(spark, str(path), "id bigint").collect()


def test_catalogue_source(spark, tmp_path):
    from plumbline.sources.jsonl import read_catalogue

    for name, n in (("a", 2), ("b", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in range(n)))
    catalogue = {"a": {"path": str(tmp_path / "a.jsonl"), "rows": 2}, "b": {"path": str(tmp_path / "b.jsonl"), "rows": 3}}
    rows = read_catalogue(spark, catalogue, "id bigint")
    assert {(r.source_name, r.id) for r in rows.collect()} == {("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2)}
    catalogue["b"]["rows"] = 4
    with pytest.raises(ValueError, match="b"):
        read_catalogue(spark, catalogue, "id bigint")


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_against_sql(spark):
    """Every core query with SQL gives the rows that the SQL gives."""
    import duckdb

    import __spark_entry__ as entry

    from plumbline.plans.catalogue import ORACLES

    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"create view {name[:-8]} as select * from read_parquet('{DATA}/{name}')")
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    for name, sql in ORACLES.items():
        frame = entry.queries()[name](spark, DATA)
        order = sorted(frame.columns)
        ours = sorted(str([plain(r[c]) for c in order]) for r in frame.collect())
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        theirs = sorted(str([plain(dict(zip(columns, r))[c]) for c in order]) for r in result.fetchall())
        assert sorted(columns) == order and ours == theirs, name
    assert entry.entry(spark).count() > 0


def test_json_walker(spark):
    from plumbline.functions import jsonwalk as j

    deep = {"a": [{"evidence_ids": ["e1", 2, "e]2"], "statement": " S 1 "}], "b": {"c": {"evidence_ids": ["e1"], "content": ""}}, "entities": [{"name": "A b"}, "no", {"name": None}], "claims": [{"subject": "s", "predicate": "p", "object": 3}, {"subject": ""}]}
    valid, keys, evidence, statements, entities, claims = j.held(json.dumps(deep))
    assert (valid, keys, evidence, statements, entities, claims) == (True, ["a", "b", "claims", "entities"], ["e1", "e]2"], [" S 1 "], ["A b"], [{"subject": "s", "predicate": "p", "object": "3"}])
    assert all(not j.held(t)[0] for t in ("", "[1]", "{", "1", "[" * 100_000))
    assert j.first_object('so {"x": 1} and {"a": {"b": 2}, "c": 3} {"a": 1}', ("a", "c"), True) == '{"a":{"b":2},"c":3}' and j.first_object("{{{", ("a",), True) is None
    assert j.first_object('{"z": 1, "q": "{\\"a\\": 1}"}', ("a", "z"), False) == '{"q":"{\\"a\\": 1}","z":1}'
    assert j.canonical('{"b": 1, "a": "é"}') == j.canonical('{ "a":"é","b":1}') and j.canonical("x") is None
    rows = spark.createDataFrame([(1, '{"k": ["sk-abcdefgh12", {"sk-abcdefgh12": "see sk-ABCDEFGH_-9."}]}'), (2, "plain sk-abcdefgh12 text"), (3, None), (3, None)], "id int, t string")
    got = sorted(((r.id, r.t, r.f is None) for r in rows.select("id", j.json_redacted("t").alias("t"), j.json_fingerprint("t").alias("f")).collect()), key=str)
    assert got == [(1, '{"k": ["[REDACTED_API_KEY]", {"sk-abcdefgh12": "see [REDACTED_API_KEY]."}]}', False), (2, "plain [REDACTED_API_KEY] text", True), (3, None, True), (3, None, True)]
    errors = spark.createDataFrame([('{"error": {"type": "t", "code": 5, "message": "m"}}',), ("no",), (None,)], "p string").select(j.error_details(F.col("p")).alias("e")).collect()
    assert [tuple(r.e) for r in errors] == [("t", None, "m"), (None, None, None), (None, None, None)]
    parts = "array<struct<type string, content array<struct<type string, text string>>>>"
    rows = spark.createDataFrame([(" x ", None), ("", [("other", None), ("message", [("output_text", " y ")])]), (None, [])], f"d string, o {parts}")
    assert [r.t for r in rows.select(j.response_text(F.col("d"), F.col("o")).alias("t")).collect()] == ["x", "y", None]


def test_set_scores(spark):
    from plumbline.operators.evaluation import micro_scores, scored_samples

    sets = "struct<entity array<string>, claim array<string>, statement array<string>, evidence array<string>>"
    rows = [("a1", (["a", "b"], [], [], []), (["a"], ["c"], [], [])), ("a3", ([], [], [], ["e"]), ([], [], ["s"], [])), ("a1", (["z"], [], [], []), ([], [], [], []))]
    scored = scored_samples(spark.createDataFrame(rows, f"role string, sets {sets}, gold_sets {sets}")).collect()
    got = {(r.role, r.metric, r.predicted, r.gold): (r.precision, r.recall, r.f1) for r in scored}
    assert got[("a1", "entity", 2, 1)] == (0.5, 1.0, 0.666667) and got[("a1", "evidence", 0, 0)] == (1.0, 1.0, 1.0) and got[("a1", "claim", 0, 1)] == (0.0, 0.0, 0.0)
    assert got[("a3", "evidence", 1, 0)] == (0.0, 1.0, 0.0) and got[("a3", "statement", 0, 1)] == (0.0, 0.0, 0.0) and got[("a1", "entity", 1, 0)] == (0.0, 1.0, 0.0)
    micro = {r.metric: (r.available, r.correct, r.predicted, r.gold, r.precision, r.recall) for r in micro_scores(scored_samples(spark.createDataFrame(rows, f"role string, sets {sets}, gold_sets {sets}")), []).collect()}
    assert micro["entity"] == (2, 1, 3, 1, 0.333333, 1.0) and micro["statement"] == (1, 0, 0, 1, 0.0, 0.0)


def test_decision_evaluation(spark):
    from plumbline.operators.evaluation import decision_evaluation

    audits = spark.createDataFrame([("1", " Accept ", 1), ("1", "reject", 2), ("2", "hold", 1), ("3", "accept", 1), ("4", "what", 1), (None, "hold", 1), ("6", "accept", 1)], "id string, decision string, place int")
    gold = spark.createDataFrame([("1", "reject", 1), ("1", "accept", 2), ("2", "HOLD", 1), ("3", "reject", 1), ("4", "hold", 1), ("5", None, 1), ("5", "hold", 2), ("", "hold", 1), ("6", "accept", 1)], "id string, label string, place int")
    r = decision_evaluation(audits, gold, ("accept", "hold", "reject")).first()
    assert (r.gold_ids, r.pending, r.missing_audits, r.repeated_gold_rows, r.repeated_audit_ids, r.evaluated) == (6, 1, 1, 2, 1, 4)
    assert (r.accuracy, r.macro_f1, r.accepted_error_rate, r.unsafe_accept_rate, r.over_rejection_rate, r.undecided_capture_rate) == (0.75, 0.777778, 0.5, 0.5, 0.0, 1.0)
    unknown = spark.createDataFrame([("2", "perhaps", 1)], "id string, label string, place int")
    assert decision_evaluation(audits, unknown, ("accept", "hold", "reject"), strict=False).first().unknown == 1
    with pytest.raises(Exception, match="perhaps"):
        decision_evaluation(audits, unknown, ("accept", "hold", "reject")).collect()
    empty = decision_evaluation(audits.limit(0), gold.limit(0), ("accept", "hold", "reject")).first()
    assert (empty.gold_ids, empty.evaluated, empty.accuracy, empty.macro_f1) == (0, 0, None, None)


def test_resume_and_strict_joins(spark):
    from plumbline.operators.evaluation import first_success, matched, resume_plan, run_summary

    results = spark.createDataFrame([("a", 1, "failed", 5.0), ("a", 2, "complete", None), ("b", 1, "complete", 1.0), ("b", 2, "failed", 3.0)], "run string, at int, status string, latency double")
    planned = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "run string")
    assert {tuple(r) for r in resume_plan(planned, results, "run", ["at"], "status", ("complete",)).collect()} == {("a", "complete", 2, False), ("b", "failed", 2, True), ("c", None, 0, True)}
    assert {tuple(r) for r in first_success(results, "run", ["at"], F.col("status") == "complete").collect()} == {("a", 2, 2), ("b", 2, 1)}
    r = run_summary(results, [], "status", "complete", ("complete", "blocked"), "latency").first()
    assert (r.results, r.complete, r.ended, r.completion_rate, r.mean_latency) == (4, 2, 2, 1.0, 3.0)
    assert matched(results, planned.distinct(), ["run"], "results").count() == 4
    with pytest.raises(Exception, match="no match for c"):
        matched(planned, results.select("run").distinct(), ["run"], "runs").collect()


def test_windows_and_padding(spark):
    from plumbline.operators.sampling import budgeted, common_prefix, padded

    rows = spark.createDataFrame([(1, list("abcd"), list("xy")), (2, list("ab"), list("x")), (3, ["a"], list("vwxyz")), (4, ["a"], []), (5, [], ["x"])], "id int, p array<string>, a array<string>")
    got = {r.id: (r.prompt, r.words, r.labels, r.cut) for r in budgeted(rows, "p", "a", 4, "-100").collect()}
    assert got == {1: (["c", "d"], list("cdxy"), ["-100", "-100", "x", "y"], 2), 2: (["a", "b"], list("abx"), ["-100", "-100", "x"], 0), 5: ([], ["x"], ["x"], 0)}
    pads = {r.id: (r.a, r.attention) for r in padded(rows.where("id < 4").withColumn("batch", F.lit(1)), "batch", "a", "_").collect()}
    assert pads[2] == (["x", "_", "_", "_", "_"], [1, 0, 0, 0, 0]) and pads[3][1] == [1] * 5
    both = spark.createDataFrame([(list("abc"), list("abd")), (list("ab"), list("abd")), ([], list("a")), (list("a"), list("b"))], "a array<string>, b array<string>")
    assert [r.n for r in both.select(common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 2, 0, 0]


def test_normalisation(spark):
    from plumbline.operators.normalise import canonical_types, claim_ids, evidence_aliases, evidence_block

    claims = spark.createDataFrame([(1, "r", 7, None, " component", "valve"), (2, "r", 1234, "own", None, " "), (3, "r", 1, None, "action", "action")], "claim_row int, run_id string, claim_index int, claim_id string, subject_type string, object_type string")
    got = {r.claim_row: (r.claim_id, r.subject_type, r.object_type, [tuple(c) for c in r.changes]) for r in claim_ids(canonical_types(claims)).collect()}
    assert got[1] == ("r-claim-007", "equipment_or_component", "valve", [("subject_type", " component", "equipment_or_component")])
    assert got[2] == ("own", None, None, []) and got[3][1:3] == ("corrective_action", "corrective_action") and len(got[3][3]) == 2
    assert claim_ids(claims.where("claim_row = 2").withColumn("claim_id", F.lit(None).cast("string"))).first().claim_id == "r-claim-1234"
    evidence = spark.createDataFrame([("processed_data", None, None, "e1"), (None, "processed_data/x", "s", None), ("rule", None, None, None)], "source_type string, source_file string, source_id string, evidence_id string")
    rows = [(r.source_type, r.source_id, [c.original for c in r.changes]) for r in evidence_aliases(evidence, F.array(F.lit("only"))).collect()]
    assert rows == [("input_text", "e1", ["processed_data", "evidence_id"]), ("input_text", "s", ["missing_processed_data_path"]), ("rule", "only", ["missing_singleton_context"])]
    assert [r.source_id for r in evidence_aliases(evidence).collect()] == ["e1", "s", None]
    block = spark.createDataFrame([([("a", "x"), ("b", None)],)], "e array<struct<source_id string, excerpt string>>").select(evidence_block(F.col("e")).alias("b")).first().b
    assert block == "[a] x\n[b] "


def test_tier_modes(spark):
    from plumbline.operators.lexical import mode_summary, tier_modes

    scores = spark.createDataFrame([(1, 10, True, 2.0), (1, 11, False, 3.0), (1, 12, True, 0.0), (2, 11, False, 1.0)], "query int, entry int, confirmed boolean, score double")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query int")
    best = tier_modes(scores, 1)
    assert {(r.mode, r.query, r.entry) for r in best.collect()} == {("confirmed_only", 1, 10), ("confirmed_plus_candidate", 1, 11), ("confirmed_plus_candidate", 2, 11)}
    assert {tuple(r) for r in mode_summary(queries, best).collect()} == {("confirmed_only", 3, 0.333333, 0.333333, 0.0), ("confirmed_plus_candidate", 3, 0.666667, 0.666667, 1.0)}


def test_all_edges_of_a_document(spark):
    """A document may have any number of edges; a limit is the caller's."""
    from plumbline.operators.candidate_edges import candidate_edges, document_sentences, mentions

    text = "。".join(f"甲{i:02d}泵造成乙{i:02d}阀停机" for i in range(30))
    docs = spark.createDataFrame([(1, "c", text)], "doc_id bigint, case_id string, text string")
    names = spark.createDataFrame([("c", f"{a}{i:02d}{b}") for i in range(30) for a, b in (("甲", "泵"), ("乙", "阀"))], "case_id string, name string")
    found = mentions(document_sentences(docs), names)
    assert candidate_edges(found).count() == 30 and candidate_edges(found, 24).count() == 24


def test_sources_and_sinks(spark, tmp_path):
    from plumbline.sources import jsonl as s

    path = tmp_path / "a.jsonl"
    path.write_text("".join(f'{{"id": {i}}}\n' if i != 7 else "broken\n" for i in range(20)) + "\n", encoding="utf-8")
    assert [r.place.rsplit("/", 1)[1] for r in s.broken_lines(spark, str(path)).collect()] == ["a.jsonl:8"]
    for name in ("n2", "n1", "x3"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": int(name[1])}))
    assert sorted(r.id for r in s.read_sorted(spark, str(tmp_path), "n*.json", "id bigint").collect()) == [1, 2]
    assert [r.id for r in s.read_sorted(spark, str(tmp_path), "n*.json", "id bigint", 1).collect()] == [1]
    two = {"second": str(tmp_path / "x3.json"), "first": str(tmp_path / "n1.json")}
    assert [(r.id, r.source_name) for r in s.read_sources(spark, two, "id bigint", 1).collect()] == [(3, "second")]
    assert s.first_record(spark, two["first"], "id bigint").first().id == 1
    (tmp_path / "none.json").write_text("")
    with pytest.raises(ValueError):
        s.first_record(spark, str(tmp_path / "none.json"), "id bigint")
    (tmp_path / "old.jsonl").write_text('{"experiment_id": "x", "run_id": "1", "status": "complete"}\n{"experiment_id": "x", "run_id": "2", "status": "running"}\n{broken\n{"experiment_id": "y", "run_id": "3", "status": "complete"}\n')
    assert [r.run_id for r in s.earlier_results(spark, str(tmp_path / "old.jsonl"), "experiment_id string, run_id string, status string", "x", ("complete",)).collect()] == ["1"]
    rows = spark.createDataFrame([(1, "key sk-abcdefgh12 " + "x" * 900, True), (2, "fine", False)], "id int, t string, bad boolean")
    for _ in range(2):
        s.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    s.write_failures(rows, str(tmp_path / "failed"), F.col("bad"), "t")
    failed = spark.read.json(str(tmp_path / "failed")).collect()
    assert len(failed) == 1 and failed[0].t.startswith("key [REDACTED_API_KEY] x") and len(failed[0].t) < 410
    s.write_summary(rows.agg(F.count("*").alias("n")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().n == 2
    with pytest.raises(Exception, match="one row"):
        s.write_summary(rows, str(tmp_path / "summary2"))
