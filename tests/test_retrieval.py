import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from plumbline.operators import best_overlap as bo
from plumbline.operators.lexical import top_k


def texts(rng, n, ids):
    """(id, key, group, tokens): few ids, keys and groups, so that they repeat, nulls among them."""
    return [(rng.choice(ids), rng.choice(["x", "y", None]), rng.choice(["g", "h", None]), rng.choices("abcdefg", weights=[9, 5, 3, 2, 1, 1, 1], k=rng.randrange(8))) for _ in range(n)]


def by_loops(queries, entries, k, apart):
    """The k best of each query's id and key (and entry's key, if apart), by the definition."""
    def merged(rows):
        out = {}
        for i, key, group, tokens in rows:
            out.setdefault((i, key), {}).setdefault(group, Counter()).update(tokens)
        return out

    found = {}
    for q, q_groups in merged(queries).items():
        for e, e_groups in merged(entries).items():
            score = sum(sum((a & b).values()) for g, a in q_groups.items() for h, b in e_groups.items() if g != h)
            if score:
                found.setdefault((*q, e[1] if apart else 0), []).append((-score, e[0] is None, str(e[0]), str(e[1]), (*q, *e, float(score))))
    return sorted((r[-1] for rows in found.values() for r in sorted(rows, key=lambda r: r[:3])[:k]), key=str)


def scores_only(rows):
    """What ties between one id's keys leave open is left out."""
    return sorted((str((r[0], r[1], r[2], r[4])) for r in rows))


def table(rows, side):
    names = (side, f"{side}_key", f"{side}_group", "tokens")
    return pa.table(dict(zip(names, (pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())))))))


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("block", [3, 1 << 16])
def test_kernel_against_loops(monkeypatch, apart, block):
    monkeypatch.setattr(bo, "BLOCK", block)
    rng = random.Random(f"{apart} {block}")
    for _ in range(30):
        queries, entries = texts(rng, 12, range(8)), texts(rng, 60, [*range(-3, 30), 100, None])
        laid = bo._Queries(table(queries, "query"))
        coded = list(bo._coded(SimpleNamespace(value=laid.vocabulary))(table(entries, "entry").to_batches(max_chunksize=7)))
        rows = [tuple(r.values()) for b in bo._scored(SimpleNamespace(value=laid.sent), 4, apart)(coded) for r in b.to_pylist()]
        assert scores_only(rows) == scores_only(by_loops(queries, entries, 4, apart))


def test_equal_entries_are_scored_once(monkeypatch):
    """However many entries hold the same tokens, one of them is counted; groups are left out nevertheless."""
    rng = random.Random(7)
    kinds = [["a", "b"], ["b"], ["a", "a", "c"], ["c", "b", "a"]]
    entries = [(i, "x", rng.choice(["g", "g", "g", "h", None]), rng.sample(kinds[i % 4], len(kinds[i % 4]))) for i in range(600)]
    queries = [(1, None, "g", ["a", "b"]), (2, None, "h", ["a", "a"]), (3, None, "g", ["c"]), (3, None, None, ["b"]), (4, None, "i", ["a", "b", "c"])]
    laid = bo._Queries(table(queries, "query"))
    coded = list(bo._coded(SimpleNamespace(value=laid.vocabulary))(table(entries, "entry").to_batches()))
    counted, levels = [], bo._levels
    monkeypatch.setattr(bo, "_levels", lambda item, *rest: counted.append(len(set(item.tolist()))) or levels(item, *rest))
    rows = [tuple(r.values()) for b in bo._scored(SimpleNamespace(value=laid.sent), 10, False)(coded) for r in b.to_pylist()]
    assert sorted(rows, key=str) == by_loops(queries, entries, 10, False)
    assert counted == [len(kinds)]


def test_first_best():
    rng = np.random.default_rng(1)
    for most in (1, 3, 1000):
        for n in (0, 1, 9, 700, 5000):
            scores = rng.integers(0, most + 1, n)
            for floor in (0, 2):
                want = [i for i in np.argsort(-scores, kind="stable").tolist() if scores[i] > floor][:10]
                assert bo.first_best(scores, 10, floor).tolist() == want


def test_best_overlaps(spark, monkeypatch):
    rng = random.Random(3)
    queries, entries = texts(rng, 40, range(20)), texts(rng, 300, range(200))
    frame = lambda rows, side: spark.createDataFrame(rows, f"{side} bigint, {side}_key string, {side}_group string, tokens array<string>")
    for most in (1 << 16, 7):  # once in a single turn, once in several
        monkeypatch.setattr(bo, "QUERIES", most)
        best = bo.best_overlaps(frame(queries, "query"), frame(entries, "entry"), 5)
        assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()  # no pair is a row
        got = [(r.query, r.score, r["rank"]) for r in top_k(best, 5, ("query", "query_key")).collect()]
        want = Counter((r[0], r[4]) for r in by_loops(queries, entries, 5, False))
        assert Counter((q, s) for q, s, _ in got) == want
    assert bo.best_overlaps(frame(queries, "query").limit(0), frame(entries, "entry")).count() == 0
    assert bo.best_overlaps(frame(queries, "query"), frame(entries, "entry").limit(0)).count() == 0


def test_lexical_tokens(spark):
    from plumbline.functions.text import lexical_tokens

    texts = {"泵轴承 B12泵\u3000轴": ["泵轴", "轴承", "泵轴", "b12"], "泵": [], "泵A轴承承": ["轴承", "承承", "a"], "": [], "A b": ["ab"], None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lexical_tokens("t").alias("tokens")).collect()
    assert {r.t: r.tokens for r in rows} == texts


def test_queries_against_sql(spark, tmp_path):
    """Ids that stand for several documents and claims, in several sources and cases, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    from plumbline.plans import retrieval_queries as r
    from plumbline.plans.catalogue import ORACLES

    rng = random.Random(5)
    words = lambda: ", ".join(rng.choices(["pump", "gear", "valve", "shaft", "r%d" % rng.randrange(9)], k=rng.randrange(6)))
    # a source and a tier for each id: between those of one id SQL leaves ties open
    docs = [(i * 25, ["a", "b", None][i % 3], rng.choice(["EXT-1", "EXT-2", None]), words() or None) for i in (rng.randrange(40) for _ in range(80))] + [(50, "lone", "EXT-3", "pump, gear"), (50, "lone", None, "pump")]
    spark.createDataFrame(docs, "doc_id bigint, source string, case_id string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    claims = [(i, rng.choice(["x--ext-1--1", "x--ext-2--1", "x", None]), f",{words()},", words() or None, None, [None, [], ["e"], ["f"]][i % 4]) for i in (rng.randrange(50) for _ in range(120))]
    spark.createDataFrame(claims, "claim_row bigint, run_id string, subject string, predicate string, object string, evidence_ids array<string>").coalesce(1).write.parquet(str(tmp_path / "graph_claims.parquet"))
    assert "Join" not in r.ranked(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()  # no pair is a row
    with duckdb.connect() as sql:
        for name in ("documents", "graph_claims"):
            sql.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet/*.parquet'")
        for query in (r.retrieval_topk_leave_one_out, r.retrieval_summary, r.retrieval_tier_modes, r.retrieval_tier_summary):
            got = query(spark, str(tmp_path))
            want = sql.execute(ORACLES[query.__name__])
            names = [d[0] for d in want.description]
            assert sorted(map(str, (tuple(x) for x in got.select(*names).collect()))) == sorted(map(str, want.fetchall())), query.__name__
