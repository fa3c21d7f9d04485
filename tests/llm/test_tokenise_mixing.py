import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import mixing as m
from plumbline.llm import tokenise as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.VOCABULARY), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder(t.serialised_model(t.VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=t.PRE_TOKEN, mergeable_ranks=t.read_ranks(t.VOCABULARY), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_and_round_trip(encoder, reference, text):
    ids = encoder.encode([text])[0]
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a" * 100_000, " " * 10_000, "\x00\x01\n\t", "👩‍🔧 轴承 ½", "1" * 5000 + "中" * 5000])
def test_odd_texts(encoder, reference, text):
    assert encoder.encode([text])[0] == reference.encode_ordinary(text)
    assert encoder.decode(encoder.encode([text])[0]) == text


def test_frame(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "same text", "z"), (3, "same text", "z")], "doc_id bigint, text string, ids string")
    rows = frame.select("doc_id", t.token_ids(spark, F.col("text")).alias("ids")).collect()
    assert [list(r.ids) for r in rows][:2] == [[], []] and rows[2].ids == rows[3].ids and len(rows[2].ids) == 2
    assert frame.limit(0).select(t.token_ids(spark, F.col("text"))).count() == 0


def test_prefix_sums(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.shiftrightunsigned(F.xxhash64("id"), 2).alias("o"), (F.col("id") % 7).cast("decimal(18,9)").alias("v"))
    got = m.prefix_sums(rows, "g", "o", "v", slice_rows=60).collect()
    for g in "012":
        run = 0
        for r in sorted((x for x in got if x.g == g), key=lambda x: x.o):
            assert r.before == run
            run += r.v


def test_mixture(spark):
    sized = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else "a", 50 + i % 40) for i in range(3000)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 4), ("c", 0.2, 2), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    plan = m.mixture_plan(sized, targets)
    used = m.mixed_documents(sized, plan)
    report = {r.source: r for r in m.mixture_report(used, plan).collect()}
    assert report["gone"].actual_share == 0 and report["gone"].tokens == 0
    for s, share in (("a", 0.2), ("b", 0.5), ("c", 0.2)):
        assert abs(report[s].actual_share - share / 0.9) < 0.01
        assert report[s].most_copies <= report[s].max_repeats
    spread = used.where("source = 'b'").agg(F.min("copies"), F.max("copies")).first()
    assert spread[1] - spread[0] <= 1
    capped = {r.source: r for r in m.mixture_report(m.mixed_documents(sized, m.mixture_plan(sized, targets, 10**7)), plan).collect()}
    assert all(capped[s].most_copies <= capped[s].max_repeats for s in "abc")
    empty = sized.limit(0)
    assert m.mixed_documents(empty, m.mixture_plan(empty, targets)).count() == 0
