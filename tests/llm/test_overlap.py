import random

import pytest

from plumbline.llm import overlap as o


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_few_edits_against_full_table():
    r = random.Random(1)
    for _ in range(400):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 25))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = [r.randint(0, 6)] * r.randint(0, 1)
        for most in range(5):
            assert o.few_edits(a, b, most) == (edits(a, b) <= most)


def record(i, split, text, role="user"):
    half = text.split(" ")
    k = len(half) // 2
    return (i, [("system", f"s{i}"), (role, " ".join(half[:k])), ("assistant", " ".join(half[k:]))], ("x", "src", split, None, None))


def test_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts, rows = [], []
    for i in range(240):
        if texts and r.random() < 0.6:
            t = list(r.choice(texts))
            for _ in range(r.randint(0, max(1, len(t) // 7))):
                at = r.randint(0, len(t) - 1)
                t[at : at + 1] = r.choice([[], [r.choice(words)], [r.choice(words), r.choice(words)]])
        else:
            t = [r.choice(words) for _ in range(r.choice([3, 9, 12, 30, 60, 100]))]
        texts.append(t or ["w0"])
        rows.append((i, r.choice(["train", "train", "validation", "test", None]), texts[-1]))
    schema = "record_id bigint, messages array<struct<role string, content string>>, metadata struct<sample_id string, source_name string, split string, case_id string, role string>"
    frame = spark.createDataFrame([record(i, s, " ".join(t).upper() if i % 3 else ", ".join(t).replace(",", " ,"), r.choice(["user", "Human "])) for i, s, t in rows], schema)
    want = set()
    for i, s, t in rows:
        for j, u, v in rows:
            if s == "train" and u in ("validation", "test") and edits(t, v) <= int(max(len(t), len(v)) * o.TOLERANCE + 1e-9):
                want.add((min(i, j), max(i, j)))
    got = [(min(p.train_id, p.other_id), max(p.train_id, p.other_id)) for p in o.overlaps(spark, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("rows", [[], [(1, None, ("x", None, "train", None, None)), (2, [], ("x", None, "test", None, None)), (3, [("user", None)], ("x", None, "train", None, None)), (4, [("user", "。")], None)]])
def test_empty(spark, rows):
    schema = "record_id bigint, messages array<struct<role string, content string>>, metadata struct<sample_id string, source_name string, split string, case_id string, role string>"
    assert o.overlaps(spark, spark.createDataFrame(rows, schema)).count() == 0


META = "record_id bigint, messages array<struct<role string, content string>>, metadata struct<sample_id string, source_name string, split string, case_id string, role string>"


def test_roles_count_in_every_spelling(spark):
    """The answers of ``AI`` and the questions of ``customer`` count, blanks and letter case of a role don't."""
    rows = [
        (1, [("user", "why?"), ("AI", "the pump tripped at noon")], ("x", "a", "train", None, None)),
        (2, [("user", "why?"), ("ai ", "nothing of the kind happened")], ("x", "a", "test", None, None)),
        (3, [("customer", "where is it now?"), ("gpt", "in hall four")], ("x", "a", "train", None, None)),
        (4, [("user\n", "Where is it now"), ("Assistant", "In Hall Four.")], ("x", "b", "test", None, None)),
        (5, [("user", "where is it now?"), ("bot", "in hall four")], ("x", "b", "validation", None, None)),
    ]
    frame = spark.createDataFrame(rows, META)
    assert {(r.train_id, r.other_id, r.exact) for r in o.overlaps(spark, frame).collect()} == {(3, 4, True), (3, 5, True)}


def test_counts_are_those_of_the_pairs(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, [("user", words if i % 3 else words.replace("w7", "other")), ("assistant", "fine")], ("x", "s" if i % 2 else None, ("train", "test", "validation")[i % 5 % 3], None, None)) for i in range(40)]
    rows.append((99, [("user", "quite another text of nine words in all here")], ("x", "s", "test", None, None)))
    frame = spark.createDataFrame(rows, META)
    want = {}
    for p in o.overlaps(spark, frame).join(frame.selectExpr("record_id as other_id", "metadata.split as split", "metadata.source_name as source_name"), "other_id").collect():
        w = want.setdefault((p.split, p.source_name), [set(), set(), 0])
        w[0].add(p.other_id)
        w[1] |= {p.other_id} if p.exact else set()
        w[2] += 1
    got = {(r.split, r.source_name): (r.overlapping_records, r.exact_records, r.pairs) for r in o.overlap_counts(spark, frame).collect()}
    assert got == {k: (len(a), len(b), n) for k, (a, b, n) in want.items()} and len(got) == 4


def test_counter_number():
    assert o.counter_number(0) == o.COUNTERS[0] and o.counter_number(10**12) == o.COUNTERS[1] and o.counter_number(10**8) == 1 << 24
