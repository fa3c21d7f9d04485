import random

import pytest

from plumbline.llm import canonical_values as v

TERMS = [
    ("E1", "entity_type", "working_medium", "working medium", "工作介质"), ("E2", "entity_type", "equipment_or_component", "equipment or component", "设备或部件"),
    ("E3", "entity_type", "cooling_circuit", "cooling circuit", "冷却回路"), ("P1", "predicate", "causes", "causes", "造成"), ("P2", "predicate", "replaced_during", "replaced during", "更换时段"),
]
SCHEMA = "term_id string, term_kind string, term_code string, label_en string, label_zh string"


@pytest.mark.parametrize(
    "kind, value, term",
    [
        ("entity_type", "Working-Medium (tbc)", "E1"), ("entity_type", "workign medum", "E1"), ("entity_type", "ｗｏｒｋｉｎｇ＿ｍｅｄｉｕｍ", "E1"), ("entity_type", "medium of working", "E1"), ("entity_type", "cool. circ.", "E3"), ("entity_type", "component or equipment", "E2"),
        ("entity_type", "【设备或部件】（待定）", "E2"), ("entity_type", "quantum foam", "none"), ("entity_type", "causes", "none"), ("predicate", "csuses", "P1"), ("predicate", "is", "none"), ("predicate", "repl during", "P2"), ("predicate", "造成/causes", "P1"),
        ("predicate", "造成类", "P1"), ("predicate", "???", "none"), ("predicate", "x" * 5000, "none"),
    ],
)
def test_values(spark, kind, value, term):
    got = v.match_values(spark.createDataFrame([(kind, value)], "kind string, value string"), spark.createDataFrame(TERMS, SCHEMA)).collect()
    assert [(r.kind, r.value, r.term_id) for r in got] == [(kind, value, term)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pigeonhole_loses_nothing(spark):
    """Every value within k edits of a reference string is found, as by brute force."""
    r = random.Random(4)
    refs = {"workingmedium": ("E1", 4), "equipmentorcomponent": ("E2", 4), "coolingcircuit": ("E3", 4)}
    values = set()
    for _ in range(300):
        s = list(r.choice(list(refs)))
        for _ in range(r.randint(1, 6)):
            at = r.randint(0, len(s) - 1)
            s[at : at + 1] = r.choice([[], [r.choice("aeioqz")], [s[at], r.choice("aeioqz")]])
        values.add("".join(s))
    got = {x.value: x.term_id for x in v.match_values(spark.createDataFrame([("entity_type", x) for x in values], "kind string, value string"), spark.createDataFrame(TERMS, SCHEMA)).collect()}
    for x in values:
        near = sorted((distance(x, ref), t) for ref, (t, k) in refs.items() if distance(x, ref) <= k)
        if near:
            assert got[x] == near[0][1], x


def test_rows(spark):
    claims = spark.createDataFrame([(1, None, " ", "causes"), (2, "working_medium", "bogus", "CAUSES"), (2, "working_medium", "bogus", "CAUSES")], "claim_row bigint, subject_type string, object_type string, predicate string")
    terms = spark.createDataFrame(TERMS, SCHEMA)
    rows = v.entered_values(claims, terms)
    assert sorted((r.claim_row, r.field_name) for r in rows.collect()) == [(2, "object_type"), (2, "object_type"), (2, "predicate"), (2, "predicate")]
    assert v.match_values(rows.limit(0).select("kind", "value"), terms).count() == 0
