import random
from collections import defaultdict

from plumbline.llm import grouped_split as g

META = "record_id bigint, metadata struct<sample_id string, source_name string, split string, case_id string, role string>"
REGISTRY = "case_row bigint, case_id string, author_id string, source_document string"


def test_case_numbers(spark):
    from pyspark.sql import functions as F

    texts = {"a3.EXT000135.v541": 135, "ext-7_turn0": 7, "ext_007-u1": 7, "text-5-s1": None, "context-9": None, "next-4": None, " EXT 12 ": 12, "pk-Ext-3-r9": 3, "ext-": None, None: None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", g.case_number(F.regexp_replace("t", "_", "-")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts


def test_against_union_find(spark):
    r = random.Random(3)
    registry = [(i, f"EXT-{i}", r.choice([None, "", "unknown", "-", f" AU-{r.randint(1, 40)}", f"au-{r.randint(1, 40)}"]), r.choice([None, "n/a", f"rpt_{r.randint(1, 90)}.txt", f"RPT_{r.randint(1, 90)}.TXT "])) for i in range(1, 80)]
    records = [(i, (r.choice([f"free-{i}", f"ext-{r.randint(1, 120)}-s{i}", None]), "s", None, r.choice([f"EXT-{r.randint(1, 120)}", "unknown", None, f"ext_{r.randint(1, 120)}"]), None)) for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, _, a, s in registry:
        find(i)
        for k, v in (("a", a), ("s", s)):
            v = (v or "").strip().lower()
            if v not in g.PLACEHOLDERS:
                parent[find(i)] = find(seen.setdefault((k, v), i))
    named = {}
    for i, (s, _, _, c, _) in records:
        ns = [int(x.split("-")[1]) for x in [s or ""] if x.startswith("ext-")] + [int(x.replace("_", "-").split("-")[1]) for x in [c or ""] if x.lower().startswith("ext")]
        if ns:
            named[i] = ns[0]
            for n in ns[1:]:
                parent[find(n)] = find(ns[0])
            find(ns[0])
    least = defaultdict(lambda: 10**9)
    for n in list(parent):
        least[find(n)] = min(least[find(n)], n)
    want = {i: least[find(n)] for i, n in named.items()}
    frame, reg = spark.createDataFrame(records, META), spark.createDataFrame(registry, REGISTRY)
    groups = g.record_groups(frame, reg)
    assert {x.record_id: x.group_case for x in groups.where("group_case is not null").collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    split = g.assign_splits(g.split_groups(frame, reg), targets).collect()
    assert len(split) == len(records) and all(x.split in ("train", "validation", "test") for x in split)
    by_group = defaultdict(set)
    for x in split:
        by_group[x.split_group].add(x.split)
    assert all(len(v) == 1 for v in by_group.values())
    places = {x.record_id: x.split for x in split}
    ties = defaultdict(set)
    for i, n in named.items():
        ties[least[find(n)]].add(places[i])
    assert all(len(v) == 1 for v in ties.values())


def test_shared_sample_ids_stay_together(spark):
    """A sample_id ties a record with a case to one without, whatever its spelling."""
    rows = []
    for i in range(50):
        rows += [(3 * i, (f"abc-{i}", None, None, f"EXT-{i}", None)), (3 * i + 1, (f" ABC-{i}", None, None, None, None)), (3 * i + 2, (f"abc-{i}", None, None, f"EXT-{i + 1000}", None))]
    rows += [(900, (None, None, None, None, None)), (901, ("unknown", None, None, None, None)), (902, ("unknown", None, None, None, None))]
    targets = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, target_share double")
    split = g.assign_splits(g.split_groups(spark.createDataFrame(rows, META), spark.createDataFrame([], REGISTRY)), targets).collect()
    groups = {x.record_id: x.split_group for x in split}
    assert len(groups) == len(rows) and len({x.split for x in split}) == 2
    assert all(groups[3 * i] == groups[3 * i + 1] == groups[3 * i + 2] == f"g{i}" for i in range(50))
    assert {groups[900], groups[901], groups[902]} == {"r900", "r901", "r902"}


def test_long_chain_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.component for r in g.hash_to_min(chain).collect()} == {0}
    star = spark.createDataFrame([(7, i) for i in range(8, 400)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.component for r in g.hash_to_min(star, large_cluster=50).collect()}
    assert got == {**{i: 7 for i in range(7, 400)}, 1000: 1000, 1001: 1000}
    empty = g.record_groups(spark.createDataFrame([], META), spark.createDataFrame([], REGISTRY))
    assert empty.count() == 0


def test_rendezvous_shares(spark):
    from pyspark.sql import functions as F

    groups = spark.range(20000).select(F.concat(F.lit("g"), "id").alias("split_group"))
    targets = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0)], "split_name string, target_share double")
    share = g.assign_splits(groups, targets)
    assert abs(share.where("split = 'a'").count() / 20000 - 0.7) < 0.02 and share.where("split = 'c'").count() == 0
    many = spark.createDataFrame([(f"s{i}", 1 / 1001) for i in range(1001)], "split_name string, target_share double")
    assert g.assign_splits(groups, many).select("split").distinct().count() == 1001
    assert g.assign_splits(groups, targets.where("target_share < 0")).where("split is null").count() == 20000
