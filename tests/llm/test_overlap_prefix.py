import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import overlap as o


def test_apart_always_finds_enough():
    rng = random.Random(2)
    for n in range(9, 600):
        order = list(range(n - o.SHINGLE + 1))
        for mixed in (order, order[::-1], sorted(order, key=lambda i: (i % 5 != 2, i)), rng.sample(order, len(order))):
            got = o.apart(mixed, o.most_edits(n) + 1)
            assert len(got) == o.most_edits(n) + 1 and all(b - a >= o.SHINGLE for a, b in zip(sorted(got), sorted(got)[1:]))


def test_one_rare_shingle_survives_all_allowed_edits(spark):
    rng = random.Random(4)
    levels = np.frombuffer(rng.randbytes(o.COUNTERS[0]), dtype=np.uint8)
    pairs = []
    for _ in range(300):
        one = [rng.randrange(40) for _ in range(rng.randrange(9, 120))]
        other = list(one)
        for _ in range(o.most_edits(len(one))):
            at, way = rng.randrange(len(other)), rng.randrange(3)
            other[at : at + (way < 2)] = [rng.randrange(40)] * (way != 1)
        pairs.append((np.array(one, np.int32).tobytes(), np.array(other, np.int32).tobytes()))
    rows = spark.createDataFrame(pairs, "a binary, b binary").select("a", "b", o.rare_shingles(spark, F.col("a"), levels).alias("s")).collect()
    assert len(rows) == 300
    for r in rows:
        assert set(r.s) & set(o.shingles(bytes(r.b)).tolist())
        assert len(r.s) <= o.most_edits(len(r.a) // 4) + 1  # a third of the rows that the rarest 3d + 1 of all would be


def test_all_held_shingles_are_kept(spark):
    words = np.arange(100, dtype=np.int32)
    own = o.shingles(words.tobytes())
    wanted = own[::7]
    bitmap = np.zeros(o.BITS * o.COUNTERS[0] // 64, dtype=np.int64)
    for s in wanted.tolist():
        bit = s & (64 * len(bitmap) - 1)
        bitmap[bit >> 6] |= np.int64(np.uint64(1 << (bit & 63)).view(np.int64))
    rows = spark.createDataFrame([(words.tobytes(),), (words[:8].tobytes(),), (b"",)], "w binary").select(o.held_shingles(spark, F.col("w"), bitmap).alias("s")).collect()
    assert set(wanted.tolist()) <= set(rows[0].s) and len(rows[0].s) < len(own) / 2 and rows[1].s == rows[2].s == []
