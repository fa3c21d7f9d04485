"""Sampling and encoding preparation."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(frame: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows when the groups, sorted, are asked in turn for their next row; column turn from 1 on.

    No group can give more than n rows, which the window's group limit drops before the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return frame.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def common_prefix(a: Column, b: Column) -> Column:
    """How many tokens two lists have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("bigint"))


def budgeted(frame: DataFrame, prompt: str, answer: str, budget: int, mask: str) -> DataFrame:
    """``frame`` with the lists prompt, words and labels and the number cut: the answer is kept whole, of the prompt as many last
    words as fit; ``labels`` are the words with the prompt's replaced by ``mask``. Rows without an answer, or for whose
    prompt a long answer leaves no word, are left out."""
    n, m = F.size(prompt), F.size(answer)
    rows = frame.where((m > 0) & ((n + m <= budget) | (m < budget))).withColumn("cut", F.greatest(n + m - budget, F.lit(0)))
    rows = rows.withColumn("prompt", F.slice(prompt, F.col("cut") + 1, F.greatest(n - F.col("cut"), F.lit(0))))
    return rows.withColumns({"words": F.concat("prompt", answer), "labels": F.concat(F.transform("prompt", lambda _: F.lit(mask)), F.col(answer))})


def padded(frame: DataFrame, batch: str, words: str, pad: str) -> DataFrame:
    """``frame`` with ``words`` filled up to the longest list of its batch, and the list attention of ones and zeros."""
    width = F.max(F.size(words)).over(Window.partitionBy(batch))  # a batch is small by design
    wide = frame.withColumn("_missing", width - F.size(words))
    ones = F.transform(F.col(words), lambda _: F.lit(1))
    return wide.withColumns({"attention": F.concat(ones, F.array_repeat(F.lit(0), F.col("_missing"))), words: F.concat(F.col(words), F.array_repeat(F.lit(pad), F.col("_missing")))}).drop("_missing")


def literal_table(rows: list[dict], fields: str) -> Column:
    """A constant array of structs; one literal, whatever the number of rows."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{', '.join(f.strip().replace(' ', ':') for f in fields.split(','))}>>")


def weighted_draws(frame: DataFrame, key: str, weights: DataFrame, name: str, weight: str, seed: int = 17) -> DataFrame:
    """``frame`` with a column drawn from ``weights`` with replacement; weights that aren't positive are never drawn.

    The weights, one row a source, become one array of their running shares; a row takes the first that lies above its draw.
    The draw is a hash of the key, so it is the same whatever the partitioning.
    """
    rows = [(r[name], float(r[weight])) for r in weights.where(F.col(weight) > 0).orderBy(name).collect()]
    if not rows:
        return frame.withColumn(name, F.lit(None).cast("string"))
    total = sum(w for _, w in rows)
    shares = [min(1.0, s / total) for s in accumulate(w for _, w in rows)]
    shares[-1] = 1.0
    table = literal_table([{"share": s, "name": source} for (source, _), s in zip(rows, shares)], "share double, name string")
    at = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return frame.withColumn(name, F.filter(table, lambda t: t["share"] > at)[0]["name"])
