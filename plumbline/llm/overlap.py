"""Same or near-same records across splits.

Records are canonicalised (user and assistant words only, character forms, letter case, blanks and punctuation left
out; Chinese counts by characters) and hashed. Evaluation hashes are joined with training hashes; records with equal
hashes form one class, so copies cost nothing further. Between classes with different hashes an exact prefix filter
finds every pair of texts that differ in at most a tenth of their words: of n words at most d can differ, and a word that
is replaced, added or left out breaks at most one of several triples of neighbouring words that have no word in common, so of
d+1 such triples of the evaluation text one stands unbroken in the training text. The rarest are taken. Rarity comes from hashed
counters over the whole table, as many as the corpus asks for; any order is right, a good one keeps candidate lists short.
Of the training texts all triples count, but only those are joined that a bitmap says may be asked for, and a joined pair
must pass two exact bounds inside the join (length, and the parities of hashed word counts, of which a changed word
flips two) before it leaves it. What is left is verified by word-wise edit distance.

Defined results: records without any word (null or empty messages, null contents) and records outside train,
validation and test have no partner; a record is never paired within its own split side; repeated rows are pairs like
any other; record_a < record_b.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import role
from plumbline.llm.charforms import unify
from plumbline.session import cut, spread, table

#: Words of a shingle; a changed word touches as many of them.
SHINGLE = 3
#: Fewest and most hashed counters of shingles (a byte each in the end); in between there is one for every eight words.
COUNTERS = (1 << 20, 1 << 26)
#: Counters of a block, which one task sums.
BLOCK = 1 << 12
#: Bits of the bitmap of evaluation shingles for each counter.
BITS = 8
#: Longs of the parity sketch; further ones of texts with at least so many words, whose first sketch is full.
SKETCH, LONG_SKETCH, LONG = 3, 4, 250
#: Candidate classes up to which their ids are broadcast; beyond that they meet the texts by an ordinary join.
BROADCAST_ROWS = 500_000
#: At most this part of the words of the longer text may differ.
TOLERANCE = 0.1
WORDS = re.compile(r"[\u3400-\u9fff]|[^\W_\u3400-\u9fff]+")
#: Distinct words whose hashes a worker keeps; bounds memory, changes no result.
KEPT = 300_000


def counted_text(messages: Column) -> Column:
    """The contents of the user and assistant messages, in order."""
    kept = F.filter(messages, lambda m: role(m["role"]).isin("user", "assistant") & m["content"].isNotNull())
    return F.array_join(F.transform(kept, lambda m: m["content"]), "\n")


def sketch(words: np.ndarray, longs: int, salt: int) -> np.ndarray:
    """``longs`` longs: the parity of the number of words in each of their bits."""
    bits = np.bincount((words.astype(np.int64) * salt >> 16 & 0xFFFFFF) % (64 * longs), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


SKETCHES = [*(f"s{i}" for i in range(SKETCH)), *(f"e{i}" for i in range(LONG_SKETCH))]
HASHES = T.StructType(
    [T.StructField("class", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.BinaryType())]
)
SKETCHED = T.StructType([T.StructField(c, T.LongType()) for c in SKETCHES])


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = zlib.crc32(word.encode("utf-8", "replace")) - (1 << 31)
        return h


@F.pandas_udf(HASHES)
def text_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known = _WordHashes()
    for texts in batches:
        classes, sizes, words = [], [], []
        for text in texts:
            found = WORDS.findall(text.casefold() if text.isascii() else unify(text)[0]) if text else []
            if len(known) > KEPT:
                known.clear()
            array = np.fromiter(map(known.__getitem__, found), dtype=np.int32, count=len(found))
            classes.append(hashlib.md5(" ".join(found).encode("utf-8", "replace")).digest())
            sizes.append(len(found))
            words.append(array.tobytes())
        yield pd.DataFrame({"class": classes, "n": np.array(sizes, dtype=np.int32), "words": words})


@F.pandas_udf(SKETCHED)
def text_sketches(words: pd.Series) -> pd.DataFrame:
    """The parity sketches of texts given by the hashes of their words."""
    none, rows = np.zeros(LONG_SKETCH, dtype=np.int64), []
    for w in words:
        array = np.frombuffer(w, dtype=np.int32)
        rows.append(np.concatenate([sketch(array, SKETCH, 0x9E3779B1), sketch(array, LONG_SKETCH, 0x85EBCA77) if len(array) >= LONG else none]))
    return pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(SKETCHES)), columns=SKETCHES)


def hashed_records(records: DataFrame) -> DataFrame:
    """(record_id, split, source_name, train, class, n, words): the class is the hash of all words, ``words``
    holds their 32-bit hashes in order."""
    split = F.lower(F.trim(F.col("metadata.split")))
    rows = records.where(split.isin("train", "validation", "test")).select(F.col("record_id").cast("bigint").alias("record_id"), split.alias("split"), F.col("metadata.source_name").alias("source_name"), text_hashes(counted_text(F.col("messages"))).alias("h"))
    rows = cut(rows).where("h.n > 0")
    return rows.select("record_id", "split", "source_name", (F.col("split") == "train").alias("train"), "h.*")


def placed_shingles(words: bytes) -> np.ndarray:
    """The 32-bit hashes of the runs of SHINGLE words, in their order."""
    w = np.frombuffer(words, dtype=np.int32).astype(np.int64)
    mixed = np.zeros(max(0, len(w) - SHINGLE + 1), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            mixed = (mixed + w[i : i + len(mixed)]) * 0x1E3779B97F4A7C15
            mixed ^= mixed >> 29
    return (mixed >> 16).astype(np.int32)


def shingles(words: bytes) -> np.ndarray:
    """The distinct hashes of placed_shingles()."""
    return np.unique(placed_shingles(words))


def most_edits(length: int) -> int:
    """The most words in which a text of ``length`` words can differ from one that is at most a tenth longer."""
    return int(length * TOLERANCE / (1 - TOLERANCE) + 1e-9)


def counter_number(words: int) -> int:
    """The number of counters for a corpus of so many words, a power of two."""
    return min(max(1 << max(0, words // 8 - 1).bit_length(), COUNTERS[0]), COUNTERS[1])


def _counted(size: int):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A partition's counters that aren't zero, by block: their places and how often they were met."""
        counts = np.zeros(size, dtype=np.int32)
        for batch in batches:
            if len(batch):
                np.add.at(counts, np.concatenate([shingles(w) for w in batch["words"]]) & (size - 1), np.int32(1))
        for start in range(0, size, BLOCK):
            part = counts[start : start + BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                met = part[at]
                yield pd.DataFrame({"block": [start // BLOCK], "at": [at.astype(np.uint16).tobytes()], "met": [met.astype(np.uint8 if met.max() < 256 else np.int32).tobytes()]})

    return counted


def _levels(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of one block (a row a partition) on a logarithmic scale that fits a byte."""
    total = np.zeros(BLOCK, dtype=np.int64)
    for at, met in zip(rows["at"], rows["met"]):
        places = np.frombuffer(at, dtype=np.uint16)
        total[places] += np.frombuffer(met, dtype=np.uint8 if len(met) == len(places) else np.int32)
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "levels": [np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8).tobytes()]})


def shingle_levels(hashed: DataFrame, size: int) -> np.ndarray:
    """How many records hold a shingle of each of ``size`` counters, as eighths of a power of two; one byte each, gathered
    block by block."""
    blocks = hashed.select("words").mapInPandas(_counted(size), "block int, at binary, met binary").groupBy("block").applyInPandas(_levels, "block int, levels binary")
    out = np.zeros(size, dtype=np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out


def shingle_bitmap(prefixes: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits in longs: those of the hashed shingles of ``prefixes``."""
    bit = F.col("shingle").bitwiseAND(bits - 1)
    words = prefixes.select(F.explode("shingles").alias("shingle")).groupBy(F.shiftright(bit, 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, shingle & 63)")).alias("v"))
    rows = words.groupBy(F.shiftright("i", 12).alias("row")).agg(F.collect_list("i").alias("i"), F.collect_list("v").alias("v"))  # at most 4096 longs a row
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in rows.toLocalIterator():
        out[row["i"]] = row["v"]
    return out


def apart(order: list[int], most: int) -> list[int]:
    """The first ``most`` places of ``order`` whose shingles have no word in common with those of earlier ones."""
    taken, out = bytearray(len(order) + 2 * SHINGLE), []
    for place in order:
        if not taken[place + SHINGLE]:
            taken[place + 1 : place + 2 * SHINGLE] = b"\1" * (2 * SHINGLE - 1)
            out.append(place)
            if len(out) == most:
                break
    return out


def rare_shingles(spark: SparkSession, words: Column, levels: np.ndarray) -> Column:
    """Of each text one shingle more than words may differ, no two with a word in common, the rarest first; none where nothing
    may differ. Taking one forbids at most four others, so a text of n words, n > 8, always has the n / 9 + 1 of them."""
    shared = spark.sparkContext.broadcast(levels)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def rarest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        levels = shared.value
        for lists in batches:
            out = []
            for w in lists:
                d = most_edits(len(w) // 4)
                own = placed_shingles(w) if d else np.empty(0, np.int32)
                if len(own):
                    order = np.argsort(levels[own & (len(levels) - 1)].astype(np.int64) << 32 | own.view(np.uint32), kind="stable")
                    own = np.unique(own[apart(order.tolist(), d + 1)])
                out.append(own)
            yield pd.Series(out, index=lists.index)

    return rarest(words)


def held_shingles(spark: SparkSession, words: Column, bitmap: np.ndarray) -> Column:
    """All shingles of each text that the bitmap holds; none where nothing may differ."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = shared.value
        for lists in batches:
            out = []
            for w in lists:
                own = placed_shingles(w) if most_edits(len(w) // 4) else np.empty(0, np.int32)
                bit = own & (64 * len(bitmap) - 1)
                out.append(np.unique(own[bitmap[bit >> 6] >> (bit & 63) & 1 == 1]))
            yield pd.Series(out, index=lists.index)

    return held(words)


def few_edits(a: list[int], b: list[int], most: int) -> bool:
    """Whether at most ``most`` words must be replaced, added or left out to turn ``a`` into ``b``."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, hi = 0, 0
    end = min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return True
    far = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (j > 0 and b[j - 1] != x) if j else far)
            if best <= most:
                new[j] = best
        if not new:
            return False
        row = new
    return row.get(len(b), far) <= most


@F.pandas_udf(T.BooleanType())
def near_same(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(left, right):
        a, b = np.frombuffer(a, dtype=np.int32).tolist(), np.frombuffer(b, dtype=np.int32).tolist()
        longer = max(len(a), len(b))
        most = int(longer * TOLERANCE + 1e-9)
        common = sum((Counter(a) & Counter(b)).values())
        out.append(longer - common <= most and few_edits(a, b, most))
    return pd.Series(out, index=left.index)


def near_classes(spark: SparkSession, hashed: DataFrame) -> DataFrame:
    """(train_class, other_class): classes of different hash that are near-same, one of each side."""
    size = counter_number(hashed.agg(F.sum("n")).first()[0] or 0)
    levels = shingle_levels(hashed, size)
    held = ["n", *SKETCHES, "shingles"]

    def prefixes(rows: DataFrame, words: Column) -> DataFrame:
        """One row (id, n, sketches, shingles) a class, copies gone."""
        return rows.select("class", "n", words.alias("shingles"), text_sketches("words").alias("k")).select("class", "n", "shingles", "k.*").groupBy("class").agg(F.any_value(F.struct(*held)).alias("h")).select(F.xxhash64("class").alias("id"), "h.*")

    theirs = cut(prefixes(hashed.where("not train"), rare_shingles(spark, F.col("words"), levels)))
    ours = prefixes(hashed.where("train"), held_shingles(spark, F.col("words"), shingle_bitmap(theirs, BITS * size)))
    theirs = theirs.select("id", "n", *SKETCHES, F.explode("shingles").alias("shingle"))
    ours = ours.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "n", *SKETCHES)), F.explode("shingles").alias("shingle"))
    longer, shorter = F.greatest("n", "a_n"), F.least("n", "a_n")
    most = F.floor(longer * TOLERANCE + 1e-9)
    flipped = lambda names: reduce(Column.__add__, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"a_{c}"))) for c in names])
    bounds = (longer - shorter <= most) & (flipped(SKETCHES[:SKETCH]) <= 2 * most) & ((shorter < LONG) | (flipped(SKETCHES[SKETCH:]) <= 2 * most))
    pairs = cut(ours.join(theirs, "shingle").where(bounds & (F.col("id") != F.col("a_id"))).select("a_id", "id").distinct())

    ids = pairs.select(F.explode(F.array("a_id", "id")).alias("id")).distinct()
    # 8 bytes a row: sent to all tasks if they are few, so that the words of all other texts stay where they are
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = hashed.select(F.xxhash64("class").alias("id"), "class", "train", "words").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    texts = met.groupBy("id", "class", "train").agg(F.any_value("words").alias("words"))
    a = texts.where("train").select(F.col("id").alias("a_id"), F.col("class").alias("train_class"), F.col("words").alias("a"))
    b = texts.where("not train").select("id", F.col("class").alias("other_class"), F.col("words").alias("b"))
    return pairs.join(a, "a_id").join(b, "id").where(near_same("a", "b")).select("train_class", "other_class")


def near_links(spark: SparkSession, hashed: DataFrame) -> DataFrame:
    return cut(near_classes(spark, hashed))


def overlaps(spark: SparkSession, records: DataFrame) -> DataFrame:
    """(train_id, other_id, exact): all same or near-same pairs across the sides."""
    hashed = hashed_records(records)
    ours = hashed.where("train").select(F.col("record_id").alias("train_id"), F.col("class").alias("train_class"))
    theirs = hashed.where("not train").select(F.col("record_id").alias("other_id"), F.col("class").alias("other_class"))
    exact = ours.join(theirs, F.col("train_class") == F.col("other_class")).select("train_id", "other_id", F.lit(True).alias("exact"))
    near = near_links(spark, hashed).join(theirs, "other_class").join(ours, "train_class").select("train_id", "other_id", F.lit(False).alias("exact"))
    return exact.unionByName(near)


def overlap_counts(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, those with a same or near-same training record, those with a same one, and
    the pairs. Counted per class: no pair of records is formed, however many copies a class has."""
    hashed = hashed_records(records)
    train = hashed.where("train").groupBy("class").agg(F.count("*").alias("copies"))
    near = near_links(spark, hashed).join(train, F.col("train_class") == F.col("class")).groupBy(F.col("other_class").alias("class")).agg(F.sum("copies").alias("near_copies"))
    held = hashed.where("not train").groupBy("split", "source_name", "class").agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    met = held.join(train, "class", "left").join(near, "class", "left").withColumn("same", zero(F.col("copies"))).withColumn("all", zero(F.col("copies")) + zero(F.col("near_copies")))
    split = F.lower(F.trim(F.col("metadata.split")))
    every = records.where(split.isin("validation", "test")).groupBy(split.alias("split"), F.col("metadata.source_name").alias("source_name")).agg(F.count("*").alias("records"))
    found = met.groupBy("split", "source_name").agg(F.sum(F.when(F.col("all") > 0, F.col("n"))).alias("overlapping"), F.sum(F.when(F.col("same") > 0, F.col("n"))).alias("exact"), F.sum(F.col("n") * F.col("all")).alias("pairs"))
    joined = every.join(found, every["split"].eqNullSafe(found["split"]) & every["source_name"].eqNullSafe(found["source_name"]), "left")
    return joined.select(every["split"], every["source_name"], "records", zero(F.col("overlapping")).alias("overlapping_records"), zero(F.col("exact")).alias("exact_records"), zero(F.col("pairs")).alias("pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlaps(spark, spread(table(spark, sf_dir, "chat_records")))
    return pairs.select(F.least("train_id", "other_id").alias("record_a"), F.greatest("train_id", "other_id").alias("record_b"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_counts(spark, spread(table(spark, sf_dir, "chat_records")))
