"""Encoding of the whole corpus with a public tokenizer.

The vocabulary (tiktoken rank file, its path a parameter) is written out as a sentencepiece BPE model on the driver:
each token's bytes become the printable characters of the byte-level alphabet, its score is its negative rank, the
normaliser is the identity. Each task gets the model's 1.3 MB by broadcast, splits whole texts into pre-tokens and
encodes each distinct pre-token once. Piece ids equal the ranks.

Defined results: an empty text and a null text both have the empty list; text that looks like a special token is
ordinary text; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import spread, table

VOCABULARY = os.environ.get("PLUMBLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# The pre-token pattern of the public 50k byte-level vocabulary.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens that a worker keeps; beyond it the memory starts anew. Bounds memory, changes no result.
KEPT = 100_000


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


@lru_cache(maxsize=4)
def serialised_model(path: str) -> bytes:
    """The sentencepiece model (a serialised protocol buffer) of the vocabulary at ``path``."""
    shown = byte_alphabet()
    tokens = sorted(read_ranks(path).items(), key=lambda x: x[1])
    if [rank for _, rank in tokens] != list(range(len(tokens))):
        raise ValueError("the ranks of the vocabulary must be 0, 1, 2, ...")
    pieces = b"".join(_field(1, _field(1, "".join(shown[b] for b in token).encode()) + _field(2, -float(rank))) for token, rank in tokens)
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return pieces + _field(2, trainer) + _field(3, normaliser)


class Encoder:
    """Encodes and decodes with a serialised model; one per worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(PRE_TOKEN).findall
        self.shown = byte_alphabet()
        self.bytes = {c: b for b, c in enumerate(self.shown)}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = list({p for parts in split for p in parts if p not in self.known})
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = list({p for parts in split for p in parts})
        if new:
            shown = self.shown
            mapped = ["".join([shown[b] for b in p.encode("utf-8", "surrogatepass")]) for p in new]
            self.known.update(zip(new, self.pieces.encode(mapped, num_threads=1)))
        known = self.known
        return [[i for p in parts for i in known[p]] for parts in split]

    def decode(self, ids: list[int]) -> str:
        letters = "".join(self.pieces.id_to_piece(list(map(int, ids)))) if len(ids) else ""
        return bytes(self.bytes[c] for c in letters).decode("utf-8", "replace")


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(serialised_model(path))


def token_ids(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The ids (array<int>) of ``text``."""
    model = _broadcast(spark, path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts.where(texts.notna(), None).tolist()), index=texts.index, dtype=object)

    return ids(text)


def token_counts(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The number of ids of ``text`` (bigint); only the number leaves the worker."""
    model = _broadcast(spark, path)

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model.value)
        for texts in batches:
            yield pd.Series([len(x) for x in encoder.encode(texts.where(texts.notna(), None).tolist())], index=texts.index, dtype="int64")

    return count(text)


def decoded(spark: SparkSession, ids: Column, path: str = VOCABULARY) -> Column:
    """The text of ``ids``, by the inverse mapping."""
    model = _broadcast(spark, path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(model.value)
        for lists in batches:
            yield pd.Series([None if x is None else encoder.decode(x) for x in lists], index=lists.index, dtype=object)

    return text(ids)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", token_ids(spark, F.col("text")).alias("ids"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, characters, tokens, and how many texts the ids don't give back (none should)."""
    documents = spread(table(spark, sf_dir, "documents").select("source", "text")).select("source", "text", token_ids(spark, F.col("text")).alias("ids"))
    back = documents.withColumn("back", decoded(spark, F.col("ids")))
    return back.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("characters"),
        F.sum(F.size("ids")).cast("bigint").alias("tokens"),
        F.count_if(F.col("back") != F.coalesce("text", F.lit(""))).alias("lost"),
    )
