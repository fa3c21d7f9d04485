"""Column functions on text: comparison keys, tokens, references, redaction. Built-in expressions but for one."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space, spelt out so that every engine's regex means the same.
BLANK = r"[ \t\n\f\r\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"


def metric_key(text: Column) -> Column:
    """All white space deleted, lower case; null stays null."""
    return F.lower(F.regexp_replace(text, BLANK + "+", ""))


def trimmed(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


@F.pandas_udf(T.StringType())
def comparison_key(texts: pd.Series) -> pd.Series:
    """NFKC, stripped, full case folding, white space collapsed; computed once per distinct value of a batch."""
    codes, distinct = pd.factorize(texts)
    keys = [" ".join(unicodedata.normalize("NFKC", t).strip().casefold().split()) for t in distinct] + [None]
    return pd.Series([keys[c] for c in codes], index=texts.index, dtype=object)


def filled(text: Column) -> Column:
    """``text``, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def lexical_tokens(text: Column) -> Column:
    """Bigrams of each run of Chinese characters, then runs of Latin letters and digits, white space deleted first.

    A multiset: repeated tokens stay. A Chinese run of one character has no bigram; null gives null.
    """
    key = metric_key(text)
    return F.concat(F.regexp_extract_all(key, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), F.lit(1)), F.regexp_extract_all(key, F.lit(r"([a-z0-9]+)"), F.lit(1)))


def sentences(text: Column) -> Column:
    """The sentences of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"[。！？；\n]+"), trimmed), lambda s: s != "")


# Fixed values below: the patterns of case names and of ids in brackets.
def case_label(text: Column) -> Column:
    """``EXT-n`` for the first ``ext-n`` of a text in any letter case, or null."""
    number = F.regexp_extract(F.lower(text), r"ext-(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("EXT-"), number))


def bracketed_ids(text: Column) -> Column:
    """The distinct ids that a text names in brackets, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_.:-]+)\]"), F.lit(1))))


def given_ids(text: Column) -> Column:
    """The distinct ids in brackets at the start of a line, sorted: the evidence that a prompt gives."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\[([A-Za-z0-9_.:-]+)\]"), F.lit(1))))


def redacted(text: Column, pattern: str, label: str) -> Column:
    """``text`` with every match of ``pattern`` replaced by ``label``."""
    return F.regexp_replace(text, pattern, label)


def safe_name(text: Column) -> Column:
    """Letters and digits of any script, hyphen and underscore kept, anything else a hyphen."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "-")


def run_name(experiment: Column, sample_id: Column, record: Column) -> Column:
    """A stable name of a run, fit for a file: experiment and sample, or, without a sample_id, 12 digits of the hash of the
    record (canonical JSON)."""
    named = F.coalesce(trimmed(sample_id), F.lit("")) != ""
    return F.concat(experiment, F.lit("--"), F.when(named, safe_name(sample_id)).otherwise(F.concat(F.lit("unlabeled-"), F.substring(F.sha2(record, 256), 1, 12))))


def edge_id(subject: Column, predicate: Column, target: Column) -> Column:
    """A stable id of a triple: 12 hexadecimal digits of its SHA-256."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("|", blank(subject), blank(predicate), blank(target)), 256), 1, 12))


# Spellings of the roles of a message.
ASKING = ("user", "human", "prompter", "question", "customer")
ANSWERING = ("assistant", "model", "bot", "gpt", "answer", "ai")


def role(spelt: Column) -> Column:
    """``user``, ``assistant`` or whatever else a message's role means: letter case and white space don't count; null stays
    null."""
    plain = metric_key(F.regexp_replace(spelt, r"[\x{200b}\x{feff}]", ""))
    return F.when(plain.isin(*ASKING), "user").when(plain.isin(*ANSWERING), "assistant").otherwise(plain)


def message_content(messages: Column, wanted: str) -> Column:
    """The content of the first message of a role (in any of its spellings), or null."""
    return F.try_element_at(F.filter(messages, lambda m: role(m["role"]) == wanted), F.lit(1))["content"]


def question_answers(messages: Column) -> Column:
    """array<struct<pos, asked, answer>>: every user message (0-based place) with the answer directly behind it, if there is
    one."""
    n = F.size(messages)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(messages, i)
    asked = F.filter(places, lambda i: role(at(i)["role"]) == "user")
    return F.transform(asked, lambda i: F.struct(i.cast("bigint").alias("pos"), at(i)["content"].alias("asked"), F.when(role(at(i + 1)["role"]) == "assistant", at(i + 1)["content"]).alias("answer")))
