"""What JSON texts of any depth hold: one small walker that runs inside Arrow batches, once per distinct text."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The keys whose texts are statements, and the pattern of keys to an interface with what replaces them.
STATEMENT_KEYS = ("statement", "content", "evidence_summary")
API_KEY, REDACTED = r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED_API_KEY]"

_STRINGS = T.ArrayType(T.StringType())
HELD = T.StructType(
    [T.StructField("valid", T.BooleanType()), T.StructField("keys", _STRINGS), T.StructField("evidence", _STRINGS), T.StructField("statements", _STRINGS), T.StructField("entities", _STRINGS)]
    + [T.StructField("claims", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object")])))]
)


def _loaded(text: str) -> object:
    """The value of a JSON text, or None where it is none (too deep a nesting counts as none)."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _dicts(value: object) -> list[dict]:
    """All objects in a value, at any depth."""
    found, waiting = [], [value]
    while waiting:
        v = waiting.pop()
        if isinstance(v, dict):
            found.append(v)
            waiting += v.values()
        elif isinstance(v, list):
            waiting += v
    return found


def held(text: str) -> tuple:
    """The fields of HELD; all lists are empty where the text is no JSON object."""
    top = _loaded(text)
    if not isinstance(top, dict):
        return False, [], [], [], [], []
    every = _dicts(top)
    evidence = {i for d in every if isinstance(ids := d.get("evidence_ids"), list) for i in ids if isinstance(i, str)}
    statements = {d[k] for d in every for k in STATEMENT_KEYS if isinstance(d.get(k), str) and d[k].strip()}
    listed = lambda k: [x for x in top.get(k) or [] if isinstance(x, dict)] if isinstance(top.get(k), list) else []
    entities = {str(x["name"]) for x in listed("entities") if x.get("name")}
    parts = ("subject", "predicate", "object")
    claims = {tuple(str(x[k]) for k in parts) for x in listed("claims") if all(x.get(k) for k in parts)}
    return True, sorted(top), sorted(evidence), sorted(statements), sorted(entities), [dict(zip(parts, c)) for c in sorted(claims)]


def _by_value(texts: pd.Series, look: Callable[[str], object], none: object) -> list:
    codes, distinct = pd.factorize(texts)
    found = [*map(look, distinct), none]
    return [found[c] for c in codes]


@F.pandas_udf(HELD)
def json_held(texts: pd.Series) -> pd.DataFrame:
    """struct HELD of each text: whether it is a JSON object, its keys, the evidence_ids and statements at any depth, the names
    of its entities and the ends of its claims. A null is not valid and holds nothing."""
    return pd.DataFrame(_by_value(texts, held, (False, [], [], [], [], [])), columns=HELD.names)


def first_object(text: str, wanted: tuple[str, ...], every: bool) -> str | None:
    """The first JSON object inside a text that has all (or any) of the keys."""
    read = json.JSONDecoder().raw_decode
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = read(text, at)
        except (ValueError, RecursionError):
            value = None
        if isinstance(value, dict) and (all if every else any)(k in value for k in wanted):
            return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        at = text.find("{", at + 1)
    return None


def json_in_prose(text: Column, wanted: tuple[str, ...], every: bool = True) -> Column:
    """first_object() of each text, in canonical form; null where there is none."""

    @F.pandas_udf(T.StringType())
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series(_by_value(texts, lambda t: first_object(t, wanted, every), None), index=texts.index, dtype=object)

    return find(text)


def canonical(text: str) -> str | None:
    value = _loaded(text)
    return None if value is None and text.strip() != "null" else json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The text with its keys sorted and without blanks, null where it is no JSON."""
    return pd.Series(_by_value(texts, canonical, None), index=texts.index, dtype=object)


@F.pandas_udf(T.StringType())
def json_fingerprint(texts: pd.Series) -> pd.Series:
    """The SHA-256 of the canonical form, null where the text is no JSON."""
    digest = lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest()
    return pd.Series(_by_value(texts, digest, None), index=texts.index, dtype=object)


def without_keys(value: object) -> object:
    """The value with every key to an interface in its texts replaced; names of fields stay."""
    if isinstance(value, str):
        return re.sub(API_KEY, REDACTED, value)
    if isinstance(value, list):
        return [without_keys(v) for v in value]
    return {k: without_keys(v) for k, v in value.items()} if isinstance(value, dict) else value


@F.pandas_udf(T.StringType())
def json_redacted(texts: pd.Series) -> pd.Series:
    """JSON without keys to an interface at any depth; a text that is no JSON is redacted as it stands."""

    def clean(text: str) -> str:
        value = _loaded(text)
        return re.sub(API_KEY, REDACTED, text) if value is None else json.dumps(without_keys(value), ensure_ascii=False)

    return pd.Series(_by_value(texts, clean, None), index=texts.index, dtype=object)


def response_text(direct: Column, parts: Column) -> Column:
    """The text of a response: the direct one, else the first ``output_text`` of its messages; trimmed, null if there is none.

    ``parts``: array<struct<type, content: array<struct<type, text>>>>.
    """
    texts = F.flatten(F.transform(F.filter(parts, lambda m: m["type"] == "message"), lambda m: F.filter(m["content"], lambda c: (c["type"] == "output_text") & c["text"].isNotNull())))
    return F.coalesce(F.nullif(F.trim(direct), F.lit("")), F.trim(F.get(texts, F.lit(0))["text"]))


def error_details(payload: Column) -> Column:
    """struct(type, code, message) of a payload's error object, each only where it is a text."""
    error = F.try_parse_json(payload)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(error, f"$.error.{k}", "variant")) == "STRING", F.try_variant_get(error, f"$.error.{k}", "string")).alias(k)
    return F.struct(text("type"), text("code"), text("message"))
