"""Visually identical text with different characters.

Every text is brought to one form: compatibility normalisation in composed form, full case folding, white space
mapped to the plain blank, default-ignorable characters removed, and letters of another script put back into the
script of their word. Work is done once per distinct value of an Arrow batch.

Defined results: a null stays null and is never odd; an empty text stays empty; columns of the input keep their names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import spread, table

# The default-ignorable code points of the Unicode standard.
IGNORABLE_RANGES = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
# Blanks other than the plain one, tab and line ends.
BLANKS = "\u000b\u000c\u0085                 　"
# Signs with a compatibility form that are ordinary nevertheless (raised digits, ordinals, the ellipsis,
# Chinese punctuation).
ORDINARY = "²³¹⁰⁴⁵⁶⁷⁸⁹ªº…！（），：；？～￥"
# Letters of other scripts that look like Latin ones (the public list of confusable characters, as far as
# single letters go), and signs that look like the hyphen or the slash. Small Cyrillic letters that look like small capitals
# (STRONGER) and μ Ω β Δ, which are signs of their own, tell a script.
CYRILLIC = dict(zip("аеорсухѕіјԁһԛԝѵүԍҽАВЕЅЗКМНОРСТУХІЈԌԚԜѴҮ", "aeopcyxsijdhqwvygeABES3KMHOPCTYXIJGQWVY"))
STRONGER = dict(zip("вкмнт", "bkmht"))
GREEK = dict(zip("αγεηικνοπρστυχωϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ayenikvonpotuxwcjABEZHIKMNOPTYXCC"))
ARMENIAN = dict(zip("հսօոցզլյքւՕՍԼՏ", "huongqljpiOULS"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩᏒᏎᏔ", "ABCDEGHJKLMPRSTVWZYRWW"))
SIGNS = {"‐": "-", "‑": "-", "−": "-", "﹣": "-", "－": "-", "∕": "/", "∶": ":"}
# Single characters that stand for several letters, as far as the SQL skeleton splits them.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "℃": "°c", "Ⅱ": "ii", "Ⅲ": "iii", "㎐": "hz", "㎸": "kv", "㎾": "kw", "㎫": "mpa", "㎜": "mm", "ß": "ss"}


def _phonetic() -> dict[str, str]:
    """Latin letters of other blocks that look like plain ones, by rule from their names: small capitals, script and alpha."""
    found = {}
    for code in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA720, 0xA800), *range(0xAB30, 0xAB70)):
        name = unicodedata.name(chr(code), "")
        if match := re.fullmatch(r"LATIN LETTER SMALL CAPITAL ([A-Z])|LATIN SMALL LETTER SCRIPT ([A-Z])|LATIN SMALL LETTER (ALPHA)", name):
            found[chr(code)] = (match[1] or match[2] or "a").lower()
    return found


PHONETIC = _phonetic()
LOOKALIKE = {**CYRILLIC, **STRONGER, **GREEK, **ARMENIAN, **CHEROKEE, **PHONETIC}
#: The Latin letters that stand for Cyrillic ones inside a Cyrillic word.
TO_CYRILLIC = {v: k for k, v in {**STRONGER, **CYRILLIC}.items() if "А" <= k <= "я" and v.isalpha()}
#: Letters of the Russian alphabet; other Cyrillic lookalikes never make up a word of their own here.
RUSSIAN = frozenset(chr(c) for c in range(0x410, 0x450)) | {"ё", "Ё"}


def _class(chars: str | list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


@lru_cache(maxsize=1)
def compatibility() -> dict[str, str]:
    """Characters with another compatibility form, by rule from the Unicode data."""
    found = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if c not in ORDINARY and (form := unicodedata.normalize("NFKC", c)) != c:
            found[c] = form
    return found


@lru_cache(maxsize=1)
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    ignorable = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE_RANGES) + "]"
    listed = "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE_RANGES) + "".join(re.escape(c) for c in [*BLANKS, *compatibility(), *SIGNS])
    odd = re.compile(f"[{listed}]")
    marks = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]")
    letters = re.compile(_class(list(LOOKALIKE))[:-1] + "Ѐ-ԯ]")
    return odd, re.compile(ignorable), marks, letters


_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHERS = "Ͱ-ϿЀ-ԯԱ-֏ɐ-ʯᎠ-᏿ᴀ-ᵿꜰ-ꟿꬰ-ꭩ"
#: Texts of nothing but these need no look at single characters (no Cyrillic, Greek or Armenian lookalikes).
_PLAIN = re.compile(f"[\\x00-\\x7f一-龥À-ÖØ-öø-ÿ°·²³ΔΩβμ…。，：（）；、！？“”‘’]*")
_WORD = re.compile(f"[{_LATIN}{_OTHERS}0-9]+(?:-[{_LATIN}{_OTHERS}0-9]+)*")
_HAS_LATIN = re.compile(f"[{_LATIN}]")
_LETTERS_OF = {"cyrillic": re.compile("[Ѐ-ԯ]"), "strong": re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯёЁ]")}
#: Cyrillic and Latin letters that have no counterpart in the other script.
_ONLY_CYRILLIC, _ONLY_LATIN = re.compile("[бгджзийлпфцчшщъыьэюяБГДЖИЙЛПФЦЧШЩЪЫЬЭЮЯёЁ]"), re.compile(f"[{_LATIN}]")
_FOLD = str.maketrans(LOOKALIKE)
_BACK = str.maketrans(TO_CYRILLIC)


def _one_script(part: str, tagged: bool) -> str:
    """A word, or one between hyphens, in one script; what stands around it counts for nothing. ``tagged``: it holds a
    number or is tied to a Latin word or a number, as in equipment tags."""
    if _HAS_LATIN.search(part):
        if not _LETTERS_OF["cyrillic"].search(part):
            return part.translate(_FOLD)  # a Latin word with letters of other scripts
        native = len(_ONLY_CYRILLIC.findall(part))
        latin = sum(c not in TO_CYRILLIC for c in _ONLY_LATIN.findall(part))
        if native > latin or native == latin and _LETTERS_OF["strong"].search(part):
            return part.translate(_BACK)  # a Cyrillic word with Latin letters
        return part.translate(_FOLD)
    letters = [c for c in part if c.isalpha()]
    if letters and all(c in LOOKALIKE for c in letters):
        unheard = any(c not in RUSSIAN for c in letters) and any(c in CYRILLIC for c in letters)
        phonetic = all(c in PHONETIC for c in letters)
        if tagged and not any(c in STRONGER for c in letters) or unheard or phonetic:
            return part.translate(_FOLD)
    return part


def _same_script(text: str) -> tuple[str, bool]:
    """``text`` with each word in one script, and whether a word had letters of another one."""
    odd = False

    def mend(match: re.Match) -> str:
        nonlocal odd
        word = match[0]
        if not _HAS_LATIN.search(word) and not any(c in LOOKALIKE for c in word):
            return word
        parts = word.split("-")
        tagged = any(c.isdigit() for c in word) or len(parts) > 1 and bool(_HAS_LATIN.search(word))
        out = "-".join(_one_script(part, tagged) for part in parts)
        odd = odd or out != word
        return out

    return _WORD.sub(mend, text), odd


def _settled(form: str) -> str:
    """``form`` folded, composed and mended until nothing changes any more, so that a form is its own form."""
    _, ignorable, _, letters = _patterns()
    while True:
        new = unicodedata.normalize("NFKC", ignorable.sub("", form).translate(_SIGNS).casefold())
        if letters.search(new):
            new = _same_script(new)[0]
        if new == form:
            return new
        form = new


_SIGNS = str.maketrans(SIGNS)


def unify(text: str) -> tuple[str, bool]:
    """The one form of ``text``, and whether it held a character that only looks ordinary or isn't seen."""
    if text.isascii():
        return " ".join(text.casefold().split()), False
    if _PLAIN.fullmatch(text):
        form = text.casefold()
        return " ".join((form if unicodedata.is_normalized("NFKC", form) else unicodedata.normalize("NFKC", form)).split()), False
    odd_sign, ignorable, marks, letters = _patterns()
    odd = bool(odd_sign.search(text))
    form = text
    if odd:
        form = ignorable.sub("", unicodedata.normalize("NFKC", ignorable.sub("", form)))
        form = form.translate(_SIGNS)
    elif marks.search(text):
        form = unicodedata.normalize("NFC", text)
        odd = form != text
    if letters.search(form):
        form, strange = _same_script(form)
        odd = odd or strange
    return " ".join(_settled(form).split()), odd


FORM = T.StructType([T.StructField("form", T.StringType()), T.StructField("odd", T.BooleanType())])


@F.pandas_udf(FORM)
def char_form(values: pd.Series) -> pd.DataFrame:
    codes, distinct = pd.factorize(values)
    forms = [unify(v) for v in distinct]
    forms.append((None, False))  # code -1: null
    return pd.DataFrame({"form": [forms[c][0] for c in codes], "odd": [forms[c][1] for c in codes]})


def with_forms(frame: DataFrame, fields: list[str]) -> DataFrame:
    """``frame`` with a struct column ``<field>_form`` (form, odd) for each of ``fields``; one pass, no shuffle."""
    return frame.withColumns({f"{f}_form": char_form(F.col(f"`{f}`")) for f in fields})


def odd_values(frame: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """One row (tbl, row_id, field_name, value, form) per value that held an odd character."""
    formed = with_forms(frame.select(key, *fields), fields)
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value"), F.col(f"{f}_form").alias("f")) for f in fields])
    odd = formed.select(F.lit(name).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.explode(F.filter(each, lambda x: x["f"]["odd"])).alias("x"))
    return odd.select("tbl", "row_id", "x.field_name", "x.value", F.col("x.f.form").alias("form"))


def folded(column: Column) -> Column:
    """A SQL-only skeleton for comparisons: lower case, one-to-one compatibility forms and lookalikes folded, ignorable
    characters and accents removed. Letters that look alike in one case fold together in both."""
    source, target = _fold_table()
    for ligature, letters in LIGATURES.items():
        column = F.replace(column, F.lit(ligature), F.lit(letters))
    return F.lower(F.translate(column, source, target))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """The two strings for translate; what the first has beyond the second is removed."""
    wide = lambda c: len(c.encode("utf-16-le")) > 2
    pairs = {c: f for c, f in compatibility().items() if len(f) == 1 and not wide(c) and not wide(f)}
    for code in range(0xC0, 0x250):  # accented Latin letters to their base
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            pairs[chr(code)] = base
    pairs |= {c: " " for c in BLANKS}
    pairs |= SIGNS | LOOKALIKE
    pairs |= {c.lower(): latin.lower() for c, latin in LOOKALIKE.items() if c.isupper() and c.lower() not in LOOKALIKE}
    pairs |= {c: unicodedata.normalize("NFKC", c) for c in "！（），：；？～￥"}
    removed = [chr(c) for a, b in (*IGNORABLE_RANGES, (0x300, 0x36F)) if b < 0x10000 for c in range(a, b + 1)]
    pairs = {c: f for c, f in pairs.items() if c not in removed}
    return "".join([*pairs, *removed]), "".join(pairs.values())


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = odd_values(spread(table(spark, sf_dir, "graph_claims").select("claim_row", "subject", "object")), "claim_row", ["subject", "object"], "graph_claims")
    return claims.unionByName(odd_values(spread(table(spark, sf_dir, "evidence_refs").select("evidence_row", "excerpt")), "evidence_row", ["excerpt"], "evidence_refs"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_values(spark, sf_dir).select("tbl", "row_id", "field_name")


def p1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name of subjects and objects in its one form, with how many claims hold it and in how many spellings: the spellings
    are counted first, and each is brought to its form once."""
    names = table(spark, sf_dir, "graph_claims").select(F.explode(F.array("subject", "object")).alias("value")).where("value is not null")
    spelt = names.groupBy("value").agg(F.count("*").alias("n")).withColumn("name", char_form("value")["form"])
    return spelt.groupBy("name").agg(F.sum("n").alias("claims"), F.count("*").alias("spellings"))
