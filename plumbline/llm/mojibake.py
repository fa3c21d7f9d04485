"""Garbled text from wrong character encoding.

For every pair (right encoding, wrong decoder) the garbled sequences of an alphabet are computed beforehand and put
into one Aho-Corasick automaton; only matched spans are replaced, correct text beside them stays as it is. Damage
that has no fixed sequence is found by spans as well: runs whose bytes under a wrong decoder are valid under the right
one, strange signs inside words where both encodings have one byte a letter, and characters that only decoding errors
leave behind (replacement characters, C1 controls).

Defined results: null, empty and plain ASCII texts are never damaged; a sequence that a text only quotes (standing by
itself behind a verb of showing, or in quotation marks in a sentence on garbling) is none; a damaged text with a span
that can't be recovered keeps that span and is reported as not recovered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import spread, table

# Single-byte and double-byte decoders that UTF-8 bytes are wrongly read with.
WRONG_FOR_UTF8 = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866")
# Further single-byte decoders; what tells them apart from those above are their letters and signs, not Han.
FURTHER_FOR_UTF8 = ("iso8859-15", "cp1250", "iso8859-2", "cp1254", "cp858", "cp852", "cp1257", "mac_cyrillic", "iso8859-5")
WRONG_WIDE = ("gbk", "cp932", "big5", "cp949")
# Fixed values: (right, wrong) pairs in which each letter stays one character.
ONE_TO_ONE = (
    ("cp850", "cp1252"), ("cp850", "latin-1"), ("cp437", "cp1252"), ("cp437", "latin-1"), ("latin-1", "cp437"), ("cp1252", "cp437"), ("latin-1", "cp850"), ("latin-1", "mac_roman"), ("mac_roman", "cp1252"),
    ("mac_roman", "latin-1"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("latin-1", "cp866"), ("cp850", "cp1251"),
)
CYRILLIC_PAIRS = (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("cp1251", "mac_roman"), ("cp866", "cp437"))
WIDE_PAIRS = (("gbk", "latin-1"), ("gbk", "cp1252"), ("gbk", "cp437"), ("big5", "latin-1"), ("big5", "cp1252"), ("gbk", "mac_roman"), ("gbk", "cp1251"))
#: Letters that words of the corpus languages really hold; what a one-to-one pair must give to count.
ACCENTED = "äöüßÄÖÜéèêëàâîïôûùçœÉÈÊÀÂÎÔÛÇñóíáúÑÓÍÁÚ"
#: Signs that stand inside words or between a number and its unit rightly.
RIGHT_INSIDE = "·’‘'°²³µμΩ®™§–—…•№\xad​‌‍﻿ "


def _garbled(text: str, right: str, wrong: str) -> str | None:
    """What ``text`` looks like, written in ``right`` and read in ``wrong``; C1 bytes stay in Windows code pages."""
    try:
        data = text.encode(right)
    except UnicodeError:
        return None
    try:
        return data.decode(wrong)
    except UnicodeError:
        if wrong != "cp1252":
            return None
        return "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in data)


def _raw(text: str, wrong: str) -> bytes | None:
    """The bytes that ``text`` was read from with ``wrong``."""
    try:
        return text.encode(wrong)
    except UnicodeError:
        if wrong not in ("cp1252", "latin-1"):
            return None
        out = bytearray()
        for c in text:
            if ord(c) < 256 and (wrong == "latin-1" or ord(c) < 128 or ord(c) > 159 or ord(c) in (0x81, 0x8D, 0x8F, 0x90, 0x9D)):
                out.append(ord(c))
            else:
                try:
                    out += c.encode("cp1252")
                except UnicodeError:
                    return None
        return bytes(out)


def alphabet() -> list[str]:
    """The characters whose garbled forms are looked for, by rule."""
    points = [*range(0x80, 0x180), *range(0x391, 0x3CA), 0x401, 0x451, *range(0x410, 0x450), *range(0x2013, 0x2027), 0x20AC, 0x2122, 0x2116, 0x2212, 0x2264, 0x2265, 0x2103, 0xFEFF, *range(0x3001, 0x3012), *range(0xFF01, 0xFF20), *range(0x4E00, 0x9FA6)]
    return [chr(p) for p in points]


@lru_cache(maxsize=1)
def automaton():
    """Garbled sequence -> (its length, the characters meant under each wrong decoder, in the order of the decoders)."""
    import ahocorasick

    found: dict[str, list[tuple[str, str | None]]] = {}

    def add(sequence: str, wrong: str, meant: str | None) -> None:
        held = found.setdefault(sequence, [])
        if (wrong, meant) not in held:
            held.append((wrong, meant))

    letters = alphabet()
    for wrong in (*WRONG_FOR_UTF8, *FURTHER_FOR_UTF8):
        for c in letters if wrong in WRONG_FOR_UTF8 else (x for x in letters if x < "一"):
            g = _garbled(c, "utf-8", wrong)
            if g is None or len(g) < 2 or all("А" <= x <= "я" for x in g):  # plain Cyrillic letters prove nothing
                continue
            if wrong in FURTHER_FOR_UTF8 and _ordinary(g):
                continue
            add(g, wrong, c)
            twice = _garbled(g, "utf-8", wrong) if c < "一" and wrong in WRONG_FOR_UTF8 else None
            if twice:
                add(twice, wrong, c)
    # the typographic signs read with a double-byte decoder: their first two bytes make one rare character
    for wrong in WRONG_WIDE:
        for c in "–—‘’“”•…€™≤≥℃−":
            data = c.encode()
            try:
                rare = data[:2].decode(wrong)
            except UnicodeError:
                continue
            if len(rare) == 1 and rare not in found and not rare.isascii():
                add(rare, wrong, None)
    for c in [*map(chr, range(0xA1, 0x100)), *"ΩμΔβαπσ"]:  # two-byte UTF-8 as a pair of half-width kana
        try:
            kana = c.encode().decode("cp932")
        except UnicodeError:
            continue
        if len(kana) == 2:
            add(kana, "cp932", c)
    add("锟斤拷", "gbk", None)
    machine = ahocorasick.Automaton()
    for sequence, meant in found.items():
        machine.add_word(sequence, (len(sequence), tuple(meant)))
    machine.make_automaton()
    return machine


def _ordinary(sequence: str) -> bool:
    """Whether a sequence could stand in correct text: letters of one script alone, or a letter before closing punctuation."""
    return all("Ѐ" <= x <= "ӿ" or x in "«»–—“”„…№" for x in sequence) or all(x.isalpha() and x.islower() for x in sequence)


#: Letters and signs, besides ASCII, that correct texts are made of.
_EXPECTED = frozenset(ACCENTED + RIGHT_INSIDE + "ΩΔβαπσ¿¡«»„“”‚℃≤≥−→×÷±¼½¾£€¥§¶ªº¹⁰⁴⁵⁶⁷⁸⁹ŒÆæ，。：（）；、！？《》【】" + "".join(map(chr, (*range(0x410, 0x450), 0x401, 0x451))))


def _strangeness(c: str, before: str, behind: str) -> int:
    """How odd a character is between its neighbours: 0 for what words and sentences are made of."""
    if c.isupper() and before.islower():
        return 2
    if c < "⺀" and not c.isalnum() and "" < before < "⺀" and before.isalpha() and "" < behind < "⺀" and behind.isalpha() and c not in "’'·-–—\xad/\xa0 ":
        return 2
    return 0 if c in _EXPECTED or c in _common_han() else 1


def _chosen(text: str, hits: list[tuple[int, int, tuple]]) -> list[str | None]:
    """The character meant by each hit under the decoder that explains most of them with the least strange result; None
    where two decoders do so equally well with different results."""
    votes: dict[str, list[int]] = {}
    for s, n, meant in hits:
        for wrong, c in meant:
            if c is not None:
                v = votes.setdefault(wrong, [0, 0])
                v[0] += 1
                v[1] += _strangeness(c, text[s - 1 : s], text[s + n : s + n + 1])
    order = [*WRONG_FOR_UTF8, *FURTHER_FOR_UTF8, *WRONG_WIDE]
    ranked = sorted(votes, key=lambda w: (-votes[w][0], votes[w][1], order.index(w)))

    place = {w: i for i, w in enumerate(ranked)}

    def under(first: str) -> list[str | None]:
        rank = lambda x: -1 if x[0] == first else place[x[0]]
        return [min(((w, c) for w, c in meant if c is not None), key=rank, default=(None, None))[1] for _, _, meant in hits]

    if not ranked:
        return [None] * len(hits)
    best = under(ranked[0])
    others = [under(w) for w in ranked[1:] if votes[w] == votes[ranked[0]]]
    return [None if any(other[i] != c for other in others) else c for i, c in enumerate(best)]


@lru_cache(maxsize=1)
def _wide_symbols() -> dict[str, str]:
    """Double-byte characters that two-byte UTF-8 letters and signs turn into: 掳 for °, 渭 for μ, ..."""
    found = {}
    for wrong in ("gbk", "big5"):
        for c in [*map(chr, range(0xA1, 0x100)), *"ΩμΔβαπσ"]:
            try:
                g = c.encode().decode(wrong)
            except UnicodeError:
                continue
            if len(g) == 1:
                found.setdefault(g, c)
    return found


@lru_cache(maxsize=1)
def _one_to_one() -> dict[str, list[tuple[int, str]]]:
    """Strange character -> (pair, letter meant) for the pairs of one byte a letter."""
    found: dict[str, list[tuple[int, str]]] = {}
    for k, (right, wrong) in enumerate(ONE_TO_ONE):
        for c in ACCENTED:
            g = _garbled(c, right, wrong)
            if g and len(g) == 1 and g != c and g not in RIGHT_INSIDE and g not in ACCENTED and not g.isascii():
                found.setdefault(g, []).append((k, c))
    return found


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    strange = [g for g in _one_to_one() if not ("ß" <= g <= "ÿ" and g != "÷")]  # lower-case Latin letters are at home in words
    middle = "[" + "".join(map(re.escape, strange)) + "]"
    ending = "[" + "".join(re.escape(g) for g in strange if not g.isupper() and g not in "“”«»‘’™®…!?´¨¸") + "]"
    wide = "[" + "".join(map(re.escape, _wide_symbols())) + "]"
    return {
        "lost": re.compile("[�\x80-\x9f]"),
        # between lower-case letters of one word, after an apostrophe before letters, or at the end of a word
        "inside": re.compile(rf"(?<=[a-zß-öø-ÿ'’]){middle}+(?=[a-zß-öø-ÿ])|(?<=[a-zß-öø-ÿ]){ending}(?=[\s.,;:])"),
        "wide_sign": re.compile(rf"(?<![㐀-鿿가-힣]){wide}(?![㐀-鿿가-힣])"),
        "latin_run": re.compile(r"[\xa0-ÿŒœŠšŸŽžƒˆ˜–-•…‰‹›€™\x80-\x9f]{4,}"),
        "wide_run": re.compile(r"[^\x00-\x7f]{3,}"),
        "start": re.compile(r"(?<![\w'’])[š™](?=[a-zß-öø-ÿ]{2})"),
        "koi": re.compile(r"[а-яё][А-ЯЁ]{3,}"),
        "cyrillic_sign": re.compile(r"[а-яёА-ЯЁ][¬\xad®Ї¤¥¦§Ґ±Ј«»°¶№є\xa0-]*[¬®Ї¤¥¦§Ґ±Ј¶][¬\xad®Ї¤¥¦§Ґ±Ј«»°¶№є\xa0]*[а-яёА-ЯЁ\xa0]"),
        "box": re.compile("[─-▟][^\\s\x00-\x7f─-▟]|[^\\s\x00-\x7f─-▟][─-▟]|[A-Za-zÀ-ÿ][─-▟][A-Za-zÀ-ÿ]"),
        "greek_word": re.compile(r"(?<=[a-zß-öø-ÿ])[Α-Ωα-ω∩≡±≥≤⌠⌡÷≈√ⁿ∞](?=[a-z])"),
    }


# Verbs of showing before a quoted sequence, and words that make garbling the topic of a sentence.
_SHOWING = re.compile(r"(?:shows?|showed|showing|prints?|printed|displays?|displayed|sees?|saw|seen|appears?(?: as)?|rendered(?: as)?|reads?|reading|got|becomes?|turns? into|like|sequence|characters?|string|zeigt|zeigen|erscheint|steht|affiche|affichent|montre|muestra|muestran|aparece|показывает|видно|显示|显示为|出现)\s*[\"'“„«‘]?$", re.I)
_TOPIC = re.compile(r"乱码|mojibake|garbled|encoding|charset|code ?page|кодировк|кракозябр|Zeichensatz|Zeichensalat|encodage|codificación", re.I)


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the span is only the topic of its sentence: it stands by itself and the sentence speaks of showing it."""
    a, b = start, end
    while a > 0 and not text[a - 1].isspace() and text[a - 1] not in "“”\"'«»„‘（(：:，,":
        a -= 1
    while b < len(text) and not text[b].isspace() and text[b] not in "“”\"'«»’（)）：:，,;。.":
        b += 1
    if any(c.isascii() and c.isalnum() for c in text[a:b]):
        return False
    if _INSTEAD.match(text, b) and _SHOWING.search(text, _sentence_start(text, a), a):
        return True
    if text[a - 1 : a] not in _QUOTES:
        return False
    end = _SENTENCE_END.search(text, b)
    return bool(_TOPIC.search(text, _sentence_start(text, a), a) or _TOPIC.search(text, b, end.start() if end else len(text)))


_INSTEAD = re.compile(r"[\"'”»’“]?\s*(?:instead|for every|at the|in the|where|rather|statt|au lieu|en lugar|вместо|，|而)")
_QUOTES = frozenset("“\"'«„‘")
_SENTENCE_END = re.compile(r"[。\n]|\.\s")


def _sentence_start(text: str, at: int) -> int:
    return max(text.rfind("。", 0, at), text.rfind("\n", 0, at), text.rfind(". ", 0, at)) + 1


@lru_cache(maxsize=1)
def _common_han() -> frozenset[str]:
    """The first level of the national standard set, by rule."""
    return frozenset(bytes([r, c]).decode("gb2312", "ignore") for r in range(0xB0, 0xD8) for c in range(0xA1, 0xFF))


#: The most frequent letters of Russian, of which its words are mostly made.
_FREQUENT = frozenset("оеаинтсрвлкмдпуязыь")


def _russian(text: str) -> float:
    """How much a text of Cyrillic letters looks like Russian words: the share of frequent letters, halved for capitals alone."""
    words = re.findall(r"[^\W\d_]+", text)
    if not words or not all(re.fullmatch("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+", w) for w in words):
        return 0.0
    letters = "".join(words)
    share = sum(c in _FREQUENT for c in letters.lower()) / len(letters)
    return share if letters[-1].islower() else 0.5 * share


def _other(c: str, right: str, wrong: str) -> str | None:
    """The character that ``c`` was before it was read with ``wrong``, where both encodings have one byte for it."""
    data = _raw(c, wrong)
    try:
        meant = data.decode(right) if data else ""
    except UnicodeError:
        return None
    return meant if len(meant) == 1 else None


def _best(candidates: list[tuple[float, str]]) -> str | None:
    """The candidate with the highest score; "" where another one with a different text comes near it, None without any."""
    if not candidates:
        return None
    candidates.sort(key=lambda x: -x[0])
    score, text = candidates[0]
    return "" if any(t != text and t and s >= 0.9 * score for s, t in candidates[1:]) else text


def _decoded_run(run: str) -> str | None:
    """The original of a run of any characters that were UTF-8 bytes read with a double-byte decoder; "" if it is lost."""
    candidates = []
    for wrong in WRONG_WIDE:
        data = _raw(run, wrong)
        if data is None:
            continue
        text = data.decode("utf-8", "replace")
        lost = text.count("�")
        share = sum(c in _common_han() or "Ѐ" <= c <= "ӿ" for c in text) / len(text)
        if len(text) >= 2 and lost <= 0.12 * len(text) and share >= 0.5:
            candidates.append((share, text if not lost and _garbled(text, "utf-8", wrong) == run else ""))
    return _best(candidates)


def _decoded_latin(run: str) -> str | None:
    """The original of a run of Latin-1 characters that were bytes of a double-byte or Cyrillic encoding; "" if it is lost."""
    if data := _raw(run, "cp1252"):
        lost = (text := data.decode("utf-8", "replace")).count("�")
        if not lost or lost <= 0.2 * len(data) / 2:
            return None  # UTF-8, whole or broken: the automaton's
    candidates = []
    for right, wrong in WIDE_PAIRS:
        data = _raw(run, wrong)
        if data is None:
            continue
        for part in (data, data[:-1], data[1:]):
            try:
                text = part.decode(right)
            except UnicodeError:
                continue
            share = sum(c in _common_han() for c in text) / max(1, len(text))
            if share >= 0.6 and len(text) >= 2:
                candidates.append((share, text if part is data else ""))
                break
    for right, wrong in CYRILLIC_PAIRS:
        data = _raw(run, wrong)
        try:
            text = data.decode(right) if data else ""
        except UnicodeError:
            continue
        if len(text) >= 4 and re.fullmatch("[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+", text) and _russian(text) >= 0.35:
            candidates.append((_russian(text), text))
    return _best(candidates)


def damage(text: str, depth: int = 3) -> tuple[bool, str | None]:
    """Whether ``text`` shows a wrong decoding, and the original if all of its damaged spans can be recovered (``depth`` times
    over); what lies between them is left as it is."""
    if text.isascii():
        return False, None
    p = _patterns()
    spans: list[tuple[int, int, str | None]] = []  # start, end, original (None: not recoverable)
    taken = bytearray(len(text))

    def add(start: int, end: int, original: str | None) -> None:
        if not any(taken[start:end]) and not _quoted(text, start, end):
            spans.append((start, end, original))
            taken[start:end] = b"\x01" * (end - start)

    for m in p["latin_run"].finditer(text):
        if any(c > "\x7f" for c in m[0]) and (original := _decoded_latin(m[0])) is not None:
            add(m.start(), m.end(), original or None)
    met = sorted(((end - n + 1, -n, meant) for end, (n, meant) in automaton().iter(text)), key=lambda x: (x[0], x[1]))
    met = [(s, -n, meant) for s, n, meant in met]
    cyrillic_only = "РС"
    if met and all(text[s] in cyrillic_only and text[s + 1] in "ё№Ё«»–—“”„…" for s, n, _ in met if n > 1):
        met = [h for h in met if h[1] == 1]  # ordinary Russian with a quotation mark or ё behind a capital
    hits, last = [], 0
    for hit in met:
        if hit[0] >= last:
            hits.append(hit)
            last = hit[0] + hit[1]
    for (s, n, _), c in zip(hits, _chosen(text, hits)):
        add(s, s + n, c)
    for m in p["wide_run"].finditer(text):
        if (original := _decoded_run(m[0])) is not None:
            add(m.start(), m.end(), original or None)
    han = sum("㐀" <= c <= "鿿" for c in text)
    if han < 0.1 * len(text):
        for m in p["wide_sign"].finditer(text):
            add(m.start(), m.end(), _wide_symbols()[m[0]])
    inside = [m for name in ("inside", "greek_word", "start") for m in p[name].finditer(text)]
    if inside:
        table, votes = _one_to_one(), dict.fromkeys(range(len(ONE_TO_ONE)), 0)
        for m in inside:
            for g in m[0]:
                for k, _ in table.get(g, ()):
                    votes[k] += 1
        best = max(votes, key=lambda k: votes[k])
        for m in inside:
            letters = [dict(table.get(g, ())).get(best) for g in m[0]]
            add(m.start(), m.end(), "".join(letters) if all(letters) else None)
        if votes[best]:  # the same pair's other letters: the word's ends, capitals
            struck = bytearray(len(text))
            for m in inside:
                struck[m.start()] = 1
            in_line = [any(struck[a:b]) for a, b in _lines(text)]
            line = 0
            for i, g in enumerate(text):
                if g == "\n":
                    line += 1
                if not in_line[line]:  # damage of a part of the text: correct lines stay as they are
                    continue
                if not taken[i] and g in table and not "ß" <= g <= "ÿ" and (c := dict(table[g]).get(best)) and i + 1 < len(text) and (text[i + 1].isalpha() or text[i - 1 : i].isalpha()):
                    add(i, i + 1, c)
                elif not taken[i] and not g.isascii() and g not in _EXPECTED and (c := _other(g, *ONE_TO_ONE[best])) and c in _EXPECTED:
                    add(i, i + 1, c)
    for m in p["koi"].finditer(text):
        a, b = m.start(), m.end()
        raw = _raw(text[a:b], "cp1251")
        add(a, b, raw.decode("koi8-r", "ignore") if raw else None)
    for name in ("cyrillic_sign", "box"):
        for m in p[name].finditer(text):
            add(m.start(), m.end(), None)
    for m in p["lost"].finditer(text):
        add(m.start(), m.end(), None)
    if not spans:
        return False, None
    spans.sort()
    # the text, or the lines from the first damaged one to the last, damaged throughout by one pair
    lines = (text.rfind("\n", 0, spans[0][0]) + 1, text.find("\n", spans[-1][1]) % (len(text) + 1))
    for region in dict.fromkeys([(0, len(text)), lines]):
        if (better := _by_pair(text, None, depth, region)) is not None and _sound(better):
            return True, better
    out, at = [], 0
    for start, end, original in spans:
        out += [text[at:start], original or text[start:end]]
        at = end
    original = "".join([*out, text[at:]])
    known = all(o is not None for _, _, o in spans)
    if depth > 1 and known and original != text:
        again, better = damage(original, depth - 1)
        if again:
            return True, better
    if not known or any(map(_unexpected, original)):
        # some spans have no original of their own, or strange characters are left: one pair has to explain them all
        better = _by_pair(text, spans, depth)
        by_automaton = known and not any(_unexpected(c) for _, _, o in spans for c in o)
        better = better if better is not None or not by_automaton else original
        return True, better if better is None or _sound(better) else None
    return True, original if _sound(original) else None


def _sound(text: str) -> bool:
    """Whether no character of ``text`` is strange where it stands; what isn't sound is not reported as recovered."""
    return not any(_strangeness(c, text[i - 1 : i], text[i + 1 : i + 2]) > 1 for i, c in enumerate(text) if not c.isascii())


def _lines(text: str) -> list[tuple[int, int]]:
    ends = [*(i for i, c in enumerate(text) if c == "\n"), len(text)]
    return [(a + 1, b) for a, b in zip([-1, *ends], ends)]


def _unexpected(c: str) -> bool:
    return not c.isascii() and c not in _EXPECTED and c not in _common_han()


_STRANGE_RUN = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]|[ \xa0](?=[^\x00-\x7f]))*")


_PAIRS = (*(("utf-8", w) for w in (*WRONG_FOR_UTF8, *FURTHER_FOR_UTF8, *WRONG_WIDE)), *ONE_TO_ONE, *CYRILLIC_PAIRS, *WIDE_PAIRS)


def _by_pair(text: str, spans: list[tuple[int, int, str | None]] | None, depth: int, region: tuple[int, int] | None = None) -> str | None:
    """The original by the one encoding pair under which every run of characters beyond ASCII in the ``region`` (or, given ``spans``, every one
    that touches them or holds unexpected characters) decodes to expected characters and is got back by encoding them again;
    None if no pair does so, or several do with different results. Runs decoded to another damage may go ``depth`` deep."""
    everything = [(m.start(), m.end()) for m in _STRANGE_RUN.finditer(text, *(region or ()))]
    hit = bytearray(len(text))
    for s, e, _ in spans or ():
        hit[s:e] = b"\x01" * (e - s)
    found: dict[str, float] = {}
    for right, wrong in _PAIRS:
        runs = everything
        if spans is not None:
            # beside correct text: only what this decoder can have made
            made = everything if wrong in WRONG_WIDE else [(m.start(), m.end()) for m in _upper_half(wrong).finditer(text)]
            runs = [(a, b) for a, b in made if any(hit[a:b]) or any(map(_unexpected, text[a:b]))]
            if sum(map(sum, (hit[a:b] for a, b in runs))) < sum(hit):
                continue
        out, at, size, odd, russian, most = [], 0, 0, 0, [], sum(b - a for a, b in runs)
        for a, b in runs:
            data = _raw(text[a:b], wrong)
            try:
                part = data.decode(right) if data else None
            except UnicodeError:
                part = None
            if part is None or _garbled(part, right, wrong) != text[a:b]:
                break
            whole = text[a - 1 : a] + part + text[b : b + 1]
            first = min(a, 1)
            for i, c in enumerate(part):
                if not c.isascii():
                    size += 1
                    odd += _strangeness(c, whole[i + first - 1 : i + first] if i + first else "", whole[i + first + 1 : i + first + 2])
                    if odd > 0.05 * most and right != "utf-8":  # too strange, whatever comes
                        break
            if odd > 0.05 * most and right != "utf-8":
                break
            russian += [part] if any("Ѐ" <= c <= "ӿ" for c in part) else []
            out += [text[at:a], part]
            at = b
        else:
            original = "".join([*out, text[at:]])
            if original == text or not runs:
                continue
            if right == "utf-8" and depth > 1 and damage_shown(original):
                again, original = damage(original, depth - 1)
                if original is not None:
                    found[original] = 1.0
                continue
            sound = 1.0 if not russian else _russian(" ".join(russian))
            if odd <= 0.05 * size and sound >= 0.35 and not damage_shown(original):
                found[original] = max(found.get(original, 0.0), sound - odd / max(1, size))
    ranked = sorted(found, key=lambda t: -found[t])
    return ranked[0] if ranked and all(found[t] < 0.9 * found[ranked[0]] for t in ranked[1:]) else None


@lru_cache(maxsize=None)
def _upper_half(wrong: str) -> re.Pattern:
    """Runs of the characters that a single-byte decoder makes of the bytes beyond ASCII."""
    letters = "".join(re.escape(c) for b in range(0x80, 0x100) for c in (_garbled(chr(b), "latin-1", wrong) or ""))
    return re.compile(f"[{letters}]+")


def damage_shown(text: str) -> bool:
    """Whether ``text`` still shows a sequence of the automaton or a lost character."""
    return bool(_patterns()["lost"].search(text)) or next(iter(automaton().iter(text)), None) is not None


DAMAGE = T.StructType([T.StructField("damaged", T.BooleanType()), T.StructField("original", T.StringType())])


@F.pandas_udf(DAMAGE)
def damages(texts: pd.Series) -> pd.DataFrame:
    """Once per distinct text of a batch."""
    codes, distinct = pd.factorize(texts)
    found = [*map(damage, distinct), (False, None)]
    return pd.DataFrame({"damaged": [found[c][0] for c in codes], "original": pd.Series([found[c][1] for c in codes], dtype=object)})


def damaged_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, text, original) of the damaged texts; original is null where it can't be recovered."""
    looked = documents.select("doc_id", "text", damages("text").alias("d"))
    return looked.where("d.damaged").select("doc_id", "text", F.col("d.original").alias("original"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id")


def p9_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "original")
