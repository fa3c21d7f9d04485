"""SQL fragments that the oracles share."""

from __future__ import annotations

import unicodedata

BLANK = r"[ \t\n\f\r\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


def key(column: str) -> str:
    return f"lower(regexp_replace({column}, '{BLANK}', '', 'g'))"


def trimmed(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANK}|{BLANK}$', '', 'g')"


def tokens(column: str) -> str:
    """The list of lexical tokens of a text."""
    k = key(column)
    runs = f"regexp_extract_all({k}, '[\\x{{4e00}}-\\x{{9fff}}]+')"
    grams = f"flatten(list_transform({runs}, lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substring(r, i::BIGINT, 2))))"
    return f"list_concat({grams}, regexp_extract_all({k}, '[a-z0-9]+'))"


ROLE = "CASE WHEN {0} IN ('user', 'human', 'prompter', 'question', 'customer') THEN 'user' WHEN {0} IN ('assistant', 'model', 'bot', 'gpt', 'answer', 'ai') THEN 'assistant' ELSE {0} END"


def role(column: str) -> str:
    return ROLE.format(key(f"regexp_replace({column}, '[\\x{{200b}}\\x{{feff}}]', '', 'g')"))


#: (record_id, metadata, pos, asked, answer): each user message of chat_records with the answer directly behind it.
PAIRS = f"""pair AS (SELECT record_id, metadata, i - 1 AS pos, messages[i].content AS asked, CASE WHEN {role("messages[i + 1].role")} = 'assistant' THEN messages[i + 1].content END AS answer
  FROM (SELECT record_id, metadata, messages, unnest(generate_series(1, len(messages))) AS i FROM chat_records WHERE messages IS NOT NULL) WHERE {role("messages[i].role")} = 'user')"""


def _folded() -> str:
    """Each character whose compatibility form with full case folding differs from it, by rule; composed signs of Chinese and
    Korean aside, which have none."""
    rows = []
    for code in (*range(0x41, 0x3400), *range(0xF900, 0xFFF0)):
        form = unicodedata.normalize("NFKC", chr(code)).casefold()
        if form != chr(code):
            rows.append(f"({code}, '{form.replace(chr(39), chr(39) * 2)}')")
    return ", ".join(rows)


def comparison_keys(values: str) -> str:
    """CTEs up to compared(v, k): the comparison key k of each value v of the query ``values``."""
    return f"""fold(c, f) AS (VALUES {_folded()}),
spelt AS (SELECT DISTINCT v, nfc_normalize(v) AS n FROM ({values}) t(v) WHERE v IS NOT NULL),
letter AS (SELECT v, n, unnest(generate_series(1, length(n))) AS i FROM spelt),
compared AS (SELECT v, trim(regexp_replace(nfc_normalize(string_agg(coalesce(f, substring(n, i, 1)), '' ORDER BY i)), '{BLANK}', ' ', 'g')) AS k FROM letter LEFT JOIN fold ON c = unicode(substring(n, i::BIGINT, 1)) GROUP BY v)"""


POSITIVE = "('positive', 'affirmed', 'true', '肯定', '存在')"
NEGATIVE = "('negative', 'negated', 'false', '否定', '不存在')"


def qualifier(name: str) -> str:
    return f"qualifiers['{name}']"


#: Claims with their comparison keys; p_key is the controlled predicate that one of the two spellings means.
KEYED = f"""{comparison_keys("SELECT unnest([subject, predicate, predicate_normalized, object]) FROM graph_claims UNION ALL SELECT unnest(map_values(qualifiers)) FROM graph_claims UNION ALL SELECT unnest([term_code, label_en, label_zh]) FROM ref_terms")},
alias AS (SELECT k.k, min(term_code) AS code FROM (SELECT term_code, unnest([term_code, label_en, label_zh]) AS v FROM ref_terms WHERE term_kind = 'predicate') t JOIN compared k USING (v) GROUP BY k.k),
keyed AS (
  SELECT claim_row, run_id, confidence, evidence_ids, subject_type, object_type,
    nullif(s.k, '') AS s_key, nullif(p.k, '') AS raw_key, coalesce(an.code, ap.code) AS p_key, nullif(o.k, '') AS o_key,
    coalesce(nullif(q1.k, ''), nullif(q2.k, ''), nullif(q3.k, ''), nullif(q4.k, ''), 'global') AS scope,
    CASE WHEN q5.k IN {POSITIVE} THEN true WHEN q5.k IN {NEGATIVE} THEN false END AS positive
  FROM graph_claims LEFT JOIN compared s ON s.v = subject LEFT JOIN compared p ON p.v = predicate LEFT JOIN compared n ON n.v = predicate_normalized LEFT JOIN compared o ON o.v = object
  LEFT JOIN compared q1 ON q1.v = {qualifier("case_id")} LEFT JOIN compared q2 ON q2.v = {qualifier("document_id")} LEFT JOIN compared q3 ON q3.v = {qualifier("source_id")} LEFT JOIN compared q4 ON q4.v = {qualifier("time_window")}
  LEFT JOIN compared q5 ON q5.v = {qualifier("polarity")} LEFT JOIN alias an ON an.k = n.k LEFT JOIN alias ap ON ap.k = p.k)"""
