"""SQL pieces shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from textquarry import tables

WS = r"[ \t\n\r\f\v]+"


def words(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda v: regexp_matches(v, '^[a-z]+$'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def white_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}'), lambda v: v <> '')"


def sentences(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '[.!?]+'), lambda v: {strip('v')}), lambda v: v <> '')"


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, CAST(greatest(len({x}) - {n - 1}, 0) AS BIGINT) + 1), lambda i: array_to_string(list_slice({x}, i, i + {n - 1}), ' '))"


BASE = f"""
b0 AS (SELECT doc_id, {strip("coalesce(text, '')")} AS t FROM documents),
base AS (SELECT * FROM (SELECT doc_id, t, {words("t")} AS w, {sentences("t")} AS s FROM b0 WHERE length(t) >= 20) WHERE len(w) >= 10)
"""
PUNCT = r"[!-/:-@\[-`{-~]"


def entropy(x: str) -> str:
    return f"round(coalesce(list_aggregate({x}, 'entropy'), 0), 6)"


def folded(x: str) -> str:
    """The explicit tables and blank runs, as nested replacements."""
    single = {k: v for k, v in tables.FOLDS.items() if len(v) == 1}
    gone = [k for k, v in tables.FOLDS.items() if not v]
    q = lambda s: s.replace("'", "''")
    out = f"translate({x}, '{q(''.join([*single, *gone]))}', '{q(''.join(single.values()))}')"
    for k, v in tables.FOLDS.items():
        if len(v) > 1:
            out = f"replace({out}, '{q(k)}', '{q(v)}')"
    return f"regexp_replace({out}, '  +', ' ', 'g')"


def first_folded(x: str) -> str:
    q = lambda s: s.replace("'", "''")
    return rf"regexp_replace(translate({x}, '{q(''.join(tables.FIRST_FOLDS))}', '{q(''.join(tables.FIRST_FOLDS.values()))}'), '\p{{Cf}}', '', 'g')"


def protected_sentences(x: str) -> str:
    """The splitter that protects abbreviations; a pattern after a non-word character runs twice, as matches may touch."""
    edge = r"(^|[^\p{L}\p{N}_])"
    one, two = "chr(1)", "chr(2)"
    t = f"trim(regexp_replace({x}, '{WS}', ' ', 'g'), ' ')"
    t = f"regexp_replace({t}, '{edge}({'|'.join(tables.SPLIT_ABBREVIATIONS)})\\.', '\\1\\2' || {one}, 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '{edge}([A-Z])\\.', '\\1\\2' || {one}, 'g')"
    t = f"regexp_replace({t}, '([0-9])\\.([0-9])', '\\1' || {one} || '\\2', 'g')"
    for _ in range(2):
        t = f"regexp_replace({t}, '{edge}([a-zA-Z])\\.([a-zA-Z])\\.', '\\1\\2' || {one} || '\\3' || {one}, 'g')"
    t = f"regexp_replace(replace({t}, '...', repeat({one}, 3)), '([.!?]+[\"'')\\]]?) +', '\\1' || {two}, 'g')"
    return f"list_filter(list_transform(string_split({t}, {two}), lambda v: replace(trim(v, ' '), {one}, '.')), lambda v: v <> '')"


SENTENCES = f"""l0 AS (SELECT doc_id, text, {protected_sentences("coalesce(text, '')")} AS s FROM documents),
sents AS (SELECT doc_id, sentence, idx, len({white_words("sentence")}) AS n_words FROM (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS idx FROM l0))"""
BUDGET = f"""{SENTENCES}, kept AS (SELECT doc_id, sentence, idx, n_words FROM (SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM sents) WHERE run <= 380 AND n_words >= 10)"""


def linear(x: str) -> str:
    return f"((-1.0::DOUBLE + 0.05::DOUBLE * len({white_words(x)})) + -0.4::DOUBLE * (length({x}) - length(replace({x}, '.', ''))))"


GATE = f"""CASE WHEN coalesce(machine_text, '') = '' THEN 'empty' WHEN len(w) < 100 THEN 'short_' || len(w) || 'w' WHEN length(t) < 500 THEN 'short_' || length(t) || 'c'
    WHEN regexp_matches(substr(t, 1, 300), '{tables.REFUSAL_PATTERN.replace("'", "''")}') THEN 'refusal'
    WHEN length(t) - length(replace(t, '.', '')) < 3 AND NOT contains(t, chr(10)) THEN 'no_structure' ELSE 'ok' END"""
GATED = f"SELECT *, {white_words('t')} AS w FROM (SELECT *, {strip("coalesce(machine_text, '')")} AS t FROM generated_articles)"
