"""SQL text for the DuckDB oracle.

Each helper returns a DuckDB expression or query that states the same
semantics as the Spark operator in plain SQL (string, list and regex
functions, window functions, a recursive CTE for the consuming fold).
Patterns and word lists come from ``claimtext.constants`` so both sides use
the same fixed values; the logic is written independently.
"""

from __future__ import annotations

from claimtext import constants as K
from claimtext.functions.patterns import Lexicon, base_pattern, side_pattern


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    out = f"strip_accents({x})"
    for ch, rep in K.FOLD_EXCEPTIONS.items():
        out = f"replace({out}, {q(ch)}, {q(rep)})"
    return out


def punct(x: str) -> str:
    return f"translate({x}, {q(K.PUNCTUATION)}, {q(' ' * len(K.PUNCTUATION))})"


def numbers(x: str) -> str:
    return f"replace(translate({x}, '0123456789', ''), '  ', ' ')"


def apostrophe(x: str) -> str:
    return f"translate({x}, {q(K.APOSTROPHES)}, '  ')"


def ws_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def raw_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, {q(K.RAW_TOKEN_PATTERN)})"


def stop_list() -> str:
    return "[" + ", ".join(q(w) for w in K.FRENCH_STOP_WORDS) + "]"


def drop_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: length(t) > 2 AND NOT list_contains({stop_list()}, t))"


def joined(tokens: str) -> str:
    """Every word followed by a space."""
    return f"array_to_string(list_transform({tokens}, lambda w: w || ' '), '')"


def process_tokens(x: str, distinct: bool = False) -> str:
    s = punct(f"lower({numbers(fold(x))})")
    t = drop_stop(ws_tokens(s))
    t = ws_tokens(apostrophe(f"array_to_string({t}, ' ')"))
    if distinct:
        t = f"list_distinct({t})"
    return drop_stop(t)


def extraction_line(x: str) -> str:
    return punct(f"lower({fold(x)})")


# --- extraction ---------------------------------------------------------------

def match_columns(x: str, member: str, lex: Lexicon) -> tuple[str, str, str]:
    """(phrase, member, side) SQL expressions of one member against ``x``."""
    spec = lex.spec(member)
    b = f"regexp_extract({x}, {q(base_pattern(spec.alt, java=False))}, 1)"
    l = f"regexp_extract({x}, {q(side_pattern(spec.alt, lex.left, java=False))}, 1)"
    r = f"regexp_extract({x}, {q(side_pattern(spec.alt, lex.right, java=False))}, 1)"
    phrase = (f"CASE WHEN {b} = '' THEN {q(K.UNKNOWN)} WHEN {l} <> '' AND {r} <> '' THEN {b} "
              f"WHEN {l} <> '' THEN {l} WHEN {r} <> '' THEN {r} ELSE {b} END")
    mem = f"CASE WHEN {b} = '' THEN {q(spec.alt)} ELSE {q(spec.label)} END"
    side = (f"CASE WHEN {b} = '' THEN {q(K.UNKNOWN)} WHEN {l} <> '' AND {r} <> '' THEN {q(K.SIDE_BOTH)} "
            f"WHEN {l} <> '' THEN {q(K.SIDE_LEFT)} WHEN {r} <> '' THEN {q(K.SIDE_RIGHT)} ELSE {q(K.UNKNOWN)} END")
    return phrase, mem, side


def match_by_name(x: str, member_expr: str, members, lex: Lexicon) -> tuple[str, str, str]:
    outs = []
    for i in range(3):
        branches = " ".join(f"WHEN {member_expr} = {q(m)} THEN {match_columns(x, m, lex)[i]}" for m in members)
        outs.append(f"CASE {branches} END")
    return tuple(outs)
