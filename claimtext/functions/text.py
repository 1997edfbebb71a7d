"""Column-level text cleaning (all JVM-side built-ins, no UDF).

Every function takes and returns a ``Column`` so it composes inside one
projection, works on batch and streaming DataFrames alike and stays inside
whole-stage codegen.  Token lists are ``array<string>`` columns; the
reference's "words joined by a trailing space" strings are produced only at
the edges with :func:`joined`.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimtext import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and hand it to ``fn`` (a one-element ``transform``).

    Inside higher-order functions Spark does not eliminate common
    subexpressions, so a value used several times (a regex match, a sorted
    array) is bound this way instead of being repeated.
    """
    return F.transform(F.array(value), fn).getItem(0)


# --- P8: ASCII folding ----------------------------------------------------

@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from_chars, to_chars, multi_char_replacements).

    Single letters of Latin-1 Supplement and Latin Extended-A are folded by
    rule: Unicode canonical decomposition, combining marks dropped, kept
    when the rest is one ASCII letter.  Exceptions come from
    ``constants.FOLD_EXCEPTIONS``.
    """
    src, dst = [], []
    for code in range(0x00C0, 0x0180):
        ch = chr(code)
        if ch in K.FOLD_EXCEPTIONS:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            src.append(ch)
            dst.append(base)
    multi = []
    for ch, rep in K.FOLD_EXCEPTIONS.items():
        if len(rep) == 1:
            src.append(ch)
            dst.append(rep)
        else:
            multi.append((ch, rep))
    src.extend(map(chr, range(0x0300, 0x0370)))  # combining marks have no counterpart: they are deleted
    return "".join(src), "".join(dst), tuple(multi)


def fold(c, also_drop: str = "") -> Column:
    """Transliterate Latin text to ASCII (accents dropped, ligatures split).

    ``also_drop`` are characters to delete from the result, which takes no
    pass of its own.
    """
    src, dst, multi = fold_tables()
    pairs = [(a, b) for a, b in zip(src, dst) if b not in also_drop]  # a character without a counterpart is deleted
    gone = [a for a, b in zip(src, dst) if b in also_drop]
    out = F.translate(_col(c), "".join([*(a for a, _ in pairs), *gone, src[len(dst):], also_drop]), "".join(b for _, b in pairs))
    for ch, rep in multi:
        out = F.replace(out, F.lit(ch), F.lit("".join(x for x in rep if x not in also_drop)))
    return out


def fold_python(s: str) -> str:
    """Driver-side twin of :func:`fold` for literals and tests."""
    src, dst, multi = fold_tables()
    s = s.translate(str.maketrans(src[:len(dst)], dst, src[len(dst):]))
    for ch, rep in multi:
        s = s.replace(ch, rep)
    return s


# --- P4-P7 ----------------------------------------------------------------

def lower(c) -> Column:
    return F.lower(_col(c))


def remove_punctuation(c) -> Column:
    """Each punctuation character becomes one space (length preserved).

    A character class is several times as fast as ``translate``, which looks
    every character of the text up in a map.
    """
    return F.regexp_replace(_col(c), f"[{_escaped(K.PUNCTUATION)}]", " ")


def remove_numbers(c) -> Column:
    """Delete ASCII digits, then one left-to-right pass of two spaces -> one."""
    return F.replace(F.translate(_col(c), K.DIGITS, ""), F.lit("  "), F.lit(" "))


def remove_apostrophe(c) -> Column:
    return F.translate(_col(c), K.APOSTROPHES, " " * len(K.APOSTROPHES))


# --- P9: tokenisers ---------------------------------------------------------

def ws_tokens(c) -> Column:
    """Whitespace tokens (the tokeniser contract after punctuation removal)."""
    return _split_at(c, "")


def _split_at(c, chars: str) -> Column:
    """Whitespace tokens of a text in which each of ``chars`` counts as a space: one pass, no text built in between."""
    return F.filter(F.split(_col(c), rf"[\s{_escaped(chars)}]+"), lambda t: t != "")


def _escaped(chars: str) -> str:
    """Characters as they stand in a character class."""
    return "".join(f"\\x{{{ord(ch):x}}}" for ch in chars)


def raw_tokens(c) -> Column:
    """Tokens of raw text: words (with inner ' ’ . -) and single symbols."""
    return F.regexp_extract_all(_col(c), F.lit(K.RAW_TOKEN_PATTERN_JAVA), 0)


def has_two_raw_tokens(c) -> Column:
    """``size(raw_tokens(c)) > 1`` without building the token array.

    Every non-space character belongs to some raw token, so there are at
    least two tokens exactly when something other than spaces follows the
    first token (matched atomically, i.e. as the tokeniser takes it).
    """
    return _col(c).rlike("^\\s*(?>" + K.RAW_TOKEN_PATTERN_JAVA + ")\\s*\\S")


def joined(tokens) -> Column:
    """Tokens as the reference writes them: every word followed by a space."""
    return F.array_join(F.concat(_col(tokens), F.array(F.lit(""))), " ")


# --- P10, P12 -----------------------------------------------------------------

def is_stop_word(t: Column) -> Column:
    """Membership in the French stop list (Catalyst turns the literal IN list
    into a hash-set lookup)."""
    return t.isin(*K.FRENCH_STOP_WORDS)


def remove_stop_words(tokens) -> Column:
    """Drop French stop words and tokens of length <= 2, keeping order."""
    return F.filter(_col(tokens), lambda t: (F.length(t) > K.MIN_TOKEN_LEN_EXCLUSIVE) & ~is_stop_word(t))


def remove_duplicates(tokens) -> Column:
    """Distinct tokens, first-seen order."""
    return F.array_distinct(_col(tokens))


# --- P13, P14 ---------------------------------------------------------------

def process_tokens(c, stem=None, distinct: bool = False) -> Column:
    """Cleaning chain of one text column -> cleaned token array.

    fold -> digits -> lower -> punctuation -> stop pass -> apostrophes ->
    [stem] -> [distinct] -> stop pass.  ``stem`` is a Column -> Column
    function over token arrays (see ``claimtext.functions.stem``).
    The order is semantic: folding happens before the first stop pass, so
    accented stop words survive it, and apostrophes are split only after it.
    """
    t = unstemmed_tokens(c)
    if stem is not None:
        t = stem(t)
    return after_stems(t, distinct)


def unstemmed_tokens(c) -> Column:
    """The chain up to the stems."""
    s = lower(F.replace(fold(_col(c), also_drop=K.DIGITS), F.lit("  "), F.lit(" ")))
    t = remove_stop_words(_split_at(s, K.PUNCTUATION))
    return _split_at(F.array_join(t, " "), K.APOSTROPHES)


def after_stems(tokens, distinct: bool = False) -> Column:
    """The chain from the stems on."""
    return remove_stop_words(remove_duplicates(tokens) if distinct else tokens)


def process_string(c, stem=None) -> Column:
    """P13 as a string (words followed by a space)."""
    return joined(process_tokens(c, stem=stem))


def process_string_distinct(c, stem=None) -> Column:
    """P14 as a string."""
    return joined(process_tokens(c, stem=stem, distinct=True))


def extraction_line(c) -> Column:
    """Line prepared for body-part matching: fold, lower, punctuation."""
    return remove_punctuation(lower(fold(_col(c))))


def remove_boundary_tags(pattern) -> Column:
    """M5: a pattern word without its literal ``\\b`` markers."""
    return F.replace(_col(pattern), F.lit("\\b"), F.lit(""))
