"""Extraction (E1-E9): golden rows, an independent Python model, anchoring."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimtext import constants as K
from claimtext.functions.patterns import Lexicon, base_pattern, members_from_columns, side_pattern
from claimtext.operators.extract import extract_tuples, match_member

SCHEMA = ("claim_id long, description string, IndLesionGenouGauche boolean, IndLesionAutrePartieCorps boolean, "
          "IndLesionMain boolean, PrecisionLesionAutrePartieCorps string")


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in extract_tuples(df).orderBy("claim_id", "seq").collect()]


def test_golden_rows(spark):
    rows = [
        (1, "Entorse genou gauche", True, False, False, None),          # G1
        (2, "genou gauche", True, False, False, None),                  # G2: term at line start
        (3, "entorse genou gauche et genou droit", True, False, False, None),  # G3
        (4, "entorse genou", True, False, False, None),                 # G4
        (5, "mal genou et main", True, False, True, None),              # G5: consuming fold
        (7, "x autre chose", False, True, False, "dos"),                # other part only
        (9, "1", True, False, False, None),                             # one raw token: skipped
        (10, None, True, False, False, None),                           # null description
    ]
    assert run(spark, rows) == [
        (1, 0, "entorse genou gauche", "genou", "gauche"),
        (3, 0, "entorse genou gauche et genou ", "genou", "droit/gauche"),
        (4, 0, "entorse genou", "genou", "inconnu"),
        (5, 0, "mal genou ", "genou", "inconnu"),
        (5, 1, "et main", "main", "inconnu"),
        (5, 2, "mal genou et main", "main", "inconnu"),
        (7, 0, "x autre chose", "Autre partie: dos", "inconnu"),
    ]


def test_hip_dead_branch_and_missing_boundary(spark):
    df = spark.createDataFrame([("douleur hanches gauche",), ("un etalon",)], "l string")
    lex = Lexicon.default()
    got = df.select(match_member("l", "hanche", lex).alias("h"), match_member("l", "pied", lex).alias("p")).collect()
    assert tuple(got[0]["h"]) == ("douleur hanche", "hanche", "inconnu")          # G6
    assert tuple(got[1]["p"]) == ("un etalon", "pied", "inconnu")                # G7
    fixed = Lexicon.default(fix_hanche=True)
    h = df.select(match_member("l", "hanche", fixed).alias("h")).first()["h"]
    assert tuple(h) == ("douleur hanches gauche", "hanche", "gauche")


def test_members_from_columns():
    cols = ["IndLesionGenouGauche", "IndLesionGenouDroit", "IndLesionAvantBrasDroite", "IndLesionCuissseGauche",
            "IndLesionAutrePartieCorps", "PrecisionLesionAutrePartieCorps"]
    assert members_from_columns(cols) == ["avantbras", "genou"]


# --- independent model of one-member matching, with Python's re -------------------

def model_match(line, member, lex):
    spec = lex.spec(member)
    cls = K.WORD_CLASS
    m = re.search(f"(.*{cls}+\\s*({spec.alt})\\s*)", line)
    if m is None:
        return ("inconnu", spec.alt, "inconnu")
    lm = re.search(f"(.*{cls}+\\s*({spec.alt})\\s*({'|'.join(lex.left)}))", line)
    rm = re.search(f"(.*{cls}+\\s*({spec.alt})\\s*({'|'.join(lex.right)}))", line)
    if lm and rm:
        return (m.group(1), spec.label, "droit/gauche")
    if lm:
        return (lm.group(1), spec.label, "gauche")
    if rm:
        return (rm.group(1), spec.label, "droit")
    return (m.group(1), spec.label, "inconnu")


WORDS = ["genou", "genoux", "main", "gauche", "droite", "d", "g", "mal", "de", "x", "bras", "avant"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8), st.sampled_from(["genou", "main", "avantbras"]))
def test_match_agrees_with_python_model(spark, words, member):
    line = " ".join(words)
    lex = Lexicon.default()
    got = spark.createDataFrame([(line,)], "l string").select(match_member("l", member, lex).alias("t")).first()["t"]
    assert tuple(got) == model_match(line, member, lex)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(WORDS), min_size=1, max_size=8))
def test_anchored_equals_unanchored(spark, words):
    line = " ".join(words)
    alt = Lexicon.default().spec("genou").alt
    anchored = base_pattern(alt)
    plain = anchored.replace("^(?d)", "(?d)")
    df = spark.createDataFrame([(line,)], "l string")
    a, b = df.select(F.regexp_extract("l", anchored, 1), F.regexp_extract("l", plain, 1)).first()
    assert a == b


def test_side_pattern_shape():
    assert side_pattern("x", ["\\bg\\b"]).startswith("^(?d)(.*")


# --- E4: consuming fold against a Python model ------------------------------------

def model_sequential(line, members, lex):
    out, rest = [], line
    for m in members:
        t = model_match(rest, m, lex)
        out.append(t)
        rest = rest.replace(t[0], "")
        if rest == "":
            out.append(model_match(line, m, lex))
    return out


FOLD_WORDS = ["genou", "main", "mal", "et", "gauche", "droit", "inconnu", "x", "pied", "talon"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(FOLD_WORDS), min_size=1, max_size=7),
       st.lists(st.sampled_from(["genou", "main", "pied"]), min_size=2, max_size=4))
def test_sequential_agrees_with_python_model(spark, words, members):
    from claimtext.operators.extract import match_sequential
    line = " ".join(words)
    lex = Lexicon.default()
    df = spark.createDataFrame([(line, members)], "l string, m array<string>")
    got = df.select(match_sequential(F.col("l"), F.col("m"), ["genou", "main", "pied"], lex).alias("t")).first()["t"]
    assert [tuple(x) for x in got] == model_sequential(line, members, lex)


def test_strip_boundary_tags():
    from claimtext.functions.patterns import strip_boundary_tags
    assert strip_boundary_tags("\\bgenou(x)?\\b") == "genou(x)?"
    assert strip_boundary_tags("talon(s)?") == "talon(s)?"


# --- E9 end to end against a Python model of the whole job --------------------------

def model_extract(rows, flag_cols, lex):
    import regex
    from claimtext.functions.patterns import member_and_side
    from claimtext.functions.text import fold_python
    raw_tok = regex.compile(K.RAW_TOKEN_PATTERN)
    members_all = members_from_columns(flag_cols + ["PrecisionLesionAutrePartieCorps"])
    out = []
    for cid, desc, *flags, prec in rows:
        if desc is None or len(raw_tok.findall(desc)) <= 1:
            continue
        line = fold_python(desc).lower()
        for ch in K.PUNCTUATION:
            line = line.replace(ch, " ")
        hits = [member_and_side(c) for c, f in zip(flag_cols, flags) if f]
        if len(hits) == 1:
            m, _side, other = hits[0]
            res = [(line, "Autre partie: " + (prec if prec is not None else "nan"), "inconnu")] if other \
                else [model_match(line, m, lex)]
        elif len(hits) > 1:
            res = model_sequential(line, [m for m, _s, o in hits if not o], lex)
        else:
            res = [model_match(line, m, lex) for m in members_all]
        out += [(cid, i, *t) for i, t in enumerate(res) if t[0] != "inconnu"]
    return sorted(out)


CLAIM_WORDS = ["Entorse", "genou", "gauche", "droite", "main", "Épaule", "épaule", "d", "pied,", "et", "à", "la",
               "talon.", "x", "douleur", "Genoux"]
FLAGS = ["IndLesionGenouGauche", "IndLesionGenouDroite", "IndLesionMain", "IndLesionEpaule",
         "IndLesionAutrePartieCorps"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(CLAIM_WORDS), min_size=0, max_size=8),
                          st.lists(st.booleans(), min_size=len(FLAGS), max_size=len(FLAGS)),
                          st.sampled_from([None, "dos", "cou"])), min_size=1, max_size=6))
def test_extract_job_agrees_with_python_model(spark, claims):
    rows = [(i, " ".join(w) if w or i % 2 else None, *f, p) for i, (w, f, p) in enumerate(claims)]
    schema = ("claim_id long, description string, " + ", ".join(f"{c} boolean" for c in FLAGS)
              + ", PrecisionLesionAutrePartieCorps string")
    df = spark.createDataFrame(rows, schema)
    lex = Lexicon.default()
    got = sorted(tuple(r) for r in extract_tuples(df, lexicon=lex).collect())
    assert got == model_extract(rows, FLAGS, lex)


def test_numeric_flags_equal_boolean_flags(spark):
    rows_b = [(1, "entorse genou gauche", True, False), (2, "mal genou et main", True, True), (3, "x main", False, True)]
    rows_n = [(i, d, 1 if a else 0, 1.0 if b else None) for i, d, a, b in rows_b]
    b = spark.createDataFrame(rows_b, "claim_id long, description string, IndLesionGenou boolean, IndLesionMain boolean")
    n = spark.createDataFrame(rows_n, "claim_id long, description string, IndLesionGenou int, IndLesionMain double")
    got_b = sorted(map(tuple, extract_tuples(b).collect()))
    got_n = sorted(map(tuple, extract_tuples(n).collect()))
    assert got_b == got_n and len(got_b) == 5


def test_user_lexicon_from_table(spark):
    lexdf = spark.createDataFrame([("genou", ["\\bgenou(x)?\\b", "\\brotule(s)?\\b"], "genou"),
                                   ("Main", ["\\bpaume\\b"], "main")], "member string, patterns array<string>, label string")
    lex = Lexicon.from_dataframe(lexdf)
    df = spark.createDataFrame([(1, "fracture rotule gauche", True, False), (2, "coupure paume droite", False, True)],
                               "claim_id long, description string, IndLesionGenou boolean, IndLesionMain boolean")
    got = sorted(tuple(r) for r in extract_tuples(df, lexicon=lex).collect())
    assert got == [(1, 0, "fracture rotule gauche", "genou", "gauche"), (2, 0, "coupure paume droite", "main", "droit")]


def test_lexicon_with_capitals_matches_in_any_case(spark):
    lex = Lexicon.from_rows([("genou", ["\\bGenou\\b", "\\bpatella\\W"], "genou")])
    df = spark.createDataFrame([(1, "Entorse GENOU gauche", True, False, False, None)], SCHEMA)
    assert [(r["phrase"], r["side"]) for r in extract_tuples(df, lexicon=lex).collect()] == [("entorse genou gauche", "gauche")]
    assert "(?i" not in base_pattern("\\bgenou\\b|\\W")


def test_required_literals():
    from claimtext.functions.patterns import required_literal, required_literals
    assert required_literal("\\bfesse(s)?\\b") == "fesse" and required_literal("\\bav bras\\b") == "av bras"
    assert required_literal("a|b") is None and required_literal("(x)?") is None and required_literal("\\bGenou\\b") is None
    assert required_literal("bras+") == "bra" and required_literal("(?i)bras") is None and required_literal("a(") is None
    assert required_literals(["bras", "avant bras", "main"]) == ["bras", "main"] and required_literals(["bras", "[ab]"]) is None


def test_every_default_pattern_holds_its_literals():
    """Any text that a pattern matches has one of the member's literals: checked on words made from the patterns."""
    import itertools
    import re
    lex = Lexicon.default(fix_hanche=True)
    for member, (_, patterns) in lex.entries.items():
        literals = lex.spec(member).literals
        assert literals, member
        for p in patterns:
            parts = [x if x.startswith("(") else [x] for x in re.findall(r"\([^)]*\)\??|[^()]+", p.replace("\\b", ""))]
            options = [x if isinstance(x, list) else (["", *x[1:-2].split("|")] if x.endswith("?") else x[1:-1].split("|"))
                       for x in parts]
            for word in map("".join, itertools.product(*options)):
                if re.search(p, word):
                    assert any(x in word for x in literals), (member, p, word)
