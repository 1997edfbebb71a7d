"""Cleaning functions: golden rows and properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimtext import constants as K
from claimtext.functions import text as TX


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("o")).first()["o"]


def test_stop_words_equal_spark_list(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert K.FRENCH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("french")


def test_remove_numbers_four_spaces_become_two(spark):
    # Digits deleted, then a single left-to-right pass of "  " -> " "
    assert one(spark, TX.remove_numbers(F.col("s")), "a    b") == "a  b"
    assert one(spark, TX.remove_numbers(F.col("s")), "a1 2b") == "a  b".replace("  ", " ")


def test_punctuation_set(spark):
    s = "a!b\\c\xa0d®e'f\tg\rh,i\nj"
    out = one(spark, TX.remove_punctuation(F.col("s")), s)
    assert out == "a b c d e'f\tg\rh i j"


def test_fold(spark):
    s = "Épaule Œdème straße « ça » naïve l’os"
    assert one(spark, TX.fold(F.col("s")), s) == 'Epaule OEdeme strasse << ca >> naive l\'os'
    assert TX.fold_python(s) == one(spark, TX.fold(F.col("s")), s)


def test_fold_combining_marks_and_symbols(spark):
    s = "e\u0301paule 5 µg ½ m² 3 €"
    assert one(spark, TX.fold(F.col("s")), s) == "epaule 5 ug 1/2 m2 3 EUR" == TX.fold_python(s)


def test_raw_tokens(spark):
    out = one(spark, TX.raw_tokens(F.col("s")), "l'épaule, genou. av-bras")
    assert out == ["l'épaule", ",", "genou", ".", "av-bras"]


def test_process_string_order_is_semantic(spark):
    # folded before the first stop pass: "été" -> "ete" survives; "l'epaule" survives pass 1
    # and its "l" is removed by pass 2 (length <= 2)
    out = one(spark, TX.process_string(F.col("s")), "Été 2020: l'épaule de la main droite")
    assert out == "ete epaule main droite "


def test_process_string_distinct(spark):
    out = one(spark, TX.process_string_distinct(F.col("s")), "genou genou douleur genou")
    assert out == "genou douleur "


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=list("ab !.,\xa0®\n'’-_[]\\"), max_size=30))
def test_punctuation_preserves_length(spark, s):
    assert len(one(spark, TX.remove_punctuation(F.col("s")), s)) == len(s)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["genou", "main", "la", "de", "bras", "os"]), max_size=12))
def test_distinct_is_idempotent(spark, words):
    s = " ".join(words)
    once = one(spark, TX.process_string_distinct(F.col("s")), s)
    twice = one(spark, TX.process_string_distinct(F.col("s")), once)
    assert once == twice


# --- P13 / P14 against a plain-Python model of the reference's sequence -----------

def model_process(s, distinct=False):
    stop = set(K.FRENCH_STOP_WORDS)

    def stop_pass(d):
        return "".join(w + " " for w in d.split() if w not in stop and len(w) > 2)
    d = TX.fold_python(s)
    d = d.translate(str.maketrans("", "", "0123456789")).replace("  ", " ")
    d = d.lower()
    for ch in K.PUNCTUATION:
        d = d.replace(ch, " ")
    d = stop_pass(d)
    d = d.replace("'", " ").replace("’", " ")
    if distinct:
        d = "".join(w + " " for w in dict.fromkeys(d.split()))
    return stop_pass(d)


ALPHABET = list("abcdeéèàçôœßÉ") + [" ", "  ", "'", "’", "‘", "1", "2", "\xa0", "®", "\n", "\t", ".", ",", "-", "l'", "été"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40))
def test_process_string_agrees_with_model(spark, parts):
    s = "".join(parts)
    df = spark.createDataFrame([(s,)], "s string")
    got = df.select(TX.process_string(F.col("s")).alias("a"), TX.process_string_distinct(F.col("s")).alias("b")).first()
    assert got["a"] == model_process(s)
    assert got["b"] == model_process(s, distinct=True)


def test_long_joined_token(spark):
    """One token of many joined pieces: no recursion on the JVM's stack."""
    t = "-".join(["ab"] * 20_000)
    df = spark.createDataFrame([(t,), (t + " x",)], "s string")
    got = df.select(F.size(TX.raw_tokens("s")).alias("n"), TX.has_two_raw_tokens(F.col("s")).alias("two")).collect()
    assert [tuple(r) for r in got] == [(1, False), (2, True)]


def test_fold_drops_what_it_folds_to():
    """Digits go in the pass that folds, those that a character is folded to as well."""
    from claimtext import constants as K
    plan = str(TX.fold("t", also_drop=K.DIGITS))
    assert "1/4" not in plan and "/" in plan


def test_one_pass_chain_equals_pass_by_pass(spark):
    texts = ["a1  b", "x½y² deg°3", "l’eau d'été, n'est-ce pas", "ΣΑΣ. ΑΣ'b", "", "  ", None, "œuvre\u0301 1 2  3", "a\xa0b®c[d]e\\\\f^g"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    s = TX.remove_punctuation(TX.lower(TX.remove_numbers(TX.fold("t"))))
    passes = TX.ws_tokens(TX.remove_apostrophe(F.array_join(TX.remove_stop_words(TX.ws_tokens(s)), " ")))
    assert d.where(~passes.eqNullSafe(TX.unstemmed_tokens("t"))).count() == 0
    assert "translate" not in str(TX.unstemmed_tokens("t")).replace("translate", "", 1)  # one pass over the text, not four


def test_punctuation_by_character_class(spark):
    """Each character becomes a space, as a map of characters would have it, and none is looked up in one."""
    from claimtext import constants as K
    texts = [K.PUNCTUATION, f"a{K.PUNCTUATION[::-1]}b", "é\U0001f600-\u2028’'x", "", None, "a\r\tb\x0b"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    mapped = F.translate("t", K.PUNCTUATION, " " * len(K.PUNCTUATION))
    assert d.where(~mapped.eqNullSafe(TX.remove_punctuation("t"))).count() == 0
    assert "translate" not in str(TX.remove_punctuation("t"))
