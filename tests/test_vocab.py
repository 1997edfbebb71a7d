"""Vocabulary building and the vocabulary filter."""

from pyspark.sql import functions as F

from claimtext.operators import vocab as VO


def test_vocabulary_filter_keeps_order_and_empty_rows(spark):
    rows = [(1, "fracture du genou gauche genou"), (2, "rien ici"), (3, "")]
    df = spark.createDataFrame(rows, "id long, phrase string")
    vocab = spark.createDataFrame([("genou",), ("fracture",)], "word string")
    out = {r["id"]: r["phrase"] for r in VO.vocabulary_filter(df, "id", "phrase", vocab, stem=False).collect()}
    assert out == {1: "fracture genou genou ", 2: "", 3: ""}


def test_vocabulary_filter_with_stems(spark):
    df = spark.createDataFrame([(1, "Fractures multiples des genoux")], "id long, phrase string")
    vocab = spark.createDataFrame([("fractur",), ("genoux",)], "word string")   # stem("genoux") is "genoux"
    out = VO.vocabulary_filter(df, "id", "phrase", vocab, stem=True).first()["phrase"]
    assert out == "Fractures genoux "


def test_vocabulary_removes_accented_stop_words(spark):
    # no folding in P17: "été" is a stop word and goes; the stop pass runs before apostrophes
    df = spark.createDataFrame([("Il a été opéré de l'épaule 2 fois.",)], "text string")
    words = sorted(r[0] for r in VO.vocabulary(df, "text", stem=False).collect())
    assert words == ["fois", "opéré", "épaule"]


def test_abbreviation_vocabulary(spark):
    df = spark.createDataFrame([("Fx. du Genou, fx du genou",)], "text string")
    words = sorted(r[0] for r in VO.abbreviation_vocabulary(df, "text").collect())
    assert words == [",", ".", "du", "fx", "genou"]   # a trailing dot is its own token


from hypothesis import given, settings
from hypothesis import strategies as st

from claimtext.functions.snowball_fr import stem as _stem

WORDS = ["Fractures", "genoux", "genou", "de", "la", "Main", "mains", "douleur", "douleurs", "épaule", "x"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=8), st.sets(st.sampled_from(["fractur", "genoux", "main", "de", "épaul"])))
def test_stemmed_filter_agrees_with_python(spark, words, vocab):
    phrase = " ".join(words)
    df = spark.createDataFrame([(1, phrase)], "id long, phrase string")
    v = spark.createDataFrame([(w,) for w in sorted(vocab)] or [("zzz",)], "word string")
    got = VO.vocabulary_filter(df, "id", "phrase", v, stem=True).first()["phrase"]
    assert got == "".join(w + " " for w in phrase.split() if _stem(w.lower()) in vocab)


def test_fold_vocab_matches_folded_phrases(spark):
    df = spark.createDataFrame([(1, "douleur epaule")], "id long, phrase string")     # phrases are folded
    vocab = spark.createDataFrame([("épaule",)], "word string")                      # vocabulary is not
    plain = VO.vocabulary_filter(df, "id", "phrase", vocab, stem=False).first()["phrase"]
    folded = VO.vocabulary_filter(df, "id", "phrase", vocab, stem=False, fold_vocab=True).first()["phrase"]
    assert (plain, folded) == ("", "epaule ")


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=10), st.sets(st.sampled_from(WORDS)))
def test_filter_output_is_subsequence(spark, words, vocab):
    phrase = " ".join(words)
    df = spark.createDataFrame([(1, phrase)], "id long, phrase string")
    v = spark.createDataFrame([(w.lower(),) for w in sorted(vocab)] or [("zzz",)], "word string")
    out = VO.vocabulary_filter(df, "id", "phrase", v, stem=False).first()["phrase"].split()
    it = iter(phrase.split())
    assert all(any(w == x for x in it) for w in out)          # subsequence, order kept
    assert all(w.lower() in {x.lower() for x in vocab} for w in out)


def test_filter_carries_columns_once_and_handles_odd_rows(spark):
    from pyspark.sql import functions as F
    rows = [(1, "a", "le GENOU le genou, Le", [1]), (2, "b", None, None), (3, None, "  ", [2]), (None, "c", "genou x", [])]
    df = spark.createDataFrame(rows, "id long, tag string, phrase string, more array<int>")
    vocab = spark.createDataFrame([("le",), ("genou",), (None,), ("le",)], "word string")
    got = VO.vocabulary_filter(df, ["id"], "phrase", vocab, tokenizer="raw", stem=False, out_col="kept", keep_original=True)
    assert got.columns == ["id", "tag", "more", "phrase", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a", [1], rows[0][2], "le GENOU le genou Le "), (2, "b", None, None, ""), (3, None, [2], "  ", ""),
         (None, "c", [], "genou x", "genou ")], key=str)
    assert VO.vocabulary_filter(df.limit(0), "id", "phrase", vocab).count() == 0
    assert VO.vocabulary_filter(df, "id", "phrase", vocab.limit(0)).where(F.col("phrase") != "").count() == 0
    # a long text with many copies of many words, joined without a broadcast
    words = [f"w{k % 700}" for k in range(20_000)]
    long = spark.createDataFrame([(7, " ".join(words))], "id long, phrase string")
    even = spark.createDataFrame([(f"w{k}",) for k in range(0, 700, 2)], "word string").hint("merge")
    out = VO.vocabulary_filter(long, "id", "phrase", even, stem=False).first()["phrase"]
    assert out == "".join(w + " " for w in words if int(w[1:]) % 2 == 0)


def test_process_strings_is_the_stemmed_chain(spark):
    from claimtext.functions import text as TX
    from claimtext.functions.stem import stem_tokens_ignore_stop
    from claimtext.operators import vocab as VO
    rows = [(1, "Les fractures du poignet, fracturé; l'entorse l'entorse", "x"), (2, None, "y"), (3, "", None),
            (4, "douleurs douleurs DOULEUR aux mains", "z"), (None, "genoux blessés", "n")]
    df = spark.createDataFrame(rows, "id long, text string, other string").withColumn("k", F.coalesce("id", F.lit(-1)))
    for distinct, chain in ((False, TX.process_string), (True, TX.process_string_distinct)):
        want = {r.k: (r.t, r.other) for r in df.select("k", "other", chain("text", stem=stem_tokens_ignore_stop).alias("t")).collect()}
        got = {r.k: (r.t, r.other) for r in VO.process_strings(df, "k", "text", "t", distinct=distinct).collect()}
        assert {k: (t or "", o) for k, (t, o) in want.items()} == {k: (t or "", o) for k, (t, o) in got.items()}


def test_stored_dictionary_stems_unseen_words_only(spark, tmp_path):
    from claimtext.operators import vocab as VO
    path = str(tmp_path / "stems")
    one = spark.createDataFrame([(["fractures", "mains", None],), (["mains"],), (None,)], "t array<string>")
    two = spark.createDataFrame([(["mains", "genoux"],)], "t array<string>")
    assert {r.token for r in VO.add_to_stem_dictionary(one, "t", path).collect()} == {"fractures", "mains"}
    # a stored stem is kept, so the word was not stemmed again
    spark.createDataFrame([("genoux", "kept")], "token string, stem string").write.mode("append").parquet(path)
    got = {r.token: r.stem for r in VO.add_to_stem_dictionary(two, "t", path).collect()}
    assert got["genoux"] == "kept" and got == {r.token: r.stem for r in VO.add_to_stem_dictionary(two, "t", path).collect()}
    out = VO.stemmed_tokens(two.withColumn("id", F.lit(1)), "id", "t", spark.read.parquet(path)).first()
    assert out.t == [got["mains"], "kept"]


def test_stems_are_placed_not_looked_up(spark):
    """Stems return by place, not from a map built anew for each token; rows that share a key or are equal are all kept."""
    rows = [(1, ["chats", "chat", "chats", None], "a")] * 2 + [(1, ["chats", "chat", "chats", None], "b"), (1, ["maisons"], "b"),
            (2, [], "c"), (3, None, "d"), (None, ["chiens", "zz", "chiens"], "e")]
    df = spark.createDataFrame(rows, "id long, t array<string>, x string")
    out = VO.stemmed_tokens(df, "id", "t")
    same = ["chat", "chat", "chat", None]
    want = [(1, same, "a")] * 2 + [(1, same, "b"), (1, ["maison"], "b"), (2, [], "c"), (3, None, "d"),
            (None, ["chien", "zz", "chien"], "e")]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    at = VO.stemmed_tokens(df.where("id = 2 or id is null").withColumnRenamed("id", "_at"), "_at", "t").collect()
    assert sorted(map(str, map(tuple, at))) == sorted(map(str, want[-1:] + want[4:5]))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "try_element_at" not in plan


def test_stems_go_back_by_segment(spark, monkeypatch):
    """A row for each word of a segment meets the stems, none for a token; rows come back from segments cut anywhere."""
    from claimtext.operators import segments as SG
    from claimtext.operators import vocab as VO
    rows = [(i, ["chats", f"genoux{i % 3}", "chats", None, "maisons"] * 20, {"a": [i]}) for i in range(12)] + [(None, None, None), (5, [], {})]
    df = spark.createDataFrame(rows, "id long, t array<string>, x map<string,array<int>>").repartition(2)
    want = sorted(str((i, t and [{"chats": "chat", "maisons": "maison"}.get(w, w) for w in t], x)) for i, t, x in rows)
    met = []
    plain = SG.with_values
    monkeypatch.setattr(SG, "with_values", lambda segments, values: met.append(values) or plain(segments, values))
    for limit in (SG.SEGMENT_WORDS, 150):
        monkeypatch.setattr(SG, "SEGMENT_WORDS", limit)
        monkeypatch.setattr(SG, "BATCH_WORDS", 130)
        assert sorted(str(tuple(r)) for r in VO.stemmed_tokens(df, "id", "t").collect()) == want
    assert met[0].count() <= 2 * 5  # of 960 tokens
    texts = spark.createDataFrame([(1, "Les fractures"), (2, None)], "id long, text string")
    got = VO.process_strings(texts, "id", "text", "text")
    assert got.columns == ["id", "text"] and {r.id: r.text for r in got.collect()} == {
        r.id: r.clean for r in VO.process_strings(texts, "id", "text", "clean").collect()}


def test_filter_keeps_each_spelling(spark):
    """Words of one key keep their own spellings and places."""
    df = spark.createDataFrame([(1, "Le LE le x Le l\u00c9 l\u00e9")], "id long, phrase string")
    vocab = spark.createDataFrame([("le",), ("l\u00e9",)], "word string")
    assert VO.vocabulary_filter(df, "id", "phrase", vocab, stem=False).first()["phrase"] == "Le LE le Le l\u00c9 l\u00e9 "
