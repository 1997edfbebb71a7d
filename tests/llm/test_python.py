"""Decontamination, token counts, language, substring dedup and SimHash against plain Python."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimtext.llm import components, decontaminate, language, simhash, substrings, tokens, words
from claimtext.session import ensure_checkpoint_dir
from tests.conftest import SF01, SF001
from tests.llm import brute, data


@pytest.fixture(scope="module")
def rows(spark):
    return data.documents(spark)


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [200_000, 60])
def test_decontamination(spark, rows, block):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    items += [(9001, "w1 w2"), (9002, None), (9003, ""), (9004, "ab cd ef"), (None, "x x"), (9005, "Words HERE"),
              (9001, rows[5][1][:200])]
    more = rows + [(None, "w1 w2"), (5, rows[5][1])]
    docs = data.frame(spark, [(i, t, 1, "s") for i, t in more], "doc_id long, text string, n_hit int, items string")
    marked = decontaminate.mark(docs, data.frame(spark, items, "item_id long, text string"), block_windows=block)
    got = marked.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256),
                        "contaminated")
    assert table(got) == sorted(brute.contamination(more, items), key=str)


def test_decontamination_clean_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (2, "z", 8)], "doc_id long, text string, contaminated int")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and table(kept) == [(2, "z", 8)]
    assert decontaminate.clean(docs, items.limit(0)).count() == 2
    assert decontaminate.clean(docs.limit(0), items).count() == 0


TRICKY = ["<|startoftext|> <|STARTOFTEXT|> a<|endoftext|>b  <|endof text|>", "it's WE'll \x1c \x85 \xa0 H̱ ẖ  x ́y",
          "á ́ é", "ΑΣ ΑΣ.", "a b　c​d e' s", "İI ŉ ﬁ ½² é"]


def test_token_counts_and_cache(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    assert tokens.splits_at_space(definition)
    more = rows + [(77_000 + k, t) for k, t in enumerate(TRICKY)] + [(None, "abc"), (None, "abc")]
    tokenizer = Tokenizer.from_file(path)
    want = sorted([(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for i, t in more], key=str)
    cache = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    for _ in range(2):
        got = tokens.count_tokens(data.frame(spark, more), definition, cache)
        assert table(got.select("doc_id", "n_bytes", "n_tokens", "over_limit")) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()  # the second run had no miss
    other = tokens.read_cache(spark, cache, tokens.version("another"))
    assert other.count() == 0
    assert tokens.count_tokens(data.frame(spark, rows).limit(0), definition, cache).count() == 0


def test_frequent_pieces_are_encoded_once(monkeypatch):
    """The memo forgets pieces that do not come again, not the frequent ones; long ones are not kept."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read(), True)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 20)
    seen = []
    encode = encoder._encode_pieces
    monkeypatch.setattr(encoder, "_encode_pieces", lambda pieces: seen.extend(pieces) or encode(pieces))
    often, long = [f"often{c}" for c in "abcdef"], "long" * 40
    texts = [" ".join([*often, long, *(f"own{i}x{j}" for j in range(15))]) for i in range(30)] + TRICKY + ["", " \n"]
    want = [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [n for t in texts for n in encoder.counts([t])] == want
    assert all(seen.count(w) == 1 for w in often) and seen.count(long) > 1
    assert encoder.counts(texts) == want
    assert len(encoder.before) <= 100


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.where(~held))
    scored = language.identify(docs.where(held).select("doc_id", "text", F.lit("x").alias("score")), model)
    joined = scored.join(docs.select("doc_id", "lang"), "doc_id")
    assert joined.where("lang = lang_pred").count() >= 0.97 * joined.count()
    assert joined.where("not (score between 0 and 1)").isEmpty()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 #"), (4, "漢字"),
                                 (5, "the of and thing with that is for; le la les des éaux ment que dans")],
                                "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in model.languages
    assert [s.lang for s in got[5].spans] == ["en", "fr"]
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0
    assert 0 < language.fit(docs, max_train=100).scores.std()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    first = np.array([0, 3, 3, 8, 12])
    scores = rng.normal(0, 3, (12, 3)).astype(np.float32)
    got = language.viterbi(scores, first, 2.0)
    from itertools import product
    for a, b in zip(first[:-1], first[1:]):
        def value(path):
            return sum(scores[a + t, s] for t, s in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        best = max(product(range(3), repeat=b - a), key=value)
        assert tuple(got[a:b]) == best


def test_substring_dedup(spark, rows):
    got = substrings.dedup(data.frame(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert table(got) == sorted(brute.substring_dedup(rows), key=str)


def test_substring_dedup_null_ids_and_clashes(spark):
    t = " ".join(f"v{k}" for k in range(50))
    df = spark.createDataFrame([(None, t, 1), (3, t, 2), (3, t, 3), (4, "x " + t, 4)], "doc_id long, text string, tag int")
    got = {r.tag: (r.n_words, r.n_removed) for r in substrings.dedup(df).collect()}
    assert got == {1: (50, 50), 2: (50, 0), 3: (50, 0), 4: (51, 50)}
    assert substrings.dedup(df.limit(0)).count() == 0


def test_simhash(spark, rows):
    more = rows + [(None, rows[3][1]), (rows[4][0], rows[4][1]), (None, "alone in null")]
    assert table(simhash.near_duplicates(data.frame(spark, more))) == sorted(brute.component_ids(more), key=str)


def test_simhash_one_of_each(spark, rows):
    docs = data.frame(spark, [(i, t, k, "c") for k, (i, t) in enumerate(rows + rows[:3])],
                      "doc_id long, text string, fp int, component string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    components_ = {c for _, _, c in brute.component_ids(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(components_)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_close_fingerprints_share_a_key(spark):
    """All pairs within 4 bits of a planted family are linked, however their bits lie."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    family = {base} | {base ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(60)}
    lone = {int(x) for x in rng.integers(0, 1 << 63, 200)}
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in family | lone]
    fps = spark.createDataFrame(rows, "fp long").withColumn("rep", F.col("fp"))
    got = {r.fp: r.component for r in simhash.classes(fps).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in family]
    assert len({got[x] for x in signed}) == 1 and len(got) == len(rows)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901), (7, 7), (None, 3)], "a long, b long")
    got = {r.v: r.root for r in components.components(edges).collect()}
    assert {got[k] for k in range(201)} == {0} and got[900] == got[901] == 900


def test_sliding_min_and_rows():
    x = np.array([5, 3, 9, 1, 7, 2], np.uint64)
    assert words.sliding_min(x, 4).tolist() == [1, 1, 1] and len(words.sliding_min(x, 9)) == 0
    assert list(words.chunks(np.array([0, 5, 5, 30, 31]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_token_counts_of_a_tokenizer_that_keeps_spaces(spark):
    """Texts that differ in white space only have counts of their own where the tokenizer keeps it."""
    import uuid

    import public_tokenizers
    from tokenizers import Tokenizer

    from claimtext.llm import tokens
    from claimtext.session import ensure_checkpoint_dir
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    assert not tokens.splits_at_space(definition)
    texts = ["a b", "a  b", "a\n\n b", " a b", "a b", None, "", "   "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    cache = f"{ensure_checkpoint_dir(spark)}/spaces-{uuid.uuid4().hex}"
    library = Tokenizer.from_str(definition)
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for _ in range(2):  # the second time from the cache
        got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, definition, cache).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert len(set(want[:3])) > 1 and spark.read.parquet(cache).count() == 6
