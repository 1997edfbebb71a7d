"""Tables with columns named like the operators' own, repeated rows and nulls in every column."""

import uuid
from collections import Counter

from pyspark.sql import functions as F

from claimtext.llm import language, lines, mixing, quotes, sharding, substrings, tokens
from claimtext.session import ensure_checkpoint_dir

ROWS = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (2, None, None, None), (None, "", "t", 2), (3, "a b c\n> d", "s", 3)]


def clashing(spark, *names):
    """ROWS with each name as a further column."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, extra int")
    return df.select("*", *[F.lit("old").alias(n) for n in names])


def kept(out, new):
    """Rows of the given columns; a result column has no old value."""
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    assert not any(r[n] == "old" for r in got for n in new)
    return Counter((r.doc_id, r.text, r.source, r.extra) for r in got)


def test_clashing_names(spark):
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    cache = f"{ensure_checkpoint_dir(spark)}/names-{uuid.uuid4().hex}"
    want = Counter(ROWS)
    new = ["n_bytes", "n_tokens", "over_limit"]
    assert kept(tokens.count_tokens(clashing(spark, *new, "digest", "tokenizer"), definition, cache), new) == want
    new = ["lang_pred", "score", "spans"]
    learnt = spark.createDataFrame([("the cat", "en"), ("le chat", "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    assert kept(language.identify(clashing(spark, *new, "lang"), language.fit(learnt)), new) == want
    new = ["kept_text", "n_words", "n_removed"]
    assert kept(substrings.dedup(clashing(spark, *new, "id", "tag", "spans", "start")), new) == want
    new = ["kept_text", "n_lines", "n_chunks"]
    assert kept(lines.dedup(clashing(spark, *new, "hash", "chunk")), new) == want
    new = ["shard", "slot"]
    assert kept(sharding.shard(clashing(spark, *new, "cell", "rank")), new) == want
    new = ["n_tokens", "weight", "block", "place"]
    mixed = kept(mixing.mix(clashing(spark, *new, "rows", "tokens", "share")), new)
    assert set(mixed) == set(want) and all(want[r] <= n <= 2 * want[r] for r, n in mixed.items())


def test_clashing_names_of_messages(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, None, "> hello there\nyes"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.conversations(df.select("*", *[F.lit("old").alias(n) for n in ("parent", "body", "thread", "level", "hash")]))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(set(out.columns)) == len(out.columns) and len(got) == 3
    assert got[1, 1].parent == 0 and got[1, 1].body == "yes" and got[1, 1].hash == "old"
