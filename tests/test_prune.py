"""The pruned top k against a dense ranking, and what its bounds and blocks leave."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimtext.operators import prune as PR
from claimtext.operators import retrieve as RT
from tests.test_retrieve import CORPUS, QUERIES, dense


def ranked(spark, corpus, queries, k, **settings):
    c = spark.createDataFrame(corpus, "doc_id long, text string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    m = RT.fit(c)
    scores = PR.candidates(m, RT.transform(m, q), k, **settings)
    return RT.top_k(m, scores, q.select("query_id"), k).collect()


def check(got, corpus, queries, k):
    want = dense(corpus, queries)
    for qid, ranking in want.items():
        rows = sorted([r for r in got if r["query_id"] == qid], key=lambda r: r["rank"])
        assert [r["doc_id"] for r in rows] == [i for _, i in ranking[:k]]
        assert all(abs(r["score"] - s) < 1e-6 for r, (s, _) in zip(rows, ranking[:k]))


@pytest.mark.parametrize("block", [1, 2, PR.BLOCK])
def test_pruned_matches_dense(spark, block):
    check(ranked(spark, CORPUS, QUERIES, 2, block=block, probe=1), CORPUS, QUERIES, 2)


# one frequent word in every document, rare words in few
RARE = [f"rare{c}" for c in "abcdef"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(RARE + ["often", "mostly"]), max_size=5), min_size=1, max_size=14),
       st.lists(st.lists(st.sampled_from(RARE + ["often", "mostly", "unknown"]), max_size=4), min_size=1, max_size=4),
       st.integers(min_value=1, max_value=3))
def test_random_pruned_matches_dense(spark, docs, queries, k):
    corpus = [(i, " ".join(["often", *d])) for i, d in enumerate(docs)]
    qs = [(100 + j, " ".join(q)) for j, q in enumerate(queries)]
    check(ranked(spark, corpus, qs, k, block=3, probe=1), corpus, qs, k)


def hot_model(spark, n=400):
    """'often' stands in every document, each of 40 rare words in a few."""
    rows = [(i, "often " + " ".join(["often"] * (i % 3)) + f" rare{i % 40:02d} own{i}") for i in range(n)]
    return rows, RT.fit(spark.createDataFrame(rows, "doc_id long, text string"))


def test_frequent_terms_are_put_off(spark):
    rows, m = hot_model(spark)
    qs = [(j, f"often rare{j:02d}") for j in range(10)]
    q = spark.createDataFrame(qs, "query_id long, text string")
    pruner, qw = PR.Pruner(m), RT.transform(m, q)
    split = pruner.split(qw, 3, probe=1)
    assert {r.term for r in split.where("late").collect()} == {"often"}
    # the documents of the rare word only, not all that hold 'often'
    assert PR.survivors(split, pruner.postings, pruner.hot).count() <= 10 * 10 < RT.score(m, qw).count() == 10 * 400
    check(RT.top_k(m, pruner.candidates(qw, 3, probe=1), q.select("query_id"), 3).collect(), rows, qs, 3)


def test_hot_term_is_dealt_into_blocks(spark):
    """One term in every document: the largest join key stays near the block, and no posting is lost."""
    for n in (400, 800):
        _, m = hot_model(spark, n)
        pruner = PR.Pruner(m, block=100)
        assert [(r.term, r.blocks) for r in pruner.hot.collect()] == [("often", n // 100)]
        terms = spark.createDataFrame([(1, "often", 1.0), (2, "rare00", 1.0)], "query_id long, term string, qw double")
        met = PR.meet(terms, pruner.postings, pruner.hot)
        assert met.where("query_id = 1").count() == n and met.where("query_id = 2").count() == n // 40
        sizes = [r["count"] for r in met.where("term = 'often'").groupBy(
            F.pmod(F.xxhash64("doc_id"), F.lit(n // 100))).count().collect()]
        assert max(sizes) < 160
        assert "_block" in met._jdf.queryExecution().executedPlan().toString()


def test_hot_terms_are_few(spark):
    bounds = spark.createDataFrame([(f"t{i}", 50, 1.0) for i in range(100)], "term string, df long, most double")
    assert PR.hot_blocks(bounds, block=1, hot_terms=10) is None  # a tenth of the postings is the least block
    assert PR.hot_blocks(bounds, block=1, hot_terms=1000).count() == 100


def test_repeated_ids_and_empty_tables(spark):
    c = spark.createDataFrame([(0, "often rare"), (0, "often rare"), (1, "often"), (None, "rare rare")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "often rare"), (1, "rare"), (2, "often")], "query_id long, text string")
    m = RT.fit(c)
    qw = RT.transform(m, q)
    rows = {(r[0], r[1]): r[2] for r in RT.score(m, qw).collect()}
    got = {(r[0], r[1]): r[2] for r in PR.candidates(m, qw, 10).collect()}
    assert got.keys() == rows.keys() and all(abs(got[x] - rows[x]) < 1e-9 for x in rows)
    assert PR.candidates(m, qw.limit(0), 2).collect() == []
    none = RT.fit(c.limit(0))
    assert PR.candidates(none, RT.transform(none, q), 2).collect() == []


def test_segments_are_pruned_without_rows(spark, monkeypatch):
    """A fitted model's segments give the rows of all pairs; no posting is a row, and few documents are scored to the end."""
    from claimtext.operators import segments as SG
    monkeypatch.setattr(SG, "SEGMENT_WORDS", 700)
    rows, m = hot_model(spark)
    qs = [(j, f"often rare{j:02d} own{j}") for j in range(6)] + [(9, "often"), (10, "nothing"), (11, "own3")]
    q = spark.createDataFrame(qs, "query_id long, text string")
    pruner = PR.Pruner(m)
    monkeypatch.setattr(PR, "merged", lambda *a: 1 / 0)
    scores = pruner.candidates(RT.transform(m, q), 3, probe=1)
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()
    check(RT.top_k(m, scores, q.select("query_id"), 3).collect(), rows, qs, 3)
    blocks = [PR.Segment.of(*map(bytes, r), len(rows)) for r in m.index().drop("_seg").collect()]
    assert len(blocks) > 1
    PR.Segment.probe = 1
    try:
        for b in blocks:
            words = {w: i for i, w in enumerate(b.words.to_pylist())}
            import numpy as np
            codes, weights = np.array([words["often"], words["rare00"]]), np.array([0.2, 0.98])
            if b.sizes[codes[1]] < 2:
                continue
            theta = b.threshold(codes, weights, 2)
            late = b.late(codes, weights, theta)
            assert late.tolist() == [True, False]
            places, _ = b.survivors(codes, weights, late, theta)
            assert len(places) <= b.sizes[codes[1]] < len(b.ids) / 10
    finally:
        PR.Segment.probe = PR.PROBE
