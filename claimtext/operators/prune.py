"""Exact top k without scoring every pair: bounds, a threshold, frequent terms last.

``Pruner.candidates`` gives the scores (query_id, doc_id, score) of a set of pairs
that holds each query's k best documents, so ``retrieve.top_k`` ranks it to
the same rows as the scores of all pairs:

1. each term has its document frequency and largest weight (map-side partial
   aggregate over the postings); the ``HEAD`` most frequent terms are the head;
2. each document has an array of its weights of the head terms, by rank, so
   a head term is read from it without a join;
3. a query's rarest terms, until they reach ``PROBE`` * k postings, are scored
   first; the k best of these documents give a threshold that the true k-th
   score cannot be under: their sums so far with their head terms;
4. head terms are put off, cheapest bound for each posting first, while what
   they could add together stays under the threshold: a document that holds
   only such terms cannot rank.  The other terms are joined to the postings;
5. a pair goes on if its sum and what the terms put off could still add
   (the smaller of their largest weights and the rest of both norms) reach
   the threshold; this is tested right at the aggregate, before any exchange;
6. terms put off are read from the documents' arrays for these pairs only.

A term with more than ``BLOCK`` postings is dealt into blocks of documents and
a query's weight goes to each block, so that no join key holds more than about
that many postings.  The block grows with the postings, so there are at most
``HOT_TERMS`` such terms: that table is broadcast, and so is the head.

The documents of a fitted model stand in segments (``TfidfModel.index``); there
the same steps are taken for each segment by itself, in the task that holds it
(``Segment``): bounds, threshold, terms put off and survivors are those of its
own documents, a term put off is looked up in its postings, so each document
needs no array, and neither postings nor pairs are shuffled.  A model of tables
(``open_model``) goes the way above, over rows.

Defined results: a query with fewer than k documents that share a probed term
has no threshold, and all its pairs are scored.  Rows that repeat a doc_id or a
query_id add up, as in ``retrieve.score``.  Empty tables give no rows.
"""

from __future__ import annotations

import sys
from functools import cached_property

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtext.functions import text as TX
from claimtext.operators import blocks as BL
from claimtext.session import ensure_checkpoint_dir, saved

PROBE = 400        # postings of a query's rare terms, for each of the k, that the threshold comes from
HEAD = 256         # most frequent terms, whose weights each document has as one array (8 bytes each)
BLOCK = 1 << 20    # postings of one term that meet in one join key
HOT_TERMS = 4096   # terms with more than a block of postings, at most
MARGIN = 4e-6      # scores are ranked on six digits, sums of doubles differ in the last ones

# Workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def merged(weights: DataFrame) -> DataFrame:
    """(doc_id, norm2, term, dw): repeated rows added up; no exchange where the weights are partitioned by document."""
    once = weights.groupBy("doc_id", "term").agg(F.sum("weight").alias("dw"))
    return once.select("doc_id", F.sum(F.col("dw") * F.col("dw")).over(Window.partitionBy("doc_id")).alias("norm2"), "term", "dw")


def term_bounds(postings: DataFrame) -> DataFrame:
    """(term, df, most): documents of a term and the largest weight it has in one."""
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("dw").alias("most"))


def hot_blocks(bounds: DataFrame, block: int = BLOCK, hot_terms: int = HOT_TERMS) -> DataFrame | None:
    """(term, blocks) of the terms with more than a block of postings, at most ``hot_terms``; None if there are none."""
    total = bounds.agg(F.sum("df")).first()[0] or 0
    size = max(block, -(-total // hot_terms))
    hot = bounds.where(F.col("df") > size).select("term", F.ceil(F.col("df") / size).cast("int").alias("blocks"))
    return None if hot.isEmpty() else hot


def meet(query_terms: DataFrame, postings: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Query terms with the postings of their term, block by block for hot terms."""
    if hot is None:
        return query_terms.join(postings, "term")
    few = F.broadcast(hot)  # at most HOT_TERMS rows
    dealt = postings.join(few, "term", "left").withColumn(
        "_block", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    copies = query_terms.join(few, "term", "left").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return copies.join(dealt, ["term", "_block"]).drop("_block")


def head_terms(bounds: DataFrame, head: int = HEAD) -> DataFrame:
    """(term, rank from 1) of the most frequent terms, at most ``head``."""
    best = bounds.orderBy(F.desc("df"), "term").limit(head)
    return best.select("term", F.row_number().over(Window.orderBy(F.desc("df"), "term")).alias("rank"))


def head_weights(postings: DataFrame, ranked: DataFrame, head: int = HEAD) -> DataFrame:
    """(doc_id, head array<double>): a document's weights of the head terms, by rank; none for a document without one."""
    of_doc = (postings.join(F.broadcast(ranked), "term").groupBy("doc_id")
              .agg(F.collect_list(F.struct("rank", "dw")).alias("_m")))
    ranks = F.sequence(F.lit(1), F.lit(head))
    filled = TX.let(F.map_from_entries("_m"), lambda m: F.transform(  # bound once, not built anew for each rank
        ranks, lambda r: F.coalesce(F.try_element_at(m, r), F.lit(0.0))))
    return of_doc.select("doc_id", filled.alias("head"))


def complete(pairs: DataFrame, put_off: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the sums p of pairs with the head terms that were put off.

    ``put_off`` has a query's head terms as (query_id, rank, qw).  The query's
    short list joins the pairs first; the array of a document is dropped where
    it was read, so neither is shuffled further.
    """
    lists = put_off.groupBy("query_id").agg(F.collect_list(F.struct("rank", "qw")).alias("_terms"))
    own = heads.select(F.col("doc_id").alias("_doc"), "head")
    added = F.aggregate("_terms", F.lit(0.0), lambda s, t: s + t["qw"] * F.element_at("head", t["rank"]))
    return (pairs.join(lists, "query_id", "left")
            .join(own, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
            .select("query_id", "doc_id", (F.col("p") + F.coalesce(added, F.lit(0.0))).alias("score")))


def thresholds(terms: DataFrame, postings: DataFrame, heads: DataFrame, hot: DataFrame | None, k: int,
               probe: int = PROBE) -> DataFrame:
    """(query_id, theta): a score that k documents of the query reach; no row where the rare terms find fewer."""
    rare = Window.partitionBy("query_id").orderBy("df", "term")
    before = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1))
    marked = terms.withColumn("_first", F.coalesce(before, F.lit(0)) < probe * k)
    sums = (meet(marked.where("_first").select("query_id", "term", "qw"), postings, hot)
            .groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("p")))
    best = Window.partitionBy("query_id").orderBy(F.desc("p"), F.desc("doc_id"))
    probed = sums.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")
    full = complete(probed, marked.where("not _first and rank is not null"), heads)
    return (full.groupBy("query_id").agg(F.min("score").alias("theta"), F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") == k).drop("_n"))


def split_terms(terms: DataFrame, theta: DataFrame, longest: float) -> DataFrame:
    """terms with theta, whether each is ``late``, and late_ub and late_sq, the bounds of its query's late terms."""
    cheap = Window.partitionBy("query_id").orderBy(F.col("rank").isNull(), F.col("ub") / F.col("df"), "term")
    so_far = cheap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("query_id")
    sq = F.col("qw") * F.col("qw")
    reach = F.least(F.sum("ub").over(so_far), F.sqrt(F.sum(sq).over(so_far)) * F.lit(longest))
    marked = (terms.join(theta, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
              .withColumn("late", F.col("rank").isNotNull() & (reach < F.col("theta") - MARGIN)))
    late = F.col("late").cast("double")
    return (marked.withColumn("late_ub", F.sum(late * F.col("ub")).over(whole))
            .withColumn("late_sq", F.sum(late * sq).over(whole)))


def survivors(split: DataFrame, postings: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(query_id, doc_id, p): pairs whose early terms, and what the late ones can add, reach the threshold."""
    early = split.where("not late").select("query_id", "term", "qw", "theta", "late_ub", "late_sq")
    sums = (meet(early, postings, hot).groupBy("query_id", "doc_id")
            .agg(F.sum(F.col("qw") * F.col("dw")).alias("p"), F.max("norm2").alias("_n"),
                 F.sum(F.col("dw") * F.col("dw")).alias("_s"),
                 *[F.max(c).alias(c) for c in ("theta", "late_ub", "late_sq")]))
    rest = F.sqrt(F.col("late_sq") * F.greatest(F.col("_n") - F.col("_s"), F.lit(0.0)))
    return sums.where(F.col("p") + F.least("late_ub", rest) >= F.col("theta") - MARGIN).select("query_id", "doc_id", "p")


class Segment(BL._Block):
    """The documents of a segment, scored as far as they can be among its k best."""

    probe = PROBE

    @cached_property
    def most(self) -> np.ndarray:
        """The largest weight of each term."""
        return np.maximum.reduceat(self.weights, self.starts) if len(self.starts) else np.zeros(0)

    @cached_property
    def norm2(self) -> np.ndarray:
        return np.bincount(self.docs, self.weights * self.weights, len(self.ids))

    @cached_property
    def repeats(self) -> bool:
        """Whether a document has a term twice, as rows that share an id do."""
        again = np.diff(self.docs, prepend=-1) == 0
        again[self.starts] = False
        return bool(again.any())

    def looked_up(self, codes: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """What these terms add to documents, from the documents' places in the postings of each term."""
        added = np.zeros(len(places))
        for code, weight in zip(codes, weights):
            start = self.starts[code]
            docs = self.docs[start:start + self.sizes[code]]
            at = np.minimum(np.searchsorted(docs, places), len(docs) - 1)
            added += np.where(docs[at] == places, self.weights[start + at], 0.0) * weight
        return added

    def threshold(self, codes: np.ndarray, weights: np.ndarray, k: int) -> float | None:
        """A score that k documents reach, from the rarest terms; None where they find fewer."""
        rare = np.lexsort((codes, self.sizes[codes]))
        sizes = self.sizes[codes[rare]]
        probed = np.cumsum(sizes) - sizes < self.probe * k
        places, sums = self.sums(codes[rare[probed]], weights[rare[probed]])
        if len(places) < k:
            return None
        best = np.argpartition(sums, len(sums) - k)[-k:]
        rest = rare[~probed]
        return float((sums[best] + self.looked_up(codes[rest], weights[rest], places[best])).min())

    def late(self, codes: np.ndarray, weights: np.ndarray, theta: float) -> np.ndarray:
        """The terms that together cannot reach the threshold, cheapest bound for each posting first."""
        bounds = weights * self.most[codes]
        cheap = np.lexsort((codes, bounds / self.sizes[codes]))
        reach = np.minimum(np.cumsum(bounds[cheap]), np.sqrt(np.cumsum(weights[cheap] ** 2)) * self.norm2.max() ** 0.5)
        out = np.zeros(len(codes), bool)
        out[cheap[:np.searchsorted(reach, theta - MARGIN)]] = True
        return out

    def survivors(self, codes: np.ndarray, weights: np.ndarray, late: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the documents whose early terms, and what the late ones can add, reach the threshold."""
        places, sums = self.sums(codes[~late], weights[~late])
        near = sums + (weights[late] * self.most[codes[late]]).sum() >= theta - MARGIN
        places, sums = places[near], sums[near]
        near = sums + np.sqrt((weights[late] ** 2).sum() * self.norm2[places]) >= theta - MARGIN
        return places[near], sums[near]

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        theta = None if self.repeats else self.threshold(codes, weights, k)
        if theta is None:
            return super().best(codes, weights, k)
        late = self.late(codes, weights, theta)
        places, sums = self.survivors(codes, weights, late, theta)
        return self.first(places, sums + self.looked_up(codes[late], weights[late], places), k)


class Pruner:
    """A model's postings, bounds, head and hot terms, each made once, where asked for, for any number of query sets."""

    def __init__(self, model, block: int = BLOCK, hot_terms: int = HOT_TERMS, head: int = HEAD):
        ensure_checkpoint_dir(model.weights.sparkSession)
        self.model, self.block, self.hot_terms, self.head = model, block, hot_terms, head

    @cached_property
    def postings(self) -> DataFrame:
        return saved(merged(self.model.weights))

    @cached_property
    def _bounds(self) -> DataFrame:
        return saved(term_bounds(self.postings))

    @cached_property
    def hot(self) -> DataFrame | None:
        return hot_blocks(self._bounds, self.block, self.hot_terms)

    @cached_property
    def _ranked(self) -> DataFrame:
        return saved(head_terms(self._bounds, self.head))

    @cached_property
    def heads(self) -> DataFrame:
        return saved(head_weights(self.postings, self._ranked, self.head))

    @cached_property
    def bounds(self) -> DataFrame:
        return self._bounds.join(F.broadcast(self._ranked), "term", "left")

    @cached_property
    def longest(self) -> float:
        return (self.postings.agg(F.max("norm2")).first()[0] or 0.0) ** 0.5

    def split(self, query_weights: DataFrame, k: int, probe: int = PROBE) -> DataFrame:
        """The query terms with their bounds, thresholds and whether they come late; written once."""
        terms = (query_weights.groupBy("query_id", "term").agg(F.sum("weight").alias("qw")).join(self.bounds, "term")
                 .select("query_id", "term", "qw", "df", "rank", (F.col("qw") * F.col("most")).alias("ub")).checkpoint(eager=True))
        theta = thresholds(terms, self.postings, self.heads, self.hot, k, probe)
        return split_terms(terms, theta, self.longest).checkpoint(eager=True)

    def candidates(self, query_weights: DataFrame, k: int, probe: int = PROBE) -> DataFrame:
        """(query_id, doc_id, score) of pairs that hold each query's k best documents."""
        index = self.model.index()
        if index is not None:
            kind = type("Segment", (Segment,), {"probe": probe})
            return BL.best(self.model.weights, query_weights, self.model.n_postings, k, index, self.model.docs.count(), kind)
        split = self.split(query_weights, k, probe)
        return complete(survivors(split, self.postings, self.hot), split.where("late"), self.heads)


def candidates(model, query_weights: DataFrame, k: int, probe: int = PROBE, block: int = BLOCK) -> DataFrame:
    """Scores of the pairs that can be among the k best, in place of ``retrieve.score``."""
    return Pruner(model, block).candidates(query_weights, k, probe)
