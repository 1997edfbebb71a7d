"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares p of the tokens (words and one end mark a row) become weights
p**t / sum(p**t).  The exponent t is bisected: either to the largest t whose
weights still have the target entropy, or to the smallest t for which no
source is repeated more than ``max_repeats`` times.  One aggregation over the
source totals evaluates the 15 inner points of a bracket, that is four
halvings; no source list reaches the driver.  The bracket is [0, 1], between
equal weights and the sources' own; a target entropy below the sources' own
needs t > 1, for which its upper end is doubled.  What no exponent meets is an
error: an entropy above that of equal weights or below that of the largest
sources alone, or a budget that repeats even the sources' own shares more
often than the limit.

The budget is the tokens of the mixed stream.  Without one it is the least
that shows every row once; then the mix repeats rows of small sources and
drops none.  A source's quota is its weight of the budget.  Its rows are
permuted by a hash, anew for each epoch, and laid end to end until the quota
is full.  Blocks cut all quotas alike, so each block of about
``block_tokens`` has the weights; ``place`` orders the rows of a block.

Places need running sums of tokens.  A source is split into cells by the
permutation's hash, with at most about max(``CELL_ROWS``, square root of its
rows) rows each; sums run over cells, then inside each cell, so a source with
a third of all rows is many tasks.  Only DataFrame functions are used.

Defined results: a null source is a source of its own.  A null or empty text
has one token, so no source is empty.  Repeated rows are rows of their own.
A single source, or sources of one size, get their shares.  An empty table
gives no rows.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtext.llm.common import NOT_SPACE, checkpointed, fresh, quoted, without

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
CELL_ROWS = 500
INNER = 15  # points of a bracket that one job evaluates: four bisection steps
JOBS = 8
SEED = 11
SLACK = 1e-9  # of shares, entropies and repeats
MOST = 1e6  # largest exponent that is tried
BROADCAST_SOURCES = 10_000


def n_tokens(text: str) -> Column:
    words = F.regexp_count(F.coalesce(quoted(text).cast("string"), F.lit("")), F.lit(f"{NOT_SPACE}+"))
    return words.cast("long") + 1


def source_totals(docs: DataFrame, source: str, text: str) -> DataFrame:
    """(source, rows, tokens, share), checkpointed: a row for each source."""
    totals = docs.groupBy(quoted(source).alias("source")).agg(
        F.count("*").alias("rows"), F.sum(n_tokens(text)).alias("tokens"))
    totals = checkpointed(totals)
    whole = totals.agg(F.sum("tokens")).first()[0]
    return totals.withColumn("share", F.col("tokens") / F.lit(float(whole or 1)))


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
             budget: int | None = None) -> float:
    """The exponent that meets the target entropy (in nats) or else the repetition limit."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give either max_repeats or entropy")
    low, high = 0.0, 1.0
    log = F.log("share")
    ends = totals.agg(F.sum("tokens").alias("whole"), F.count("*").alias("n"), F.max("share").alias("top"),
                      F.sum(-F.col("share") * log).alias("own")).first()
    if ends.whole is None:
        return 1.0
    if entropy is None and (1 if budget is None else budget / ends.whole) > max_repeats * (1 + SLACK):
        raise ValueError(f"{budget or ends.whole} of {ends.whole} tokens repeat some more than {max_repeats} times under any weights")
    if entropy is not None:
        largest = totals.where(F.col("share") >= ends.top * (1 - SLACK)).count()  # what is left as t grows
        if not math.log(largest) - SLACK <= entropy <= math.log(ends.n) + SLACK:
            raise ValueError(f"entropy {entropy} is not between {math.log(largest)} and {math.log(ends.n)}")
        if largest == ends.n:  # all weights are equal under any exponent
            return 1.0
        top = ends.top  # shares relative to the largest keep the powers of a large exponent apart from zero
        if entropy < ends.own:
            low = 1.0
            while True:
                high *= 2
                power = F.exp(F.lit(high) * F.log(F.col("share") / F.lit(top)))
                r = totals.agg(F.sum(power).alias("z"), F.sum(power * F.log(F.col("share") / F.lit(top))).alias("e")).first()
                if math.log(r.z) - high * r.e / r.z <= entropy or high > MOST:
                    break
                low = high
        log = F.log(F.col("share") / F.lit(top))
    for _ in range(JOBS):
        points = [low + (high - low) * k / (INNER + 1) for k in range(1, INNER + 1)]
        sums = []
        for k, t in enumerate(points):
            power = F.exp(F.lit(t) * log)
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * log).alias(f"e{k}"),
                     F.max(F.exp(F.lit(t - 1) * log)).alias(f"m{k}"), F.min(F.exp(F.lit(t - 1) * log)).alias(f"l{k}")]
        r = totals.agg(*sums, F.sum("tokens").alias("whole")).first()
        if entropy is not None:
            met = [math.log(r[f"z{k}"]) - t * r[f"e{k}"] / r[f"z{k}"] >= entropy for k, t in enumerate(points)]
            below = [t for t, ok in zip(points, met) if ok]  # entropy falls with t
            above = [t for t, ok in zip(points, met) if not ok]
        else:
            most = [r[f"m{k}"] / r[f"l{k}"] if budget is None else budget / r.whole * r[f"m{k}"] / r[f"z{k}"]
                    for k in range(INNER)]
            met = [x <= max_repeats for x in most]
            below = [t for t, ok in zip(points, met) if not ok]  # repetition falls with t
            above = [t for t, ok in zip(points, met) if ok]
        low, high = max([low, *below]), min([high, *above])
    return round(low if entropy is not None else high, 9)


def quotas(totals: DataFrame, t: float, budget: int | None = None) -> DataFrame:
    """totals with weight, quota (tokens of the mixed stream), epochs and cells, checkpointed."""
    top = totals.agg(F.max("share")).first()[0] if t > 1 else None  # large powers relative to the largest, else all vanish
    power = totals.withColumn("power", F.exp(F.lit(t) * F.log(F.col("share") / F.lit(top) if top else F.col("share"))))
    r = power.agg(F.sum("power").alias("z"), F.max(F.try_divide("tokens", "power")).alias("cover")).first()
    weighed = power.withColumn("weight", F.col("power") / F.lit(r.z or 1.0))
    quota = (F.greatest(F.round(F.col("power") * F.lit(r.cover or 0.0)).cast("long"), F.col("tokens")) if budget is None
             else F.round(F.col("weight") * F.lit(budget)).cast("long"))
    return checkpointed(weighed.withColumn("quota", quota).select(
        "source", "tokens", "weight", "quota", F.ceil(F.col("quota") / F.col("tokens")).cast("int").alias("epochs"),
        F.ceil(F.col("rows") / F.greatest(F.lit(float(CELL_ROWS)), F.sqrt("rows"))).cast("long").alias("cells")))


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None,
        budget: int | None = None, block_tokens: int = BLOCK_TOKENS, source: str = "source", text: str = "text",
        seed: int = SEED) -> DataFrame:
    """docs, repeated by epochs, with n_tokens, weight, epoch, start (token of the source's stream), block, place."""
    docs = without(docs, *[c for c in ("n_tokens", "weight", "epoch", "start", "block", "place")
                           if c not in (source, text)])
    totals = source_totals(docs, source, text)
    plan = quotas(totals, exponent(totals, max_repeats, entropy, budget), budget)
    size = plan.agg(F.sum("quota").alias("quota"), F.count("*").alias("n")).first()
    blocks = max(1, -(-(size.quota or 0) // block_tokens))
    names = "src", "tokens", "weight", "quota", "epochs", "cells", "row", "epoch", "hash", "cell", "before", "own", "num"
    s, tokens, weight, quota, epochs, cells, row, epoch, hash_, cell, before, own, num = fresh(docs, *names)
    plan = plan.select(F.col("source").alias(s), F.col("tokens").alias(tokens), F.col("weight").alias(weight),
                       F.col("quota").alias(quota), F.col("epochs").alias(epochs), F.col("cells").alias(cells))
    if size.n <= BROADCAST_SOURCES:  # else Spark joins by source and splits what is skewed
        plan = F.broadcast(plan)
    hashed = [quoted(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.select("*", n_tokens(text).alias(own), F.xxhash64(*hashed).alias(row))
    dealt = rows.join(plan, quoted(source).eqNullSafe(F.col(s)))
    dealt = dealt.where(F.col(epochs) > 0).withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(epochs) - 1)))
    dealt = dealt.withColumn(hash_, F.xxhash64(F.lit(seed), epoch, row))
    part = F.shiftrightunsigned(hash_, 32) / F.lit(float(1 << 32))
    dealt = dealt.withColumn(cell, F.floor(part * F.col(cells)).cast("long"))
    key = [s, epoch, cell]
    in_cell = Window.partitionBy(*key).orderBy(hash_).rowsBetween(Window.unboundedPreceding, -1)
    over = dealt.repartition(*key).withColumn(num, F.coalesce(F.sum(own).over(in_cell), F.lit(0)))
    # the same hashes once more, without the texts, for the sums of the cells
    sums = dealt.groupBy(*key).agg(F.sum(own).alias("n"))
    cells_before = Window.partitionBy(s, epoch).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"{k}k") for k in key],
                       F.coalesce(F.sum("n").over(cells_before), F.lit(0)).alias(before))
    on = [F.col(k).eqNullSafe(F.col(f"{k}k")) for k in key]
    placed = over.join(sums, on).withColumn(before, F.col(epoch) * F.col(tokens) + F.col(before) + F.col(num))
    kept = placed.where(F.col(before) < F.col(quota)) if budget is not None else placed.where(
        (F.col(epoch) == 0) | (F.col(before) < F.col(quota)))
    block = F.least(F.floor(F.col(before) / F.col(quota) * blocks), F.lit(blocks - 1)).cast("long")
    return kept.select(*[quoted(c) for c in docs.columns], F.col(own).alias("n_tokens"), F.col(weight).alias("weight"),
                       F.col(epoch).alias("epoch"), F.col(before).alias("start"), block.alias("block"),
                       F.xxhash64(F.lit(seed), block, F.col(hash_)).alias("place"))
