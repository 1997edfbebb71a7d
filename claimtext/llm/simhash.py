"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

``fingerprints``: lower-case A-Z, words are runs without ASCII white space,
shingles are ``shingle`` consecutive words joined by one space, repeats
included; a bit is 1 if it is set in over half of the shingles' XXH64 values
(UTF-8, seed 42).  A text of fewer words is one shingle; a text without words
(null and empty ones too) has fingerprint zero.

``links`` works on distinct fingerprints only.  The 64 bits are cut into
``BLOCKS`` blocks; two fingerprints within ``max_bits`` differ in at most
``max_bits`` blocks, so they agree on ``BLOCKS - max_bits`` whole blocks.
Every choice of so many blocks is one table with its agreed bits as key:
for 4 bits 35 tables of 27 to 28 bits.  The fingerprints of one key are
compared where they meet, and only a spanning forest of the close pairs
leaves the task.  A hot key holds 8 bytes for each distinct fingerprint.

Defined results: equal fingerprints are one class, so copies and repeated
rows never make pairs.  Rows with a null id link like any other; a class
whose ids are all null has a null component id.  An empty table gives no
rows.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import checkpointed, fresh, quoted, without
from claimtext.llm.components import components
from claimtext.llm.words import BY_SPACE, LOWER, Words, chunks, text_bytes

BLOCKS = 7
SEED = 42


def _fingerprints_of(column, shingle: int) -> np.ndarray:
    data, offsets = text_bytes(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i, j in chunks(offsets):
        words = Words(data, offsets[i:j + 1], BY_SPACE, LOWER)
        # the shingles of a row start at its first words but the last shingle - 1
        number = np.where(words.count > 0, np.maximum(words.count - shingle + 1, 1), 0)
        rows = np.flatnonzero(number)
        if not len(rows):
            continue
        number = number[rows]
        ends = np.cumsum(number)
        begin = np.arange(ends[-1]) + np.repeat(words.first[rows] - (ends - number), number)
        last = np.minimum(begin + shingle, np.repeat(words.first[rows + 1], number)) - 1
        text = words.text.tobytes()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in
                              zip(words.start[begin].tolist(), words.end[last].tolist())), np.uint64, len(begin))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, ends - number, axis=0, dtype=np.int32)
        fp = np.packbits(2 * ones > number[:, None], axis=1).view(">u8").reshape(-1)
        out[i + rows] = fp.astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", name: str = "fp") -> DataFrame:
    """docs without its text column and with the fingerprint as a signed long."""
    rest = without(docs, text, name)
    given = rest.columns
    carried = docs.select(*[quoted(c) for c in given], quoted(text).cast("string").alias(fresh(rest, "text")[0]))
    schema = rest.withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _fingerprints_of(batch.column(len(given)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*given, name])

    return carried.mapInArrow(run, schema)


def _masks(max_bits: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks that must agree."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(each, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Edges of a spanning forest of the pairs within max_bits; memory linear in the group."""
    left, right = [], []
    rest, front = fps[1:], [fps[0]]
    while len(rest):
        if not front:
            front, rest = [rest[0]], rest[1:]
            continue
        node = front.pop()
        close = np.bitwise_count(rest ^ node) <= max_bits
        if close.any():
            found = rest[close]
            left.extend([node] * len(found))
            right.extend(found)
            front.extend(found)
            rest = rest[~close]
    return left, right


def links(fps: DataFrame, max_bits: int = 4, name: str = "fp") -> DataFrame:
    """(a, b): for the distinct fingerprints of fps a forest for each key of the close pairs."""
    masks = _masks(max_bits, max(BLOCKS, max_bits + 1))
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col(name).bitwiseAND(F.lit(_signed(m))).alias("k"))
                       for i, m in enumerate(masks)])
    dealt = (fps.select(F.col(name).alias("fp"), F.explode(tables).alias("b"))
             .select("b.t", "b.k", "fp").repartition("t", "k").sortWithinPartitions("t", "k", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2))]
            if kept is not None:
                new = [np.concatenate(x) for x in zip(kept, new)]
            t, k, fp = new
            # the last key may go on in the next batch
            end = len(t) - 1
            change = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            cut = int(change[-1]) if len(change) else 0
            kept = [x[cut:] for x in new] if end >= 0 else None
            if cut:
                yield _close(t[:cut], k[:cut], fp[:cut], max_bits)
        if kept is not None and len(kept[0]):
            yield _close(*kept, max_bits)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _close(t: np.ndarray, k: np.ndarray, fp: np.ndarray, max_bits: int) -> pa.RecordBatch:
    fp = fp.view(np.uint64)
    edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]), True])
    size = np.diff(edge)
    left, right = [], []
    for n in range(2, 9):  # small groups: all their pairs, all groups of a size at once
        group = edge[:-1][size == n]
        for i, j in combinations(range(n), 2):
            a, b = fp[group + i], fp[group + j]
            near = np.bitwise_count(a ^ b) <= max_bits
            left.append(a[near])
            right.append(b[near])
    for g in np.flatnonzero(size > 8):
        a, b = _forest(fp[edge[g]:edge[g + 1]], max_bits)
        left.append(np.array(a, np.uint64))
        right.append(np.array(b, np.uint64))
    a = np.concatenate(left).view(np.int64) if left else np.zeros(0, np.int64)
    b = np.concatenate(right).view(np.int64) if right else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def classes(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(fp, component): fps has fp and a representative rep; component is the smallest rep reachable."""
    fps = checkpointed(fps.select("fp", "rep"))
    roots = components(links(fps, max_bits))
    named = fps.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left")
    linked = named.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("least"))
    return (named.join(smallest, "root", "left")
            .select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row for each row of docs: its id, fingerprint (16 hex digits) and component_id."""
    fp = checkpointed(fingerprints(docs.select(quoted(id).alias("id"), quoted(text).alias("text")), shingle))
    groups = classes(fp.groupBy("fp").agg(F.min("id").alias("rep")), max_bits)
    return fp.join(groups, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids last).

    Rows that repeat this id and its fingerprint are ties: the smallest by the
    other columns, in their order, stays.
    """
    fp, key, none, rest, s_fp, s_key = fresh(docs, "fp", "key", "none", "rest", "s_fp", "s_key")
    others = [c for c in docs.columns if c != id]
    copy = docs.select("*", quoted(text).alias(rest))
    marked = fingerprints(copy, shingle, rest, fp)
    rep = F.struct(quoted(id).isNull().alias("none"), quoted(id).alias("id"), F.col(fp).alias("own"))
    ids = fingerprints(docs.select(quoted(id), quoted(text).alias(rest)), shingle, rest, fp)
    groups = classes(ids.groupBy(F.col(fp).alias("fp")).agg(F.min(rep).alias("rep")), max_bits)
    stay = groups.select(F.col("component.own").alias(fp), F.col("component.id").cast("string").alias(key)).distinct()
    keyed = marked.select("*", quoted(id).cast("string").alias(key))
    if others:
        least = F.min(F.struct(*[quoted(c) for c in others])).alias(rest)
        alone = keyed.groupBy(fp, key).agg(F.first(quoted(id)).alias(none), least)
        back = [F.col(none).alias(id) if c == id else F.col(f"{rest}.`{c}`").alias(c) for c in docs.columns]
    else:
        alone, back = keyed.dropDuplicates([fp, key]), [quoted(id)]
    kept = alone.join(stay.withColumnsRenamed({fp: s_fp, key: s_key}),
                      (F.col(fp) == F.col(s_fp)) & F.col(key).eqNullSafe(F.col(s_key)), "left_semi")
    return kept.select(*back)


def expression_of(value: str) -> Column:
    """The fingerprint (16 hex digits) as the signed long that the operators use."""
    return F.conv(F.col(value), 16, -10).cast("long")
