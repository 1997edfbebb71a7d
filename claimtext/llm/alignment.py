"""Alignment of two tokenizers over a corpus, each distinct text once.

The texts are shuffled by their whole content and counted, so a text is
tokenised and aligned once however often it stands in the corpus.  Tokenizer
A is a byte-level BPE file of the ``tokenizers`` library and encodes a space
and the text; B is a ``sentencepiece`` model and adds that space itself.  Byte
offsets where a token of A and one of B both end cut the tokens into groups;
the two tokens that end there are linked.  A pair of ids counts its links in
the whole corpus: the links of each distinct text, weighted by its copies.

The counts of the most frequent pairs, at most ``FREQUENT``, are broadcast and
looked up where the links are; the links of the rarer pairs are joined to
their counts by pair.  Measures go back to the rows by the text's SHA-256.
Texts of more than a thousandth of the rows, which are fewer than a thousand,
take a broadcast join, so no copy group meets in one task.

Where one space stands between two characters that are no white space, both
tokenizers always part, which is checked for the given files (others encode
whole texts).  So each distinct unit between such places, mostly a word, is
aligned once for as long as a worker's memo has it, and a text is put together
from its units, a long one piece by piece.

Defined results: null and empty texts, and texts whose tokens of either side do
not spell a space and the text, have no tokens: zeros and ''.  Repeated rows
count as copies.  Result columns replace input columns of the same name.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import checkpointed, fresh, quoted, remove_folder, without
from claimtext.llm.words import chunks, text_bytes
from claimtext.session import ensure_checkpoint_dir

FREQUENT = 1 << 21  # pairs whose counts are broadcast at most: 17 bytes each
HOT = 1000  # a text of more than this part of the rows is joined by broadcast
CHUNK = 1 << 18  # characters that are encoded at once
PIECE = 1 << 17  # characters of a piece of a long text, at least
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
UNITS = 60_000  # units that a worker's memo has at most, before a chunk
ENCODED = 16_384  # units that are encoded at once
LOOKED_UP = 1 << 17  # links whose counts are looked up at once: some 60 bytes each
TOGETHER = 1024  # of them, those that are one text for the tokenizers
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r" \s|\s ")
_ALIGNED = "key string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"


def byte_of_character() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and how a token is written in the text of the groups."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        points = byte_of_character()
        added = {t["content"] for t in json.loads(definition).get("added_tokens", [])}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(points[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.written = ([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"]
                        + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"])
        self.parts = parts_at_space(definition, pieces) and self._keeps_text()
        self.forget()

    def _keeps_text(self) -> bool:
        """Whether B adds one space in front and neither folds characters nor drops spaces."""
        probe = "a  ﬁéé Ａ "
        return b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == b" " + probe.encode()

    def pieces(self, text: str) -> list[str]:
        """The text, or pieces of it that both tokenizers encode as they stand in it."""
        if len(text) <= 2 * PIECE or not self.parts:
            return [text]
        out, start = [], 0
        while cut := _CUT.search(text, start + PIECE):
            out.append(text[start:cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def units(self, text: str) -> list[str]:
        """The text cut at every place where both tokenizers part: mostly words."""
        if not self.parts:
            return [text]
        return _CUT.split(text) if text[:1] == " " or text[-1:] == " " or _WIDE.search(text) else text.split(" ")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; empty where they do not spell it."""
        ids_a = [x.ids for x in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        ids_b = self.b.encode(texts, num_threads=1)
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for k, text in enumerate(texts):
            spelt = b" " + text.encode()
            if not text or spelt != b"".join(map(bytes_a, ids_a[k])) or spelt != b"".join(map(bytes_b, ids_b[k])):
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b

    def groups(self, units: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """n_a, n_b and n_groups of each unit, its groups, each with a last ';', and the links of all, in order."""
        ids_a, ids_b, spelt = [], [], np.zeros(len(units), bool)
        for at, a, b in self._encoded(units):
            spelt[at:at + a[1]] = bool(b)
            ids_a.append(a[0])
            ids_b.append(b)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (ids_a, ids_b))
        # both sides spell the same bytes, so one count of bytes runs over all units
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        last_a, last_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        unit_ends = np.cumsum([1 + len(u.encode()) if ok else 0 for u, ok in zip(units, spelt.tolist())])
        counts = np.stack([np.diff(np.searchsorted(x, unit_ends, "right"), prepend=0) for x in (end_a, end_b, ends)])
        written = np.empty(len(a) + len(b), np.int64)
        code_a, code_b = 2 * a, 2 * (len(self.bytes_a) + b)
        code_a[last_a] += 1
        code_b[last_b] += 1
        written[np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")] = code_a
        written[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = code_b
        bounds, codes, shown = np.cumsum(counts[0] + counts[1]).tolist(), written.tolist(), self.written.__getitem__
        return counts, ["".join(map(shown, codes[i:j])) for i, j in zip([0, *bounds], bounds)], (
            a[last_a] * len(self.bytes_b) + b[last_b])

    def _encoded(self, units: list[str]) -> Iterator[tuple[int, tuple[list[int], int], list[int]]]:
        """(first unit, (ids of A, number of units), ids of B), in order; units are encoded together where they may be."""
        lone = [not self.parts or u[:1].isspace() or u[-1:].isspace() for u in units]
        begins = [k for k in range(len(units)) if k % TOGETHER == 0 or lone[k] or lone[k - 1]]
        texts = [" ".join(units[i:j]) for i, j in zip(begins, [*begins[1:], len(units)])]
        for i, j, a, b in zip(begins, [*begins[1:], len(units)], *self.encode(texts)):
            if a or j == i + 1:
                yield i, (a, j - i), b
            else:  # one of them is not spelt
                for k, x, y in zip(range(i, j), *self.encode(units[i:j])):
                    yield k, (x, 1), y

    def learn(self, units: list[str]) -> None:
        """Align the units that the memo lacks; it is emptied first if it is full."""
        if len(self.memo) > UNITS:
            self.forget()
        new = list({u for u in units if u not in self.memo})
        for k in range(0, len(new), ENCODED):
            part = new[k:k + ENCODED]
            counts, shown, links = self.groups(part)
            self.memo.update(zip(part, range(len(self.shown), len(self.shown) + len(part))))
            self.shown.extend(shown)
            self.counts = np.concatenate([self.counts, counts], axis=1)
            self.links = np.concatenate([self.links, links])
        self.first = np.cumsum(self.counts[2]) - self.counts[2]

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.shown: list[str] = []
        self.counts, self.links, self.first = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """(n_a, n_b, n_groups) of each text, whether it is spelt, its groups with a last ';', all links in order."""
        units = [self.units(t) for t in texts]
        flat = list(chain.from_iterable(units))
        self.learn(flat)
        place = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        bounds = np.cumsum([0, *map(len, units)])
        counts = np.add.reduceat(self.counts[:, place], bounds[:-1], axis=1)
        spelt = np.minimum.reduceat(self.counts[2, place], bounds[:-1]) > 0
        size = self.counts[2, place]
        take = np.repeat(self.first[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        places, at, shown = place.tolist(), bounds.tolist(), self.shown.__getitem__
        return counts, spelt, ["".join(map(shown, places[i:j])) for i, j in zip(at, at[1:])], self.links[take]


def parts_at_space(definition: str, pieces: list[str]) -> bool:
    """Whether no token of either side goes on over a space that stands between other characters."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    words = (d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex")
             and not pre.get("add_prefix_space"))
    return bool(words) and not any("▁" in p.lstrip("▁") for p in pieces)


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(version: str, shared) -> Aligner:
    """One aligner for a worker process and a pair of files."""
    if version not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[version] = Aligner(*shared.value)
    return _ALIGNERS[version]


def _chunks(aligner: Aligner, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of about CHUNK characters together, with the text that each belongs to."""
    pieces, owners, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in aligner.pieces(text):
            if pieces and size + len(piece) > CHUNK:
                yield pieces, owners
                pieces, owners, size = [], [], 0
            pieces.append(piece)
            owners.append(k)
            size += len(piece)
    if pieces:
        yield pieces, owners


def aligned_texts(aligner: Aligner, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray]]:
    """(n_a, n_b, n_groups) of each text, the digest of its groups, and its links."""
    counts = np.zeros((3, len(texts)), np.int64)
    digests: list = [None] * len(texts)
    links: list[list[np.ndarray]] = [[] for _ in texts]
    bad = np.zeros(len(texts), bool)
    for pieces, owners in _chunks(aligner, texts):
        found, spelt, shown, pairs = aligner.align(pieces)
        np.add.at(counts, (slice(None), owners), found)
        np.logical_or.at(bad, owners, ~spelt)
        at = 0
        for k, n, groups in zip(owners, found[2].tolist(), shown):
            links[k].append(pairs[at:at + n])
            at += n
            if digests[k] is None:
                digests[k] = hashlib.sha256(groups[:-1].encode())
            else:
                digests[k].update(b";" + groups[:-1].encode())
    counts[:, bad] = 0
    return (counts, ["" if wrong or d is None else d.hexdigest() for d, wrong in zip(digests, bad)],
            [np.concatenate(x) if x and not wrong else np.zeros(0, np.int64) for x, wrong in zip(links, bad)])


def _ragged(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(x) for x in parts]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                    pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


def distinct_texts(docs: DataFrame, definition: str, model: bytes, text: str) -> DataFrame:
    """Each distinct text's digest, copies, counts, digest of groups and links (A id * size of B + B id)."""
    given = docs.select(quoted(text).cast("string").alias("text")).where("text != ''")
    distinct = given.groupBy("text").agg(F.count("*").alias("copies"))
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))  # two vocabulary files
    version = hashlib.sha256(definition.encode() + model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(version, shared)
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, 4 * CHUNK):
                part = batch.slice(i, j - i)
                texts = part.column(1).to_pylist()
                (n_a, n_b, n_groups), digests, links = aligned_texts(aligner, texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
                     pa.array(digests, pa.string()), _ragged(links)],
                    names=["key", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    return distinct.select(F.sha2("text", 256).alias("key"), "text", "copies").mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each pair in the whole corpus, and whether its B id has none with more."""
    counts = checkpointed(aligned.select(F.explode("links").alias("pair"), "copies")
                          .groupBy("pair").agg(F.sum("copies").alias("n")))
    of_b = F.pmod("pair", F.lit(size_b))
    top = F.broadcast(counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most")))  # as many rows as B has ids
    return checkpointed(counts.join(top, of_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _bucket():
    return F.floor(4 * F.log2("n")).cast("int")


def frequent_from(counts: DataFrame, limit: int) -> int:
    """The lowest bucket of counts (four for each power of two) from which at most limit pairs have their count."""
    have, least = 0, 1 << 30
    for row in counts.groupBy(_bucket().alias("bucket")).agg(F.count("*").alias("pairs")).orderBy(F.desc("bucket")).collect():
        have += row.pairs
        if have > limit:
            break
        least = row.bucket
    return least


def best_links(aligned: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """(key, n_best, count_sum) of each distinct text."""
    least = frequent_from(counts, limit)
    near = counts.where(_bucket() >= least).toArrow()  # at most limit rows
    pairs = near["pair"].to_numpy()
    order = np.argsort(pairs)
    shared = counts.sparkSession.sparkContext.broadcast(
        (pairs[order], near["n"].to_numpy()[order], near["best"].to_numpy(zero_copy_only=False)[order]))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in chunks(batch.column(1).offsets.to_numpy(), LOOKED_UP):
                yield batch.slice(i, j - i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for part in parts(batches):
            column = part.column(1)
            offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
            links = column.flatten().to_numpy()
            place = np.minimum(np.searchsorted(pairs, links), max(len(pairs) - 1, 0))
            found = pairs[place] == links if len(pairs) else np.zeros(len(links), bool)
            total = np.zeros((3, len(links) + 1), np.int64)
            if len(pairs):
                np.cumsum(np.where(found, best[place], 0), out=total[0, 1:])
                np.cumsum(np.where(found, n[place], 0), out=total[1, 1:])
            np.cumsum(~found, out=total[2, 1:])
            sums = total[:, offsets[1:]] - total[:, offsets[:-1]]
            rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sums[2])], pa.int32()), pa.array(links[~found]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums[0]), pa.array(sums[1]), rare],
                                             names=["key", "n_best", "count_sum", "rare"])

    near = checkpointed(aligned.select("key", "links").mapInArrow(
        run, "key string, n_best long, count_sum long, rare array<long>"))
    far = near.select("key", F.explode("rare").alias("pair")).join(counts.where(_bucket() < least), "pair")
    rare = far.select("key", F.col("best").cast("long").alias("n_best"), F.col("n").alias("count_sum"))
    return near.select("key", "n_best", "count_sum").unionByName(rare).groupBy("key").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, definition: str, model: bytes, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups_sha256 of their texts.

    ``definition`` is A's file as text, ``model`` B's as bytes.  n_best are the
    links whose pair is as frequent as any of their B id, count_sum the sum of
    the links' pair counts.  groups_sha256 is of ``a1,a2|b1;a3|b2,b3``.
    """
    import sentencepiece

    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/alignment-{uuid.uuid4().hex}"
    distinct_texts(docs, definition, model, text).write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.schema(_ALIGNED).parquet(folder)
    counts = pair_counts(aligned, sentencepiece.SentencePieceProcessor(model_proto=model).vocab_size())
    best = best_links(aligned, counts, frequent)
    # every link ends one group
    texts = checkpointed(aligned.drop("links").join(best, "key").withColumn("n_links", F.col("n_groups")))
    remove_folder(spark, folder)
    return with_measures(without(docs, *[c for c in MEASURES if c != text]), texts, text)


def with_measures(docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """docs with the MEASURES that texts has for the digest of their text; none are zeros and ''."""
    total = texts.agg(F.sum("copies")).first()[0] or 0
    key, own, hot, rest = fresh(docs, "key", "own", "hot", "rest")
    measures = F.struct(*MEASURES)
    often = F.col("copies") * HOT > total  # the copies sum to total, so fewer than HOT texts
    keyed = docs.withColumn(key, F.when(quoted(text).cast("string") != "", F.sha2(quoted(text).cast("string"), 256)))
    few = texts.where(often).select(F.col("key").alias(f"{hot}_key"), measures.alias(hot))
    many = texts.where(~often).select(F.col("key").alias(f"{rest}_key"), measures.alias(rest))
    met = keyed.join(F.broadcast(few), F.col(key) == F.col(f"{hot}_key"), "left")
    # rows that need no join any more get a key of their own, which no digest equals
    met = met.withColumn(own, F.when(F.col(hot).isNull() & F.col(key).isNotNull(), F.col(key))
                         .otherwise(F.monotonically_increasing_id().cast("string")))
    out = met.join(many, F.col(own) == F.col(f"{rest}_key"), "left")
    found = F.coalesce(F.col(hot), F.col(rest))
    zero = {m: F.lit("") if m == "groups_sha256" else F.lit(0).cast("long") for m in MEASURES}
    return out.select(*[quoted(c) for c in docs.columns], *[F.coalesce(found[m], zero[m]).alias(m) for m in MEASURES])
