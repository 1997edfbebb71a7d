"""Token counts through a digest cache.

Each text has the digest of its normalised content: SHA-256 of the text, with
every run of ASCII white space as one space where the tokenizer's own
normaliser drops white space too, so texts of one digest have one count.  The
tokenizer's version is the SHA-256 of its file.  Counts are stored as Parquet under
(tokenizer version, content digest).  A run joins its distinct digests to the
stored counts, encodes one text for each digest that is missing, appends the
new counts, and joins the counts to the documents.

The tokenizers library counts.  No token, special string or canonical
composition reaches across ASCII white space, so a text's count is the sum
over its pieces between white space, and each distinct piece of a batch is
encoded once, many in one call, in which the library keeps them apart.
Pieces that come again and again stay in a worker's memo.  That pieces add up
is checked for the given file when the encoder is built; a tokenizer of
another kind encodes whole texts.

Defined results: a null text counts as empty, with 0 tokens.  Copies and
repeated rows are encoded once.  Runs that append the same digest twice are
harmless: the cache is read distinct.  Rows appended by a failed job are not
seen.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import SPACE, fresh, quoted, without
from claimtext.llm.words import chunks, text_bytes

_CACHE = "digest binary, n_tokens long, tokenizer string"
MEMO_PIECES = 150_000  # pieces of each of the two halves of a worker's memo of counts, before a chunk
MEMO_BYTES = 64  # longer pieces are not remembered
ENCODED = 4096  # pieces that are encoded at once
CHUNK = 1 << 20  # bytes of text that are split at once


class Encoder:
    """Counts tokens with the file's tokenizer, piece by piece where that is exact."""

    def __init__(self, definition: str, by_piece: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer  # in the worker

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = by_piece
        self.memo: dict[bytes, int] = {}
        self.before: dict[bytes, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[int]:
        """Tokens of each piece, from one call: given as a list, pieces are encoded apart and numbered."""
        out = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        numbers = Counter(out.word_ids)
        return [numbers[i] for i in range(len(pieces))]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._encode(texts)
        pieces = [t.encode().split() for t in texts]
        if len(self.memo) > MEMO_PIECES:  # pieces not met since the last turn are forgotten, frequent ones stay
            self.before = {p: n for p, n in self.memo.items() if len(p) <= MEMO_BYTES}
            self.memo = {}
        memo, before = self.memo, self.before
        unseen = set().union(*pieces).difference(memo)
        again = before.keys() & unseen
        memo.update((p, before[p]) for p in again)
        new = list(unseen.difference(again))
        for k in range(0, len(new), ENCODED):
            part = new[k:k + ENCODED]
            memo.update(zip(part, self._encode_pieces([p.decode() for p in part])))
        return [sum(map(memo.__getitem__, row)) for row in pieces]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer: str, definition: str, by_piece: bool) -> Encoder:
    """One encoder, with its memo, for a worker process and a tokenizer version."""
    if tokenizer not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer] = Encoder(definition, by_piece)
    return _ENCODERS[tokenizer]


def splits_at_space(definition: str) -> bool:
    """Whether white space always parts tokens: it is dropped before the model, and no special string has any."""
    d = json.loads(definition)
    pre = d.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers") or [pre]
    pattern = (steps[0].get("pattern") or {}).get("Regex", "")
    drops = (steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
             and pattern.endswith(r"[^\s\p{L}\p{N}]+") and " " not in pattern
             and all(s.get("type") == "ByteLevel" and not s.get("add_prefix_space") for s in steps[1:]))
    plain = all(n.get("type") in ("NFC", "Replace", "Lowercase")
                for n in (d.get("normalizer") or {}).get("normalizers", [d.get("normalizer") or {"type": ""}]))
    alone = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and len(t["content"].split()) == 1
                for t in d.get("added_tokens", []))
    return bool(drops and plain and alone)


def version(definition: str) -> str:
    return hashlib.sha256(definition.encode()).hexdigest()


def read_cache(spark, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) stored for the tokenizer version; the cache is made if there is none."""
    spark.createDataFrame([], _CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def content_of(text: str, definition: str):
    """The text as it is digested: with white space folded only where the tokenizer drops it."""
    content = F.coalesce(quoted(text).cast("string"), F.lit(""))
    return F.regexp_replace(content, f"{SPACE}+", " ") if splits_at_space(definition) else content


def with_digest(docs: DataFrame, text: str, name: str, definition: str) -> DataFrame:
    return docs.withColumn(name, F.unhex(F.sha2(content_of(text, definition), 256)))


def add_missing(docs: DataFrame, definition: str, cache: str, text: str = "text") -> None:
    """Encode the distinct contents of docs that the cache lacks, and append their counts.

    Contents are keys of a hash aggregate, which parts copies before the
    shuffle and sorts no text.
    """
    spark, tokenizer, by_piece = docs.sparkSession, version(definition), splits_at_space(definition)
    contents = docs.select(content_of(text, definition).alias("text")).distinct()
    keyed = contents.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    missing = keyed.join(read_cache(spark, cache, tokenizer), "digest", "left_anti")
    shared = spark.sparkContext.broadcast(definition)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, shared.value, by_piece)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            _, offsets = text_bytes(texts)
            counts: list[int] = []
            for i, j in chunks(offsets, CHUNK):
                counts.extend(encoder.counts(texts.slice(i, j - i).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    new = missing.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def count_tokens(docs: DataFrame, definition: str, cache: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``definition`` is the tokenizer's file as text, ``cache`` a folder that
    driver and executors share.
    """
    add_missing(docs, definition, cache, text)
    docs = without(docs, *[c for c in ("n_bytes", "n_tokens", "over_limit") if c != text])
    digest, = fresh(docs, "digest")
    counts = read_cache(docs.sparkSession, cache, version(definition)).withColumnRenamed("digest", f"{digest}c")
    sized = with_digest(docs, text, digest, definition).withColumn(
        "n_bytes", F.coalesce(F.octet_length(quoted(text).cast("string")), F.lit(0)).cast("long"))
    return (sized.join(counts, F.col(digest) == F.col(f"{digest}c"), "left").drop(digest, f"{digest}c")
            .withColumn("over_limit", F.col("n_tokens") > limit))
