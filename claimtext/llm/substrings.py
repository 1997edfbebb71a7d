"""Substring dedup by super-k-mers of words.

Words are runs without ASCII white space, unchanged.  A window is ``window``
consecutive words of one document.  Its minimiser is the least hash of the
``minimiser``-word strings inside it.  Consecutive windows that share their
minimiser travel as one packed string to the bucket of that minimiser, so
each word travels about three times, not ``window`` times.  Every occurrence
of a window has the same minimiser, hence the same bucket.  There the windows
are sorted by hash; those with equal hashes are compared byte by byte and all
but the earliest (smaller id, then smaller start) are repeats.  Words covered
by a repeat are removed; all windows are judged on the input.

Skew: where a chunk of rows has the same packed string more than once, only
the earliest travels; the others are known to be repeats at once.  So a passage
that a third of all documents share reaches its bucket once for each chunk of
about a megabyte, and no bucket holds more than the distinct contexts.
A task works through its buckets one after the other; there are
``BUCKETS_PER_PARTITION`` for each shuffle partition.  The strings of a task
for one bucket are compressed together on their way.

Defined results: a null, empty or blank text has no words and stays as an
empty kept text; texts shorter than a window keep all words.  Null ids sort
last (as 2**63 - 1).  Rows with equal id and text are one document seen twice: they lose the
same words, and neither repeats the other.  Rows with equal id and other
texts compare by start alone.  An empty table gives no rows.  Result columns
replace input columns of the same name; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import checkpointed, fresh, quoted, released, without
from claimtext.llm.words import (BY_SPACE, Words, chunks, covered, mix, per_row, sliding_min, spans_hash,
                                 text_bytes)

WINDOW = 20
MINIMISER = 3
BUCKETS_PER_PARTITION = 32
CHUNK = 2 << 20  # bytes of text that are worked on at once
PARCELS_BYTES = 32 << 20  # packed bytes that a task gathers before it sends them
BLOCK_BYTES = 1 << 20  # packed bytes of whole buckets that are sorted at once, or one bucket
LAST = np.int64((1 << 63) - 1)  # where a null id sorts

_PACKED = "bucket int, n int, size int, packed binary"
_REPEATS = "id long, tag long, start int, n int"


def _super_kmers(words: Words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser, hash of the words) of each run."""
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = words.hashes()
    m = np.arange(len(words) - minimiser + 1)
    grams = mix(spans_hash(hashes, m, m + minimiser))
    least = sliding_min(grams, window - minimiser + 1)
    inside = words.row[:n] == words.row[window - 1:]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # a run ends where the next begins or where the row has no more windows
    stop = np.flatnonzero(np.r_[new[1:] | ~inside[1:], True] & inside) + 1
    number = stop - first
    return first, number, least[first], mix(spans_hash(hashes, first, stop + window - 1) + number.astype(np.uint64))


class _Parcels:
    """Packed strings by bucket, compressed together when there is enough of them."""

    def __init__(self, buckets: int):
        self.buckets, self.size, self.parts = buckets, 0, {}

    def add(self, bucket: np.ndarray, columns: list[np.ndarray], packed: list[bytes]) -> None:
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True])
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = order[x:y]
            text = b"".join([packed[k] for k in own.tolist()])
            self.parts.setdefault(int(bucket[own[0]]), []).append(([c[own] for c in columns], text))
            self.size += len(text)

    def sent(self) -> pa.RecordBatch:
        rows, codec = [], pa.Codec("zstd", compression_level=6)
        for bucket, parts in self.parts.items():
            columns = [np.concatenate(c) for c in zip(*[p[0] for p in parts])]
            raw = b"".join([*[c.tobytes() for c in columns], *[p[1] for p in parts]])
            rows.append((bucket, len(columns[0]), len(raw), codec.compress(raw, asbytes=True)))
        self.size, self.parts = 0, {}
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "n", "size", "packed"])


# of a parcel's strings: the id, the tag, first word, number of windows, bytes (0: known repeat)
_KINDS = (np.int64, np.int64, np.int32, np.int32, np.int32)


def _opened(n: int, size: int, packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = pa.decompress(packed, size, "zstd", asbytes=True)
    columns, at = [], 0
    for kind in _KINDS:
        columns.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return columns, raw[at:]


def _pack(batches: Iterator[pa.RecordBatch], window: int, minimiser: int, buckets: int) -> Iterator[pa.RecordBatch]:
    parcels = _Parcels(buckets)
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(int(LAST)))
        tags = np.asarray(batch.column(1).fill_null(0))
        data, offsets = text_bytes(batch.column(2))
        for i, j in chunks(offsets, CHUNK):
            words = Words(data, offsets[i:j + 1], BY_SPACE)
            first, number, least, whole = _super_kmers(words, window, minimiser)
            if not len(first):
                continue
            row = words.row[first] + i
            start = first - words.first[words.row[first]]
            text = words.text.tobytes()
            packed = [text[a:b] for a, b in zip(words.start[first].tolist(),
                                                (words.end[first + number + window - 2] + 1).tolist())]
            # of equal strings the earliest travels
            order = np.lexsort((start, ids[row], whole))
            head = np.r_[True, whole[order][1:] != whole[order][:-1]]
            leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            for k, lead in zip(order[~head].tolist(), leader[~head].tolist()):
                if packed[k] == packed[lead] and (ids[row[k]], start[k]) > (ids[row[lead]], start[lead]):
                    packed[k] = b""
            size = np.fromiter(map(len, packed), np.int32, len(packed))
            parcels.add(((least >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64),
                        [ids[row], tags[row], start.astype(np.int32), number.astype(np.int32), size], packed)
            if parcels.size >= PARCELS_BYTES:
                yield parcels.sent()
    if parcels.parts:
        yield parcels.sent()


def _repeats(parcels: list[tuple[list[np.ndarray], bytes]], window: int) -> pa.RecordBatch:
    """Repeated windows of whole buckets, as runs (id, tag, start, n)."""
    ids, tags, start, number, size = (np.concatenate(c) for c in zip(*[p[0] for p in parcels]))
    start, number = start.astype(np.int64), number.astype(np.int64)
    known = size == 0
    old = ids[known], tags[known], start[known], number[known]
    ids, tags, start, number, size = (c[~known] for c in (ids, tags, start, number, size))
    data = np.frombuffer(b"".join([p[1] for p in parcels]), np.uint8)
    words = Words(data, np.r_[0, np.cumsum(size, dtype=np.int64)], BY_SPACE)
    # every row has its n windows; begin is a window's first word
    row = np.repeat(np.arange(len(number)), number)
    within = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    begin = words.first[row] + within
    hashes = mix(spans_hash(words.hashes(), begin, begin + window))
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    shared = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    at = start[row[shared]] + within[shared]
    shared = shared[np.lexsort((at, ids[row[shared]], hashes[shared]))]
    at = start[row[shared]] + within[shared]
    head = np.r_[True, hashes[shared][1:] != hashes[shared][:-1]][:len(shared)]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(shared)), 0))
    text = words.text.tobytes()
    low, high = words.start[begin[shared]].tolist(), words.end[begin[shared] + window - 1].tolist()
    equal = np.fromiter((text[low[k]:high[k]] == text[low[p]:high[p]] for k, p in enumerate(lead.tolist())), bool,
                        len(shared))
    own = ids[row[shared]]
    later = (own > own[lead]) | ((own == own[lead]) & (at > at[lead]))
    repeat = equal & later
    for h in set(lead[~equal].tolist()):  # other windows with the same hash: the exact way
        earliest: dict[bytes, int] = {}
        for k in np.flatnonzero(lead == h).tolist():
            e = earliest.setdefault(text[low[k]:high[k]], k)
            repeat[k] = (own[k], at[k]) > (own[e], at[e])
    flag = np.zeros(len(row), bool)
    flag[shared[repeat]] = True
    goes_on = np.r_[False, row[1:] == row[:-1]][:len(row)]
    begins = np.flatnonzero(flag & ~(goes_on & np.r_[False, flag[:-1]][:len(row)]))
    ends = np.flatnonzero(flag & ~np.r_[(flag & goes_on)[1:], False][:len(row)]) + 1
    r = row[begins]
    new = ids[r], tags[r], start[r] + within[begins], ends - begins
    id, tag, first, n = (np.concatenate(c) for c in zip(old, new))
    return pa.RecordBatch.from_arrays([pa.array(id, mask=id == LAST), pa.array(tag), pa.array(first.astype(np.int32)),
                                       pa.array(n.astype(np.int32))], names=["id", "tag", "start", "n"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """docs (id, tag, text) → runs of repeated windows (id, tag, start word, n windows)."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("id", "tag", "text").mapInArrow(lambda b: _pack(b, window, minimiser, buckets), _PACKED)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for bucket, n, raw, packed in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= BLOCK_BYTES and bucket != last:
                    yield _repeats(held, window)
                    held, size = [], 0
                held.append(_opened(n, raw, packed))
                size, last = size + raw, bucket
        if held:
            yield _repeats(held, window)

    return dealt.mapInArrow(run, _REPEATS)


def dedup(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """docs with kept_text (kept words joined by one space), n_words and n_removed."""
    docs = without(docs, *[c for c in ("kept_text", "n_words", "n_removed") if c != text])
    key, tag, spans, own, r_id, r_tag = fresh(docs, "id", "tag", "spans", "text", "r_id", "r_tag")
    plain = docs.schema[text].dataType.simpleString() == "string"  # else a string copy goes along
    texts = quoted(text) if plain else quoted(text).cast("string")
    keyed = docs.select("*", quoted(id).cast("long").alias(key), F.xxhash64(texts).alias(tag))
    slim = keyed.select(F.col(key).alias("id"), F.col(tag).alias("tag"), texts.alias("text"))
    runs = released(lambda: checkpointed(repeated_windows(slim, window, minimiser)), docs.sparkSession)
    of_doc = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias(spans))
    joined = keyed.join(of_doc.withColumnsRenamed({"id": r_id, "tag": r_tag}),
                        F.col(key).eqNullSafe(F.col(r_id)) & (F.col(tag) == F.col(r_tag)), "left")
    given = joined.select(*[quoted(c) for c in docs.columns], spans, *([] if plain else [texts.alias(own)]))
    schema = (docs.withColumn("kept_text", F.lit("")).withColumn("n_words", F.lit(0).cast("long"))
              .withColumn("n_removed", F.lit(0).cast("long")).schema)
    at = docs.columns.index(text) if plain else len(docs.columns) + 1
    return given.mapInArrow(lambda b: _cut(b, window, at, schema.names), schema)


def _cut(batches: Iterator[pa.RecordBatch], window: int, text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        given = len(names) - 3
        spans = batch.column(given)
        per, runs = np.diff(_offsets(spans)), spans.flatten()
        start, n = (np.asarray(runs.field(k)).astype(np.int64) for k in (0, 1))
        row = np.repeat(np.arange(len(spans)), per)
        n_words, n_removed, texts = [], [], []
        for i, j in chunks(offsets):
            words = Words(data, offsets[i:j + 1], BY_SPACE)
            own = slice(*np.searchsorted(row, [i, j]))
            begin = words.first[row[own] - i] + start[own]
            keep = ~covered(len(words), begin, begin + n[own] + window - 1)
            kept = per_row(words, keep)
            n_words.append(words.count)
            n_removed.append(words.count - kept)
            texts.append(_joined(words, keep, kept))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:given], pa.concat_arrays(texts) if texts else pa.array([], pa.string()),
             pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)])),
             pa.array(np.concatenate([*n_removed, np.zeros(0, np.int64)]))], names=names)


def _offsets(lists) -> np.ndarray:
    """Offsets of a list column; a null list is empty."""
    sizes = lists.value_lengths().fill_null(0)
    return np.r_[0, np.cumsum(np.asarray(sizes))]


def _joined(words: Words, keep: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each row joined by one space."""
    here = np.repeat(keep, words.length + 1)
    last = np.flatnonzero(keep)[np.cumsum(kept)[kept > 0] - 1]  # each row's last kept word
    here[words.end[last]] = False
    size = np.r_[0, np.cumsum(np.where(keep, words.length + 1, 0))]
    per = size[words.first[1:]] - size[words.first[:-1]] - (kept > 0)
    offsets = np.r_[0, np.cumsum(per)].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(per),
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.text[here].tobytes())])
