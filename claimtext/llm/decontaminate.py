"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
The test strings are the windows of ``window`` consecutive words of each
item; an item with fewer words (but some) is one window.  For each window
length there is one matcher: a shift table, indexed by the hash of a block of
words, tells how far the search may jump without passing the end of an
occurrence; where it is zero, the hash of the suffix block selects a bucket of
test strings; those whose prefix block agrees are compared byte by byte.

The test strings are the stated query set.  They reach the tasks in blocks of
at most ``block_windows`` distinct windows, each broadcast (about 250 bytes a
window) and searched for in all documents; there is no pass that holds more.

Defined results: a null or empty text has no words and is clean; a null item
text has no window.  Items are told apart by item_id; rows that repeat an id
are one item.  An item with a null id marks words but is not listed.  Empty
benchmark: every document is clean.  Result columns replace input columns of
the same name; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import checkpointed, fresh, quoted, without
from claimtext.llm.words import ALNUM, LOWER, Words, chunks, covered, mix, per_row, text_bytes

WINDOW = 10
BLOCK_WINDOWS = 200_000
LANES = 1024


class Matcher:
    """Wu-Manber tables for test strings of one length, in words."""

    def __init__(self, length: int, patterns: list[bytes], numbers: list[int]):
        self.length, self.block = length, min(2, length)
        words = Words(np.frombuffer(b"".join(patterns), np.uint8),
                      np.cumsum([0, *map(len, patterns)]), ALNUM, LOWER)
        blocks = _blocks(words.hashes(), self.block)
        first = words.first[:-1]
        bits = max(12, int(np.ceil(np.log2(len(patterns) * length + 1))) + 3)
        self.down = np.uint64(64 - bits)
        reach = length - self.block + 1  # of a block that no test string has
        self.shift = np.full(1 << bits, reach, np.int64)
        for at in range(reach):  # blocks by place; the last has shift 0
            np.minimum.at(self.shift, blocks[first + at] >> self.down, reach - 1 - at)
        suffix = blocks[first + reach - 1]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.prefix = suffix[order], blocks[first][order]
        self.patterns = [patterns[i] for i in order]
        self.numbers = np.array(numbers, np.int64)[order]

    def ends(self, blocks: np.ndarray) -> np.ndarray:
        """Last words where a test string may end: lanes jump through the text side by side."""
        low, n = self.length - 1, len(blocks) + self.block - 1
        if n <= low:
            return np.zeros(0, np.int64)
        edge = np.linspace(low, n, min(LANES, n - low) + 1).astype(np.int64)
        at, stop, found = edge[:-1], edge[1:], []
        while len(at):
            jump = self.shift[blocks[at - self.block + 1] >> self.down]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found)

    def matches(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern number) of every occurrence."""
        blocks = _blocks(hashes, self.block)
        end = self.ends(blocks)
        begin = end - self.length + 1
        end = end[words.row[begin] == words.row[end]]
        tail = blocks[end - self.block + 1]
        low = np.searchsorted(self.suffix, tail, "left")
        number = np.searchsorted(self.suffix, tail, "right") - low
        begin = np.repeat(end, number) - self.length + 1
        which = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(low, number)
        same = self.prefix[which] == blocks[begin]
        begin, which = begin[same], which[same]
        text, patterns = words.text.tobytes(), self.patterns
        a, b = words.start[begin].tolist(), words.end[begin + self.length - 1].tolist()
        true = np.fromiter((text[x:y] == patterns[p] for x, y, p in zip(a, b, which.tolist())), bool, len(begin))
        return begin[true], self.numbers[which[true]]


def _blocks(hashes: np.ndarray, block: int) -> np.ndarray:
    return hashes if block == 1 else mix(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])


class Patterns:
    """One block of distinct windows and the items that have them."""

    def __init__(self) -> None:
        self.owners: dict[bytes, set[str | None]] = {}

    def add(self, window: bytes, item: str | None) -> None:
        self.owners.setdefault(window, set()).add(item)

    def build(self) -> tuple[list[Matcher], np.ndarray, np.ndarray, list[str | None]]:
        by_length: dict[int, list[tuple[bytes, int]]] = {}
        items = sorted({i for s in self.owners.values() for i in s}, key=lambda x: (x is None, x))
        place = {x: k for k, x in enumerate(items)}
        starts, owned = [0], []
        for number, (window, who) in enumerate(self.owners.items()):
            by_length.setdefault(window.count(b" ") + 1, []).append((window, number))
            owned.extend(place[x] for x in who)
            starts.append(len(owned))
        matchers = [Matcher(n, [w for w, _ in x], [k for _, k in x]) for n, x in sorted(by_length.items())]
        return matchers, np.array(starts), np.array(owned, np.int64), items


def pattern_blocks(items: DataFrame, window: int, size: int, id: str, text: str) -> Iterator[Patterns]:
    """The windows of items in blocks of at most size; the driver holds one block."""
    block = Patterns()
    rows = items.select(quoted(id).cast("string").alias("id"), quoted(text).cast("string").alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        data = np.frombuffer(row.text.encode(), np.uint8)
        words = Words(data, np.array([0, len(data)]), ALNUM, LOWER)
        n, flat = len(words), words.text.tobytes()
        for i in range(max(n - window + 1, 1) if n else 0):
            block.add(flat[words.start[i]:words.end[min(i + window, n) - 1]], row.id)
            if len(block.owners) >= size:
                yield block
                block = Patterns()
    yield block


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
         text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit, items (sorted distinct ids as strings), spans of hit words, contaminated."""
    out = ["n_words", "n_hit", "items", "spans", "contaminated"]
    docs = without(docs, *[c for c in out if c.lower() != text.lower()])
    marked = None
    for block in pattern_blocks(benchmark, window, block_windows, item_id, item_text):
        if marked is not None:  # another block: what is found so far is kept in the shared folder
            docs = checkpointed(marked)
        marked = _search(docs, block, text)
    return marked.withColumn("contaminated", F.col("n_hit") > 0)


def _search(docs: DataFrame, block: Patterns, text: str) -> DataFrame:
    """Adds the hits of one block to those that docs may have from earlier blocks."""
    again = "spans" in docs.columns
    carried = [c for c in docs.columns if not again or c not in ("n_words", "n_hit", "items", "spans")]
    own, = fresh(docs, "text")
    old = ["items", "spans"] if again else []
    given = docs.select(*[quoted(c) for c in carried], quoted(text).cast("string").alias(own), *old)
    schema = (docs.select(*[quoted(c) for c in carried]).withColumn("n_words", F.lit(0).cast("long"))
              .withColumn("n_hit", F.lit(0).cast("long")).withColumn("items", F.expr("cast(array() as array<string>)"))
              .withColumn("spans", F.expr("cast(array() as array<struct<first:int,last:int>>)")).schema)
    tables = docs.sparkSession.sparkContext.broadcast(block.build())
    width = len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, starts, owned, items = tables.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(width))
            n_words, n_hit = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            found = batch.column(width + 1).to_pylist() if again else [[] for _ in range(len(batch))]
            spans = batch.column(width + 2).to_pylist() if again else [[] for _ in range(len(batch))]
            for i, j in chunks(offsets):
                words = Words(data, offsets[i:j + 1], ALNUM, LOWER)
                n_words[i:j] = words.count
                hashes = words.hashes()
                first, last, rows, numbers = [], [], [], []
                for matcher in matchers:
                    begin, number = matcher.matches(words, hashes)
                    first.append(begin)
                    last.append(begin + matcher.length)
                    rows.append(words.row[begin])
                    numbers.append(number)
                for r in range(i, j) if again else ():
                    first.append(np.array([words.first[r - i] + s["first"] for s in spans[r]], np.int64))
                    last.append(np.array([words.first[r - i] + s["last"] + 1 for s in spans[r]], np.int64))
                if not first or not sum(map(len, first)):
                    continue
                hit = covered(len(words), np.concatenate(first), np.concatenate(last))
                n_hit[i:j] = per_row(words, hit)
                for r in np.flatnonzero(n_hit[i:j]):
                    inside = np.r_[False, hit[words.first[r]:words.first[r + 1]], False]
                    edge = np.flatnonzero(inside[1:] != inside[:-1])
                    spans[i + r] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]
                if rows and sum(map(len, rows)):
                    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(numbers)]), axis=1)
                    for r, number in pairs.T.tolist():
                        found[i + r].extend(items[x] for x in owned[starts[number]:starts[number + 1]])
            found = [sorted({x for x in f if x is not None}) if f else f for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(n_words), pa.array(n_hit), pa.array(found, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))],
                names=schema.names)

    return given.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold any window of the benchmark."""
    out, = fresh(docs, "contaminated")
    text = options.get("text", "text")
    given = docs.columns
    # other columns are renamed on the way, so that none is replaced
    renamed = docs.select(*[quoted(c).alias(text if c == text else f"{out}{k}") for k, c in enumerate(given)])
    marked = mark(renamed, benchmark, **options).where(~F.col("contaminated"))
    return marked.select(*[quoted(text if c == text else f"{out}{k}").alias(c) for k, c in enumerate(given)])
