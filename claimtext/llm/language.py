"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

Words are runs of letters (and the marks on them).  Training counts the
character trigrams of lower-cased words, with the word's edges, for each
language in ``GRAMS`` hashed places, over at most about ``max_train``
labelled rows, taken by the hash of their text.  It also keeps, for each language, the scripts
of at least one word in a hundred.

A word's script (Unicode ranges, by its first letter) narrows its candidates
to the languages that use the script; a word of a script that no language
uses says nothing.  Its score for a candidate is the log-likelihood of its
trigrams.  Viterbi then labels the words of a text so that the summed scores
less ``penalty`` for each change of language is largest, which marks spans in
mixed-language texts.  The language with most letters is predicted.  Texts
are taken whole; many are decoded side by side.

Defined results: ``und`` with score 0 for a null text or one without letters.
The score is the share of the text's letters in spans of the predicted
language.  Words of an unknown script take the label of their neighbours; a
text of such words only gets the most frequent language with score 0.  Ties
go to the language that sorts first.  Without any labelled row every
prediction is ``und``.  Labels and ids never reach the prediction.  Result columns replace
input columns of the same name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import fresh, quoted, without
from claimtext.llm.words import mix

GRAMS = 1 << 16
MAX_TRAIN = 40_000
PENALTY = 12.0
UNKNOWN = "und"
BLOCK_WORDS = 1_000_000

# FIXED VALUES: first code points of Unicode script ranges; a script goes on to the next entry.
SCRIPTS = [(0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
           (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
           (0xA80, "gujarati"), (0xB00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"),
           (0xD00, "malayalam"), (0xD80, "other"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"),
           (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
           (0x1780, "khmer"), (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"),
           (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2DE0, "cyrillic"), (0x2E80, "han"),
           (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0x31F0, "kana"), (0x3200, "han"),
           (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
           (0xAB30, "latin"), (0xAB70, "other"), (0xAC00, "hangul"), (0xD800, "other"), (0xF900, "han"),
           (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
           (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
           (0x20000, "han"), (0x32000, "other")]
NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: word character (letter or mark), lower case of equal length, script."""
    size = 0x110000
    kind = np.zeros(size, np.uint8)
    lower = np.arange(size, dtype=np.uint32)
    for c in range(size):
        group = unicodedata.category(chr(c))[0]
        if group == "L":
            kind[c] = 1
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif group == "M":
            kind[c] = 2
    script = np.zeros(size, np.uint8)
    for (a, name), (b, _) in pairwise([*SCRIPTS, (size, "")]):
        script[a:b] = NAMES.index(name)
    return kind, lower, script


class LetterWords:
    """Words of letters of some texts, with a hashed trigram for each of their characters."""

    def __init__(self, texts: list[str]):
        kind, lower, script = _tables()
        raw = "".join(texts).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, np.uint32)
        at = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        class_ = kind[points]
        inside = class_ > 0
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begins = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(points))]
        before[begins] = False
        after[begins - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        letters = np.r_[0, np.cumsum(class_ == 1)]
        size = letters[end] - letters[start]
        start, end, self.size = start[size > 0], end[size > 0], size[size > 0]
        self.first = np.searchsorted(start, at)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        base = at[self.row] if len(start) else start
        self.span = (start - base, end - base)  # code points of the row's text
        small = lower[points].astype(np.uint64)
        head = small.copy()
        # a word's characters and its end, each with the two before it; its start counts as 1
        length = end - start + 1
        self.edge = np.r_[0, np.cumsum(length)]
        place = np.arange(self.edge[-1]) - np.repeat(self.edge[:-1] - start, length)
        own = np.append(small, np.uint64(0))[place]
        last = self.edge[1:] - 1
        own[last] = 2
        begin = np.zeros(len(own), bool)
        begin[self.edge[:-1]] = True
        one = np.r_[np.uint64(1), own[:-1]]
        one[begin] = 1
        two = np.r_[np.uint64(1), one[:-1]]
        two[begin] = 1
        self.gram = (mix((two << np.uint64(42)) ^ (one << np.uint64(21)) ^ own) >> np.uint64(48)).astype(np.int64)
        self.script = script[head[start].astype(np.int64)] if len(start) else np.zeros(0, np.uint8)


def _parts(texts: list[str], size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about size characters; no row is split."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= size):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


class Model:
    """languages (sorted), scores (place, language), scripts each uses, the most frequent language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=0, keepdims=True)
        self.scores = np.log((counts + 0.5) / (total + 0.5 * GRAMS)).astype(np.float32)
        self.uses = scripts >= 0.01 * np.maximum(scripts.sum(axis=0, keepdims=True), 1)
        self.usual = int(np.argmax(rows)) if len(rows) else -1


def fit(docs: DataFrame, max_train: int = MAX_TRAIN, text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows of docs with a language; rows beyond max_train are left out by their text's hash."""
    rows = docs.select(quoted(lang).cast("string").alias("lang"), quoted(text).cast("string").alias("text"))
    rows = rows.where("lang is not null and text is not null")
    number = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(number)
    place = {x: k for k, x in enumerate(languages)}
    share = min(1.0, max_train / max(1, sum(number.values())))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(share * 1_000_003))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # places of the table: the trigrams, then the scripts
        counts = np.zeros((len(languages), GRAMS + len(NAMES)), np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            which = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, j in _parts(texts):
                words = LetterWords(texts[i:j])
                if not len(words.row):
                    continue
                language = which[i:j][words.row]
                of_gram = np.repeat(language, np.diff(words.edge))
                width = counts.shape[1]
                flat = np.r_[of_gram * width + words.gram, language * width + GRAMS + words.script]
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        language, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(at, pa.int32()),
                                          pa.array(counts[language, at])], names=["language", "place", "n"])

    found = rows.mapInArrow(run, "language int, place int, n long")
    total = found.groupBy("language", "place").agg(F.sum("n").alias("n")).toArrow()  # at most the table's places
    counts = np.zeros((GRAMS + len(NAMES), len(languages)), np.int64)
    counts[np.asarray(total["place"]), np.asarray(total["language"])] = np.asarray(total["n"])
    return Model(languages, counts[:GRAMS], counts[GRAMS:], np.array([number[x] for x in languages]))


def _word_scores(model: Model, words: LetterWords) -> np.ndarray:
    scores = np.empty((len(words.row), len(model.languages)), np.float32)
    for k in range(len(model.languages)):
        total = np.r_[0.0, np.cumsum(model.scores[words.gram, k], dtype=np.float64)]
        scores[:, k] = total[words.edge[1:]] - total[words.edge[:-1]]
    uses = model.uses[words.script]
    known = uses.any(axis=1)
    scores[~uses & known[:, None]] = -np.inf
    scores[~known] = 0
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; row r has the words first[r] to first[r + 1]."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    order = order[:np.count_nonzero(count)]
    at, count = first[order], count[order]
    out = np.zeros(len(scores), np.int64)
    if not len(order):
        return out
    stays = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int64)
    live = np.searchsorted(-count, -np.arange(1, count[0] + 1), "right")  # rows with more than t words
    value = scores[at].astype(np.float64)
    final = np.zeros(len(order), np.int64)
    for t in range(1, len(live)):
        k = live[t]
        final[k:len(value)] = value[k:].argmax(axis=1)
        value, here = value[:k], at[:k] + t
        top = value.argmax(axis=1)
        change = value[np.arange(k), top] - penalty
        stay = value >= change[:, None]
        best[here], stays[here] = top, stay
        value = np.where(stay, value, change[:, None]) + scores[here]
    final[:len(value)] = value.argmax(axis=1)
    state = final
    for t in range(len(live) - 1, 0, -1):
        k = live[t]
        here, now = at[:k] + t, state[:k]
        out[here] = now
        state[:k] = np.where(stays[here, now], now, best[here])
    out[at] = state
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """docs with lang_pred, score and spans (language, first and last code point) of their whole texts."""
    docs = without(docs, *[c for c in ("lang_pred", "score", "spans") if c != text])
    own, = fresh(docs, "text")
    given = docs.select("*", quoted(text).cast("string").alias(own))
    schema = (docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0))
              .withColumn("spans", F.expr("cast(array() as array<struct<lang:string,first:int,last:int>>)")).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS floats a language
    span = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).fill_null("").to_pylist()
            labels, scores, spans = [], [], []
            for part in _decoded(texts, model, penalty):
                for have, new in zip((labels, scores, spans), part):
                    have.extend(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()),
                                              pa.array(scores, pa.float64()), pa.array(spans, span)],
                                             names=schema.names)

    return given.mapInArrow(run, schema)


def _decoded(texts: list[str], model: Model, penalty: float) -> Iterator[tuple[list, list, list]]:
    """(labels, scores, spans) of the texts, in parts of about BLOCK_WORDS words."""
    if not model.languages:
        yield [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        return
    held: list[tuple] = []
    number = 0
    for i, j in _parts(texts):
        words = LetterWords(texts[i:j])
        held.append((words.row, words.first, words.size, words.span, _word_scores(model, words),
                     model.uses[words.script].any(axis=1)))
        number += len(words.row)
        if number >= BLOCK_WORDS:
            yield _labelled(held, model, penalty)
            held, number = [], 0
    if held:
        yield _labelled(held, model, penalty)


def _labelled(held: list[tuple], model: Model, penalty: float) -> tuple[list, list, list]:
    rows = np.cumsum([0, *[len(h[1]) - 1 for h in held]])
    words = np.cumsum([0, *[len(h[0]) for h in held]])
    row = np.concatenate([h[0] + r for h, r in zip(held, rows)])
    first = np.concatenate([*[h[1][:-1] + w for h, w in zip(held, words)], [words[-1]]])
    size = np.concatenate([h[2] for h in held])
    begin, end = (np.concatenate([h[3][k] for h in held]) for k in (0, 1))
    state = viterbi(np.concatenate([h[4] for h in held]), first, penalty)
    known = np.concatenate([h[5] for h in held])
    n, width = rows[-1], len(model.languages)
    mass = np.bincount(row * width + state, weights=size, minlength=n * width).reshape(n, width)
    firm = np.bincount(row, weights=size * known, minlength=n) > 0
    total = mass.sum(axis=1)
    top = np.where(firm, mass.argmax(axis=1), model.usual)
    labels = [model.languages[k] if t else UNKNOWN for k, t in zip(top.tolist(), total.tolist())]
    share = np.where(firm, mass[np.arange(n), top] / np.maximum(total, 1), 0.0)
    spans: list[list] = [[] for _ in range(n)]
    if len(row):
        change = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (state[1:] != state[:-1])])
        last = np.r_[change[1:], len(row)] - 1
        for r, k, a, b in zip(row[change].tolist(), state[change].tolist(), begin[change].tolist(), end[last].tolist()):
            spans[r].append({"lang": model.languages[k], "first": a, "last": b - 1})
    return labels, share.tolist(), spans
