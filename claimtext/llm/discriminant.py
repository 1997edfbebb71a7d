"""Quality classifier: a regularised quadratic discriminant over document statistics.

One pass over the whole texts counts characters, words, lines and repeats,
and turns the counts into logarithms and log-ratios in steps of 1/1024.  A
class is a normal distribution of these: its mean, and its covariance shrunk
towards the pooled one (``lam``) and towards a multiple of the identity
(``gamma``).  A score is the difference of the two log-densities, by
Mahalanobis distances through the cached inverse Cholesky factors, with the
classes' shares, divided by a temperature and put through the logistic
function.

Sums and sums of products are over all labelled rows, in integers, so the
model does not depend on the order or the partitioning of the rows.  lam,
gamma and the temperature are chosen by the log-loss of ``TUNE`` labelled
rows at most (those of the smallest hashes), each scored by the moments of the other folds.

Defined results: null and empty texts have all counts zero and are scored by
them like any other.  Labels other than 0 and 1 are not learnt from.  Without
rows of both labels every score is the smoothed share of label 1, without any
row 0.5.  Repeated rows count as often as they stand.  A text of more than
``SLICE`` bytes is measured in slices cut at white space (a run without any is
cut where the slice ends), so a line over a cut counts as two.  Result columns
replace input columns of the same name.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimtext.llm.common import fresh, quoted, without
from claimtext.llm.words import BY_SPACE, Words, chunks, mix, text_bytes

STATISTICS = ("words", "characters_a_word", "letters", "capitals", "digits", "symbols", "exclamations", "stops", "lines",
              "repeated_lines", "repeated_windows", "distinct_words", "commonest_word", "short_words", "sentence_ends",
              "capital_words", "words_without_letter", "longest_word", "words_once")
SCALE = 1024
SLICE = 4 << 20
WINDOW = 3
FOLDS = 4
TUNE = 20_000
LAMBDAS, GAMMAS, TEMPERATURES = (0.05, 0.2, 0.5, 0.9), (0.001, 0.02, 0.1), (1.0, 2.0, 4.0, 8.0)


def _bytes(spec) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(spec)] = True
    return out


_CAPITAL = _bytes(range(65, 91))
_HEAD = ~_bytes(range(0x80, 0xC0))  # one of each code point
_LETTER = _CAPITAL | _bytes(range(97, 123)) | (_HEAD & _bytes(range(0x80, 0x100)))
_KINDS = [_HEAD, _LETTER, _CAPITAL, _bytes(range(48, 58)), _bytes(b"#*$%&|<>"), _bytes(b"!"), _bytes(b".,;:?")]
_END = _bytes(b".!?")
_BY_LINE = ~_bytes(b"\n")
_PER_WORD = 4  # short, sentence end, capital first, without letter


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at]


def _slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """offsets with cuts inside rows of more than SLICE bytes, after white space where there is any; the slices' rows."""
    cuts, pieces = [offsets], np.ones(len(offsets) - 1, np.int64)
    for i in np.flatnonzero(np.diff(offsets) > SLICE):
        at, end = offsets[i], offsets[i + 1]
        while end - at > SLICE:
            space = np.flatnonzero(~BY_SPACE[data[at + SLICE // 2:at + SLICE]])
            at = at + SLICE // 2 + space[-1] + 1 if len(space) else at + SLICE
            while data[at] & 0xC0 == 0x80:  # inside a code point
                at -= 1
            cuts.append(np.array([at], np.int64))
            pieces[i] += 1
    return np.sort(np.concatenate(cuts), kind="stable"), np.repeat(np.arange(len(pieces)), pieces)


def _tally(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """For each owner: distinct values, those there once, the commonest's count, places of repeated values."""
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (v[1:] != v[:-1])][:len(o)])
    count = np.diff(np.r_[new, len(o)])
    of = o[new]
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, count)
    return (np.bincount(of, minlength=n), np.bincount(of[count == 1], minlength=n), most,
            np.bincount(of, weights=np.where(count > 1, count, 0), minlength=n).astype(np.int64))


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The STATISTICS of the rows, in steps of 1/SCALE."""
    n = len(offsets) - 1
    kinds = np.zeros((len(_KINDS), n), np.int64)
    marks = np.zeros((_PER_WORD, n), np.int64)
    longest = np.zeros(n, np.int64)
    words, lines = [], []
    cuts, owners = _slices(data, offsets)
    for i, j in chunks(cuts):
        at, owner = cuts[i:j + 1], owners[i:j]
        raw = data[at[0]:at[-1]]
        for k, kind in enumerate(_KINDS):
            np.add.at(kinds[k], owner, np.diff(_sums(kind[raw], at - at[0])))
        w = Words(data, at, BY_SPACE)
        of = owner[w.row]
        heads = _sums(_HEAD[w.text], w.end) - _sums(_HEAD[w.text], w.start)
        letters = _sums(_LETTER[w.text], w.end) - _sums(_LETTER[w.text], w.start)
        for k, mark in enumerate((heads <= 3, _END[w.text[w.end - 1]], _CAPITAL[w.text[w.start]], letters == 0)):
            marks[k] += np.bincount(of[mark], minlength=n)
        np.maximum.at(longest, of, heads)
        words.append((of, w.hashes()))
        x = Words(data, at, _BY_LINE)
        lines.append((owner[x.row], x.hashes()))
    of, word = (np.concatenate(x) for x in zip(*words)) if words else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    of_line, line = (np.concatenate(x) for x in zip(*lines)) if lines else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    n_words, n_lines = np.bincount(of, minlength=n), np.bincount(of_line, minlength=n)
    distinct, once, most, _ = _tally(of, word, n)
    whole = np.flatnonzero(of[WINDOW - 1:] == of[:len(of) - WINDOW + 1]) if len(of) >= WINDOW else np.zeros(0, np.int64)
    window = np.zeros(len(whole), np.uint64)
    for k in range(WINDOW):
        window = mix(window + word[whole + k])
    repeated = _tally(of[whole], window, n)[3]
    characters, letter, capital, digit, symbol, exclamation, stop = kinds

    def ratio(part, total):
        return np.log(part + 0.5) - np.log(np.maximum(total - part, 0) + 0.5)

    short, ends, capitals, bare = marks
    out = [np.log1p(n_words), np.log1p(characters / np.maximum(n_words, 1)), ratio(letter, characters),
           ratio(capital, letter), ratio(digit, characters), ratio(symbol, characters), ratio(exclamation, characters),
           ratio(stop, characters), np.log1p(n_lines), ratio(n_lines - _tally(of_line, line, n)[0], n_lines),
           ratio(repeated, np.maximum(n_words - WINDOW + 1, 0)), ratio(distinct, n_words), ratio(most, n_words),
           ratio(short, n_words), ratio(ends, n_words), ratio(capitals, n_words), ratio(bare, n_words), np.log1p(longest),
           ratio(once, n_words)]
    return np.rint(np.stack(out, axis=1) * SCALE).astype(np.int32)


def with_statistics(docs: DataFrame, text: str = "text", name: str = "statistics") -> DataFrame:
    """docs without the text column, with the array of its STATISTICS times SCALE."""
    own, = fresh(docs, "text")
    kept = without(docs, text, name)
    given = docs.select(*[quoted(c) for c in kept.columns], quoted(text).cast("string").alias(own))
    schema = kept.withColumn(name, F.expr("cast(array() as array<int>)")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            parts = [measure(data, offsets[i:j + 1]) for i, j in chunks(offsets)]
            table = np.concatenate([np.zeros((0, len(STATISTICS)), np.int32), *parts])
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(STATISTICS), pa.int32()),
                                              pa.array(table.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], arrays], names=schema.names)

    return given.mapInArrow(run, schema)


class Model:
    """Centre and spread of the statistics; for each class its mean and inverse Cholesky factor; how they make a score."""

    def __init__(self, moments: np.ndarray, lam: float, gamma: float, temperature: float = 1.0):
        """moments[class] has n, the sums and the sums of products of the rows."""
        d = len(STATISTICS)
        n = moments[:, 0]
        self.temperature, self.classes = temperature, []
        self.constant = float((n[1] + 1) / (n.sum() + 2))
        if n.min() < 1:
            return
        total = moments.sum(axis=0) / n.sum()
        self.centre = total[1:d + 1]
        self.spread = np.sqrt(np.maximum(np.diag(total[d + 1:].reshape(d, d)) - self.centre**2, 1e-6))
        means, covariances = [], []
        for k in (0, 1):
            mean = moments[k, 1:d + 1] / n[k]
            covariance = moments[k, d + 1:].reshape(d, d) / n[k] - np.outer(mean, mean)
            means.append((mean - self.centre) / self.spread)
            covariances.append(covariance / np.outer(self.spread, self.spread))
        pooled = (n[0] * covariances[0] + n[1] * covariances[1]) / n.sum()
        for k in (0, 1):
            shrunk = (1 - lam) * covariances[k] + lam * pooled
            shrunk = (1 - gamma) * shrunk + gamma * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.classes.append((means[k], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n[k] / n.sum())))

    def difference(self, rows: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0, each with its class's share."""
        z = (rows - self.centre) / self.spread
        one = [constant - 0.5 * (((z - mean) @ inverse.T)**2).sum(axis=1) for mean, inverse, constant in self.classes]
        return one[1] - one[0]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(rows), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.difference(rows) / self.temperature, -500, 500)))


def _moments(rows: np.ndarray) -> np.ndarray:
    """n, sums and sums of products of integer rows."""
    x = rows.astype(np.int64)
    return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])


def fit(rows: DataFrame, label: str = "label", statistics: str = "statistics", tune: int = TUNE) -> Model:
    """The model of rows with STATISTICS and a label."""
    d = len(STATISTICS)
    size = 1 + d + d * d
    given = rows.select(quoted(label).cast("int").alias("label"), quoted(statistics).alias("x")).where(
        "label in (0, 1)").withColumn("hash", F.xxhash64("x", "label"))
    folded = given.withColumn("fold", F.pmod("hash", F.lit(FOLDS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * FOLDS, size), np.int64)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            which = 2 * batch.column(2).to_numpy() + batch.column(0).to_numpy()
            for k in range(2 * FOLDS):
                total[k] += _moments(x[which == k])
        which, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(place, pa.int32()), pa.array(total[which, place])],
                                         names=["which", "place", "n"])

    found = folded.select("label", "x", "fold").mapInArrow(run, "which int, place int, n long").groupBy("which", "place").agg(
        F.sum("n").alias("n")).toArrow()  # 2 * FOLDS * size numbers at most
    moments = np.zeros((FOLDS, 2, size))
    which = np.asarray(found["which"])
    scale = np.concatenate([[1.0], np.full(d, 1.0 / SCALE), np.full(d * d, 1.0 / SCALE**2)])
    moments[which // 2, which % 2, np.asarray(found["place"])] = np.asarray(found["n"])
    moments *= scale
    total = moments.sum(axis=0)
    if total[:, 0].min() < 2 * FOLDS:
        return Model(total, 0.5, 0.1)
    sample = folded.orderBy("hash", "x").limit(tune).select("label", "x", "fold").toArrow()
    x = np.array(sample["x"].to_pylist()) / SCALE
    y, fold = np.asarray(sample["label"]), np.asarray(sample["fold"])
    best = None
    for lam in LAMBDAS:
        for gamma in GAMMAS:
            odds = np.zeros(len(x))
            for k in range(FOLDS):
                part = Model(total - moments[k], lam, gamma)
                if part.classes:
                    odds[fold == k] = part.difference(x[fold == k])
            for temperature in TEMPERATURES:
                loss = np.logaddexp(0, np.where(y == 1, -odds, odds) / temperature).mean()
                if best is None or loss < best[0]:
                    best = loss, lam, gamma, temperature
    return Model(total, *best[1:])


def score(rows: DataFrame, model: Model, statistics: str = "statistics", threshold: float = 0.3) -> DataFrame:
    """rows with score (label 1 likelier where higher) and predicted (1 if score >= threshold) in place of the statistics."""
    kept = without(rows, statistics, "score", "predicted")
    schema = kept.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema
    shared = rows.sparkSession.sparkContext.broadcast(model)  # two factors of the number of statistics squared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, len(STATISTICS)) / SCALE
            found = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=schema.names)

    return rows.select(*[quoted(c) for c in kept.columns], quoted(statistics).alias(fresh(rows, "x")[0])).mapInArrow(run, schema)


def labelled(rows: DataFrame, labels: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the label that labels has for their key; keys whose labels disagree are left out."""
    own, = fresh(rows, "key")
    one = labels.groupBy(quoted(key).alias(own)).agg(F.min(quoted(value)).alias("label"), F.max(quoted(value)).alias("other"))
    one = one.where("label = other").drop("other")
    return without(rows, "label").join(one, quoted(key) == F.col(own)).drop(own)
