"""Operator 12: plain statistics, a dense discriminant, held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimtext.llm import discriminant as D
from claimtext.llm.queries import op12_discriminant
from claimtext.llm.words import text_bytes
from tests.conftest import SF01
from tests.llm.data import documents


def plain(text):
    b = (text or "").encode()
    words = [w for w in b.translate(bytes(32 if x in b" \t\n\x0b\x0c\r" else x for x in range(256))).split(b" ") if w]
    lines = [x for x in b.split(b"\n") if x]
    n = len(words)

    def letter(x):
        return 65 <= x < 91 or 97 <= x < 123 or x >= 0xC0

    def log(part, total):
        return np.log(part + .5) - np.log(max(total - part, 0) + .5)

    def size(x):
        return sum(c & 0xC0 != 0x80 for c in x)

    chars, letters = size(b), sum(map(letter, b))
    count, windows = Counter(words), Counter(zip(words, words[1:], words[2:]))
    of = lambda s: sum(x in s for x in b)
    caps = bytes(range(65, 91))
    return [np.log1p(n), np.log1p(chars / max(n, 1)), log(letters, chars), log(of(caps), letters),
            log(of(b"0123456789"), chars), log(of(b"#*$%&|<>"), chars), log(of(b"!"), chars), log(of(b".,;:?"), chars),
            np.log1p(len(lines)), log(len(lines) - len(set(lines)), len(lines)),
            log(sum(k for k in windows.values() if k > 1), max(n - 2, 0)), log(len(count), n),
            log(max(count.values(), default=0), n), log(sum(size(w) <= 3 for w in words), n),
            log(sum(w[-1] in b".!?" for w in words), n), log(sum(w[0] in caps for w in words), n),
            log(sum(not any(map(letter, w)) for w in words), n), np.log1p(max(map(size, words), default=0)),
            log(sum(k == 1 for k in count.values()), n)]


def test_statistics_are_the_plain_ones(spark, monkeypatch):
    texts = [t for _, t in documents(spark)]
    want = np.array([plain(t) for t in texts])
    got = D.measure(*text_bytes(pa.array(texts, pa.string())))
    assert np.abs(got / D.SCALE - want).max() <= 0.5 / D.SCALE + 1e-9
    # long texts in slices: without line breaks the statistics stay
    flat = [(t or "").replace("\n", " ") for t in texts]
    whole = D.measure(*text_bytes(pa.array(flat, pa.string())))
    monkeypatch.setattr(D, "SLICE", 64)
    sliced = D.measure(*text_bytes(pa.array(flat, pa.string())))
    same = [k for k, name in enumerate(D.STATISTICS) if "lines" not in name]
    assert (whole[:, same] == sliced[:, same]).all()


def dense(x, y, lam, gamma):
    """Log-density differences from covariances of standardised rows, by solving."""
    z = (x - x.mean(axis=0)) / np.sqrt(np.maximum(x.var(axis=0), 1e-6))
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * own[k] for k in (0, 1))
    out = []
    for k in (0, 1):
        c = (1 - lam) * own[k] + lam * pooled
        c = (1 - gamma) * c + gamma * np.trace(c) / len(c) * np.eye(len(c))
        e = z - z[y == k].mean(axis=0)
        out.append(np.log((y == k).mean()) - 0.5 * (e * np.linalg.solve(c, e.T).T).sum(axis=1) - 0.5 * np.linalg.slogdet(c)[1])
    return out[1] - out[0]


def test_model_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    d = len(D.STATISTICS)
    y = rng.integers(0, 2, 400)
    x = np.rint(rng.normal(size=(400, d)) * (1 + y[:, None]) * 700 + 300 * y[:, None]).astype(int)
    rows = spark.createDataFrame([(int(a), [int(v) for v in b]) for a, b in zip(y, x)], "label int, statistics array<int>")
    model = D.fit(rows.repartition(5))
    moments = np.stack([D._moments(x[y == k]) for k in (0, 1)]).astype(float)
    moments[:, 1:d + 1] /= D.SCALE
    moments[:, d + 1:] /= D.SCALE**2
    for lam, gamma in ((0.0, 0.001), (0.4, 0.1)):
        np.testing.assert_allclose(D.Model(moments, lam, gamma).difference(x / D.SCALE), dense(x / D.SCALE, y, lam, gamma),
                                   rtol=1e-7, atol=1e-6)
    assert ((model.scores(x / D.SCALE) >= 0.5) == y).mean() > 0.95
    again = D.fit(rows.repartition(2))  # the same to the last bit under another partitioning
    assert (again.scores(x / D.SCALE) == model.scores(x / D.SCALE)).all()


@pytest.fixture(scope="module")
def held(spark):
    rows = op12_discriminant(spark, SF01).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    return rows, labels


def test_held_out_quality(spark, held):
    rows, labels = held
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(test) > 50 and np.mean([a == b for a, b in test]) >= 0.95


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, "ab cd", "x"), (1, "ab cd", "x"), (2, None, None), (None, "", "y")],
                               "doc_id long, text string, score string").withColumn("statistics", D.F.lit("s"))
    rows = D.with_statistics(df)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (None, 0), (3, 7)], "doc_id long, quality int")
    learnt = D.labelled(rows, labels, "doc_id", "quality")
    assert [(r.doc_id, r.label) for r in learnt.collect()] == [(2, 1)]
    out = D.score(rows, D.fit(learnt)).orderBy("doc_id").collect()
    assert len(out) == 4 and {r.score for r in out} == {2 / 3} and out[0].doc_id is None
    empty = rows.limit(0)
    model = D.fit(empty.withColumn("label", D.F.lit(1)))
    assert model.scores(np.zeros((2, len(D.STATISTICS)))).tolist() == [0.5, 0.5]
    assert D.score(empty, model).count() == 0
    assert D.measure(*text_bytes(pa.array([], pa.string()))).shape == (0, len(D.STATISTICS))
