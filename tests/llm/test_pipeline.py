"""The corpus pipeline against plain Python: which documents stay, their shares and their shards."""

import math
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from claimtext.llm import mixing, quality
from tests.conftest import SF001
from tests.llm import brute, data
from tests.llm.test_native import check_shards

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, docs, items):
    """A table folder of the given documents and benchmark items."""
    rows = [(i, t, None, None if k % 9 == 4 else "hot" if k % 3 else f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(docs)]
    data.frame(spark, rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    data.frame(spark, items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows


def kept_by_rules(text):
    """The verdict of the quality stage from counts of a whole text."""
    n, chars, symbols, dups, _, failed = brute.quality(text)
    text = text or ""
    letters = [c for c in text if c not in quality.ASCII_OTHER]
    m = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups,
         "n_lines": len([x for x in text.split("\n") if brute.SPACE_WORD.search(x)]), "n_letters": len(letters),
         "n_ascii_letters": len([c for c in letters if c in quality.ASCII_LETTERS]),
         "n_stop": len([w for w in brute.SPACE_WORD.findall(text) if w.lower() in quality.STOP_WORDS])}
    for measure, per, low, high, only in quality.RULES:
        if only is not None and m[only[0]] < only[2] * m[only[1]]:
            continue
        if (low is not None and m[measure] < low * m[per]) or (high is not None and m[measure] > high * m[per]):
            return False
    return not failed


def stay(rows, items):
    """The rows that the three filtering stages keep."""
    good = [r for r in rows if kept_by_rules(r[1])]
    ids = brute.component_ids([(r[0], r[1]) for r in good])
    one = [r for r, (i, _, c) in zip(good, ids) if i == c]
    bad = {i for i, *_, hit in brute.contamination([(r[0], r[1]) for r in one], items) if hit}
    return [r for r in one if r[0] not in bad]


def planted():
    """Copies, a near copy, a benchmark passage and a hot group, beside clean prose."""
    prose = ["the %s of a house is on the road and it was not far from there as they had said " % w +
             " ".join(f"{w}{k} and the b{w}{k * 7 % 31}" for k in range(40)) for w in ("tree", "cloud", "stone", "river")]
    passage = " ".join(f"exam{k} of" for k in range(12))
    docs = [(20_000 + k, t) for k, t in enumerate(prose)]
    docs += [(20_010 + k, prose[0]) for k in range(40)]
    docs += [(20_100, prose[1] + " end"), (20_101, prose[2] + " " + passage), (20_102, passage + "\n" + prose[3].upper())]
    return docs, [(1, passage), (2, None), (3, "")]


def test_pipeline_against_brute_force(spark, tmp_path):
    more, items = planted()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items += [(100 + r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    rows = folder(spark, tmp_path, docs + data.odd_rows() + more, items)
    expected = stay(rows, items)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:5] == [c.split()[0] for c in COLUMNS.split(", ")]
    got = out.collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) == {r[0] for r in expected}
    assert max(times.values()) <= 2
    assert {tuple(r)[:5] for r in got} == set(expected)
    check_shards(got, len(got), 24)
    # shares of the sources: whole first epochs, then up to the quota of the exponent
    own, total, longest = defaultdict(int), defaultdict(int), 0
    for r in expected:
        own[r[3]] += len(brute.SPACE_WORD.findall(r[1])) + 1
        longest = max(longest, len(brute.SPACE_WORD.findall(r[1])) + 1)
    for r in got:
        total[r.source] += len(brute.SPACE_WORD.findall(r.text)) + 1
    most, whole = max(own.values()), sum(own.values())
    least = min(own.values())
    # max p**(t-1) / min p**(t-1) = 2, or t = 0 where the sources are that even
    t = max(0.0, 1 - math.log(mixing.MAX_REPEATS) / math.log(most / least)) if most > least else 0
    cover = max((n / whole) ** (1 - t) for n in own.values())
    for s, n in own.items():
        quota = max(n, whole * cover * (n / whole) ** t)
        assert quota - 1 <= total[s] <= quota + longest + 1


def test_each_stage_keeps_the_columns(spark, tmp_path):
    more, items = planted()
    rows = folder(spark, tmp_path, more, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {20_101, 20_102}


@pytest.mark.parametrize("text", [None, "short"])
def test_pipeline_of_nothing(spark, tmp_path, text):
    folder(spark, tmp_path, [] if text is None else [(1, text), (2, None)], [(1, "a b")])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
