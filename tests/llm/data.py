"""Small fixtures: real rows of the smallest tables plus planted odd cases."""

import random

from tests.conftest import SF001

ODD = [None, "", " \t\n\x0b\x0c\r ", "one", "a b c", "UPPER lower Üñï 漢字 かな words here", "\x00 nul \x00\x01 word",
       "x " * 3000, "a b " * 40, "ab cd ef gh", "> quoted\n>> twice\nplain", "#*$%&|<>", "ÀÉ é́ ö"]


def odd_rows(start=10_000):
    """(id, text) with nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(6)]
    rows = [(start + i, t) for i, t in enumerate(ODD)]
    rows += [(start + 50, long), (start + 51, long)]
    for i, t in enumerate(base):
        w = t.split()
        rows += [(start + 100 + 10 * i, t), (start + 101 + 10 * i, t), (start + 102 + 10 * i, t.upper()),
                 (start + 103 + 10 * i, " ".join(w[:60] + ["zzz"] + w[61:])),
                 (start + 104 + 10 * i, " ".join(w[10:90] + base[(i + 1) % 6].split()[:50]))]
    return rows


def documents(spark, extra=()):
    """The smallest documents table (id, text) as rows, with the odd ones."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    return rows + odd_rows() + list(extra)


def frame(spark, rows, columns="doc_id long, text string", parts=5):
    return spark.createDataFrame(rows, columns).repartition(parts)
