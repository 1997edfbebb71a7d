"""Operator 11 against a plain version of its contract."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from claimtext.llm import alignment
from tests.llm.data import documents, frame

ODD = ["<|endoftext|> in a text", "<s> </s> <unk> <0x41>", "a▁b", "▁", "  wide 　 space", "tail  ", "  head",
       "line\n\n  line\tx \n", "é́ ﬁ 漢字 🙂", "\x00\x01 nul", " "]


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(
            public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


def plain(rows, definition, model):
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_str(definition), sentencepiece.SentencePieceProcessor(model_proto=model)
    a.encode_special_tokens = True
    char = {c: k for k, c in enumerate(bytes(range(256)).decode("latin-1"))}
    shown = [k for k in range(256) if not (33 <= k <= 126 or 161 <= k <= 172 or k >= 174)]
    char |= {chr(256 + n): k for n, k in enumerate(shown)}
    made = {}
    for _, t in rows:
        if not t or t in made:
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        at = [0, 0]
        spelt, ends = [b"", b""], [[], []]
        for i in x:
            spelt[0] += bytes(char[c] for c in a.id_to_token(i))
            ends[0].append(len(spelt[0]))
        for i in y:
            p = b.id_to_piece(i)
            spelt[1] += bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
            ends[1].append(len(spelt[1]))
        if spelt[0] != spelt[1] or spelt[0] != b" " + t.encode():
            continue
        groups, links = [], []
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0].index(e, at[0]) + 1, ends[1].index(e, at[1]) + 1
            groups.append(",".join(map(str, x[at[0]:i])) + "|" + ",".join(map(str, y[at[1]:j])))
            links.append((x[i - 1], y[j - 1]))
            at = [i, j]
        made[t] = (len(x), len(y), groups, links)
    count = Counter(p for _, t in rows if t in made for p in made[t][3])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for d, t in rows:
        if t not in made:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, links = made[t]
        out.append((d, x, y, len(groups), len(links), sum(count[p] == most[p[1]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_alignment_is_that_of_the_contract(spark, files, monkeypatch):
    rows = documents(spark, [(20_000 + k, t) for k, t in enumerate(ODD)] + [(None, "a copied text"), (7, "a copied text")]
                     + [(30_000 + k, "a copied text") for k in range(40)])
    want = plain(rows, *files)
    assert got(alignment.align(frame(spark, rows), *files)) == want
    # short pieces and chunks, most pairs counted through the join, hot texts joined apart
    for name, value in (("PIECE", 50), ("CHUNK", 400), ("HOT", 4), ("UNITS", 30), ("ENCODED", 70),
                        ("TOGETHER", 8)):
        monkeypatch.setattr(alignment, name, value)
    assert got(alignment.align(frame(spark, rows), *files, frequent=20)) == want


def test_pieces_keep_the_tokens(files):
    aligner = alignment.Aligner(*files)
    assert aligner.parts
    text = " x".join(ODD) * 40 + "one  two three   four five" * 30
    whole = aligner.encode([text])
    old, alignment.PIECE = alignment.PIECE, 10
    try:
        parts = aligner.encode(aligner.pieces(text.replace("▁", "")))
        whole = aligner.encode([text.replace("▁", "")])
    finally:
        alignment.PIECE = old
    assert [sum(side, []) for side in parts] == [side[0] for side in whole] and len(parts[0]) > 50
    assert [aligner.units(t) for t in (" a b ", "a\n b", "c d\te", "f  g")] == [[" a", "b "], ["a\n b"], ["c", "d\te"], ["f  g"]]


def test_empty_table_and_clashing_names(spark, files):
    df = spark.createDataFrame([(1, "ab cd", "x", 5), (1, "ab cd", "x", 5), (2, None, None, None)],
                               "doc_id long, text string, key string, n_a int")
    out = alignment.align(df, *files)
    assert out.columns == ["doc_id", "text", "key", *alignment.MEASURES]
    rows = out.orderBy("doc_id").collect()
    assert len(rows) == 3 and rows[0] == rows[1] and rows[0].key == "x" and rows[0].count_sum == 2 * rows[0].n_links
    assert rows[2].n_a == 0 and rows[2].groups_sha256 == ""
    assert alignment.align(df.limit(0), *files).count() == 0
