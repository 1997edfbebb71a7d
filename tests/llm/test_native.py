"""Quality, mixing, sharding, line dedup and quotation linking against plain Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimtext.llm import lines, mixing, quality, quotes, sharding
from tests.llm import brute, data


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan


@pytest.fixture(scope="module")
def rows(spark):
    return data.documents(spark, [(None, "null id here"), (10_100, "same id, other text")])


def test_quality_measures(spark, rows):
    judged = quality.judge(data.frame(spark, rows))
    no_python(judged)
    got = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *brute.quality(t)) for i, t in rows], key=str)
    assert judged.where("kept and base_failed").isEmpty()


def test_quality_rules(spark):
    prose = " ".join(f"the {w} of a" for w in "cat dog bird tree house road river stone cloud garden window door".split())
    prose = prose + " and then " + " ".join(f"word{chr(97 + k)}" for k in range(26))
    texts = {1: prose, 2: prose.replace("the", "###"), 3: " ".join(f"zq{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)),
             4: None, 5: " ".join(["Слово%s" % chr(0x430 + k % 30) * (1 + k // 30) for k in range(80)])}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, n_words int")
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}
    kept = quality.keep(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(1, texts[1], 1), (5, texts[5], 1)]


def test_quality_empty(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sources(spark, n=1500):
    """A hot source, small ones, a null one; clashing column names."""
    out = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{i % 12}"
        out.append((i, " ".join(["w"] * (i % 40)) if i % 100 else None, s, i))
    return spark.createDataFrame(out, "doc_id long, text string, source string, place int").repartition(4)


def shares(docs):
    n = defaultdict(int)
    for r in docs.collect():
        n[r.source] += len((r.text or "").split()) + 1
    return n


@pytest.mark.parametrize("limit", [1.0, 2.0, 5.0])
def test_mixing_covers_and_repeats(spark, limit):
    docs = sources(spark)
    mixed = mixing.mix(docs, max_repeats=limit, block_tokens=2000)
    no_python(mixed)
    got = mixed.collect()
    own = shares(docs)
    times = Counter(r.doc_id for r in got)
    assert set(times) == set(range(1500)) and max(times.values()) <= math.ceil(limit)
    total = defaultdict(int)
    for r in got:
        total[r.source] += r.n_tokens
    p = {s: x / sum(own.values()) for s, x in own.items()}
    t = mixing.exponent(mixing.source_totals(docs, "source", "text"), limit)
    assert max(x ** (t - 1) for x in p.values()) / min(x ** (t - 1) for x in p.values()) <= limit + 1e-6
    z = sum(x ** t for x in p.values())
    for s in p:  # the realised stream has the weights, but for one document at the end of a quota
        quota = p[s] ** t / z * sum(total.values())
        assert abs(total[s] - quota) <= 60 + 0.01 * quota
    # inside an epoch a source's rows lie end to end
    by = defaultdict(list)
    for r in got:
        by[r.source, r.epoch].append((r.start, r.n_tokens))
    for (s, epoch), x in by.items():
        at = epoch * own[s]
        for start, n in sorted(x):
            assert start == at
            at += n


def test_mixing_entropy_and_budget(spark):
    docs = sources(spark)
    totals = mixing.source_totals(docs, "source", "text")
    p = [r.share for r in totals.collect()]

    def entropy(t):
        w = [x ** t / sum(y ** t for y in p) for x in p]
        return -sum(x * math.log(x) for x in w)

    target = (entropy(0) + entropy(1)) / 2
    assert abs(entropy(mixing.exponent(totals, None, target)) - target) < 1e-6
    mixed = mixing.mix(docs, None, target, budget=6000, block_tokens=1000)
    n = mixed.agg(F.sum("n_tokens")).first()[0]
    assert 6000 <= n <= 6000 + 14 * 41 and mixed.agg(F.max("block")).first()[0] == 5
    with pytest.raises(ValueError):
        mixing.exponent(totals, None, None)


@pytest.mark.parametrize("sizes, entropy", [((70, 30), 0.2), ((70, 30), 0.65), ((9, 9, 1), 0.7), ((50, 30, 20), 0.01),
                                            ((501, 500), 0.001)])
def test_mixing_entropy_below_the_sources_own(spark, sizes, entropy):
    """Any entropy between that of the largest sources alone and that of equal weights is met."""
    rows = [(k * 1000 + i, "", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    totals = mixing.source_totals(docs, "source", "text")
    t = mixing.exponent(totals, None, entropy)
    w = [(n / max(sizes)) ** t for n in sizes]
    w = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in w if x) - entropy) < 1e-5
    plan = {r.source: r.weight for r in mixing.quotas(totals, t, 1000).collect()}
    assert all(abs(plan[f"s{k}"] - x) < 1e-6 for k, x in enumerate(w))


def test_mixing_targets_that_nothing_meets(spark):
    docs = spark.createDataFrame([(k, "", "ab"[k % 2]) for k in range(10)] + [(99, "", "c")], "doc_id long, text string, source string")
    totals = mixing.source_totals(docs, "source", "text")
    for entropy in (1.2, 0.5):  # above ln 3; below ln 2, that of the two largest alone
        with pytest.raises(ValueError):
            mixing.exponent(totals, None, entropy)
    for budget in (23, 10_000):
        with pytest.raises(ValueError):
            mixing.exponent(totals, 2.0, budget=budget)
    assert mixing.exponent(totals, 2.0, budget=22) == 1.0
    with pytest.raises(ValueError):
        mixing.exponent(totals, 0.5)
    even = mixing.source_totals(docs.where("source <> 'c'"), "source", "text")
    assert mixing.exponent(even, None, math.log(2)) == 1.0


def test_mixing_empty_and_single(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s")], "doc_id long, text string, source string")
    assert mixing.mix(one).count() == 2


def check_shards(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == n
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return by


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_sharding_rows_law(spark, rows, shards):
    more = rows + [(None, "x")] * 5 + [(3, None)] * 4
    got = sharding.shard(data.frame(spark, more), shards).collect()
    check_shards(got, len(more), shards)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(more)


def test_sharding_movement_and_bound():
    rng = __import__("numpy").random.default_rng(3)
    counts = rng.poisson(2.0, 1 << sharding.CELL_BITS)

    def owner(shards, slack):
        out = {}
        for cell, low, high, s, _ in sharding.pieces(counts, shards, slack=slack):
            for k in range(low, high):
                out[cell, k] = s
        sizes = Counter(out.values())
        assert sum(sizes.values()) == counts.sum()
        assert all(sizes[s] <= b for s, b in enumerate(sharding.bounds(int(counts.sum()), shards, slack)))
        return out

    for slack, most in ((0.0, 0.35), (0.25, 0.12)):
        a, b = owner(24, slack), owner(25, slack)
        assert sum(a[k] != b[k] for k in a) / len(a) < most


def test_sharding_hot_cell():
    counts = __import__("numpy").zeros(1 << sharding.CELL_BITS, int)
    counts[5], counts[60000] = 1000, 7
    parts = sharding.pieces(counts, 24)
    assert sum(high - low for _, low, high, _, _ in parts) == 1007


def test_sharding_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, shard string, cell int")
    out = sharding.shard(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "cell", "shard", "slot"]


def test_line_dedup(spark):
    block = "\n".join(f"shared line {k} of a license" for k in range(40))
    rows = [(k, f"own {k}\nsecond {k}\n{block}\nlast {k}") for k in range(6)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "one"), (104, block), (104, block), (None, block), (105, block)]
    rows += [(200 + k, "x") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lines.dedup(df)
    no_python(out)
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    texts = dict(rows)
    assert got[100][0].kept_text is None and got[101][0].kept_text == "" and got[102][0].kept_text == "\n\n\n"
    assert got[0][0].kept_text == texts[0]  # the earliest stays whole
    for k in range(1, 6):
        r = got[k][0]
        assert r.n_removed_lines >= 25 and f"own {k}" in r.kept_text and f"last {k}" in r.kept_text
        kept = set(r.kept_text.split("\n"))
        assert r.n_lines == len(texts[k].split("\n")) and kept <= set(texts[k].split("\n"))
    assert len(got[104]) == 2 and got[104][0].kept_text == got[104][1].kept_text  # one document seen twice
    assert got[None][0].n_removed_lines >= 25 and got[105][0].n_removed_lines >= 25
    assert all(got[200 + k][0].kept_text == "x" for k in range(4))  # single lines stay


def test_line_dedup_empty_table(spark):
    assert lines.dedup(spark.createDataFrame([], "doc_id long, text string, lines int")).count() == 0


CHAT = [
    (1, 0, "user", "How do I sort a table?\nIt has many rows."),
    (1, 1, "assistant", "Use the order by clause."),
    (1, 2, "user", "> Use the ORDER  by clause.\nThat is slow."),
    (1, 3, "assistant", ">> Use the order by clause.\n> That is slow.\n\nAdd an index then."),
    (1, 4, "user", "> How do I sort a table?\n> It has many rows.\nAnother way is to sort outside."),
    (1, 5, "user", "> never said by anyone\nhello"),
    (2, 0, "user", "That is slow."), (2, 1, None, None), (2, 2, "user", ""), (2, 2, "user", "> That is slow.\nyes"),
    (None, 1, "user", "That is slow."), (3, None, "user", "> That is slow."), (4, 1, "user", "> later\nx"),
    (4, 2, "user", "later"),
]


def test_quotation_links(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(3)
    out = quotes.conversations(df)
    no_python(out)
    rows = out.collect()
    assert len(rows) == len(CHAT)
    got = {(r.conv_id, r.turn): r for r in rows if r.conv_id == 1}
    assert {k[1]: (r.parent, r.thread, r.depth) for k, r in got.items()} == {
        0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (2, 1, 2), 4: (0, 0, 1), 5: (None, 5, 0)}
    assert got[1, 3].body == "Add an index then." and got[1, 3].n_quoted == 2
    assert got[1, 2].chat == "<|user|>\nThat is slow."
    other = sorted((r.turn, r.parent, r.body) for r in rows if r.conv_id == 2)
    assert other == [(0, None, "That is slow."), (1, None, ""), (2, 0, ""), (2, 0, "yes")]
    assert [r.parent for r in rows if r.conv_id == 4] == [None, None]  # a later message is no original
    assert [r.chat for r in rows if r.role is None] == ["<|unknown|>\n"]


def test_quotation_long_chain_and_empty(spark):
    chain = [(9, 0, "user", "message number 0")]
    chain += [(9, k, "user", f"> message number {k - 1}\nmessage number {k}") for k in range(1, 20)]
    df = spark.createDataFrame(chain, "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.thread, r.depth) for r in quotes.conversations(df).collect()}
    assert got == {k: (0, k) for k in range(20)}
    assert quotes.conversations(df.limit(0)).count() == 0


def parents(spark, texts, conv=1):
    df = spark.createDataFrame([(conv, k, "user", t) for k, t in enumerate(texts)],
                               "conv_id long, turn long, role string, text string").repartition(3)
    return {r.turn: r.parent for r in quotes.conversations(df).collect()}


def test_quotation_of_parts(spark):
    """Interleaved, one paragraph of several, two messages in succession, only deep quotes, wrapped anew."""
    got = parents(spark, [
        "first line here\nsecond line here", "one paragraph\nof two lines\n\nanother paragraph", "a message alone",
        "> first line here\nyes\n> second line here\nno", "> another paragraph\nright", "> one paragraph of two lines\nwrong",
        "> one paragraph\n> a message alone\nboth", ">> a message alone\ndeep", "> first line\n> here second line here\nwrapped",
        ">> first line here\n> yes\nwhy", "hi", "hi", "> hi\n> a message alone", "> hi", "hi", "> never\n> said"])
    assert got == {0: None, 1: None, 2: None, 3: 0, 4: 1, 5: 1, 6: 2, 7: 6, 8: 0, 9: 3, 10: None, 11: None, 12: 2, 13: 11,
                   14: None, 15: None}


def test_quotation_against_all_pairs(spark):
    """Frequent lines quoted in any mix: the candidates lose no better parent."""
    rng = __import__("random").Random(5)
    said = [f"line {c * (k + 1)}" for k, c in enumerate("abcdef")]
    texts = ["\n\n".join(f"{'>' * rng.choice([0, 0, 0, 1, 1, 2])} {rng.choice(said[:rng.randint(1, 6)])}\nown {k} {j}"
                         for j in range(rng.randint(1, 4))) for k in range(120)]
    rows = [[(x[:2].count(">"), x.lstrip("> ")) for x in t.split("\n") if x] for t in texts]
    want = {}
    for t, own in enumerate(rows):
        best = (0, 0, 0, None)
        for p in range(t):
            n = [0, 0, 0]
            for level, line in own:
                at = [low for low, x in rows[p] if x == line and low < level]
                if at:
                    n[0] += len(line) * (level == 1)
                    n[1] += len(line) * (level - 1 in at)
                    n[2] += len(line)
            if n[2]:
                best = max(best, (*n, p), key=lambda b: (b[:3], -1 if b[3] is None else b[3]))
        want[t] = best[3]
    assert parents(spark, texts) == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xxhash64(text):
    import xxhash
    return signed(xxhash.xxh64_intdigest(text.encode(), 42))


def rolling(seed, x, y):
    import struct

    import xxhash
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for v in (x, y):
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return signed(h)


def brute_chunks(full, seed, low):
    """(first, end) of the chunks of a list of lines without blank ones."""
    h = [xxhash64(x) for x in full]
    r = [rolling(seed, *x) * (1 if low else -1) for x in zip(h, h[1:])]
    pairs = [k for k, x in enumerate(r) if (k == 0 or x < r[k - 1]) and (k == len(r) - 1 or x <= r[k + 1])]
    cuts = sorted({0, len(full), *pairs, *(k + 2 for k in pairs)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out += [(k, min(k + lines.MAX_LINES, b)) for k in range(a, b, lines.MAX_LINES)]
    return out


def brute_line_dedup(rows):
    """{(id, text): (kept lines, chunks, removed chunks)} by plain loops; rows that agree are one."""
    own = {r: [x for x in r[1].split("\n") if brute.SPACE_WORD.search(x)] for r in rows if r[1] is not None}
    place = {r: (r[0] is None, r[0] or 0, xxhash64(r[1])) for r in own}
    chunks = {r: {c for seed in lines.SEEDS for low in (True, False) for c in brute_chunks(x, seed, low) if c[1] - c[0] > 1}
              for r, x in own.items()}
    first = {}
    for r, x in own.items():
        for a, b in chunks[r]:
            first[tuple(x[a:b])] = min(first.get(tuple(x[a:b]), (*place[r], a, r)), (*place[r], a, r), key=lambda p: p[:4])
    out = {}
    for r, x in own.items():
        gone = set()
        for a, b in chunks[r]:
            *at, e, of = first[tuple(x[a:b])]
            if (*at, e) >= (*place[r], a):
                continue
            y, f, left, right = own[of], e + b - a, 0, 0
            while left < min(lines.GROW, a, e) and x[a - left - 1] == y[e - left - 1]:
                left += 1
            while right < min(lines.GROW, len(x) - b, len(y) - f) and x[b + right] == y[f + right]:
                right += 1
            gone.update(range(a - left, b + right))
        raw = r[1].split("\n")
        at = [k for k, line in enumerate(raw) if brute.SPACE_WORD.search(line)]
        kept = raw[:at[0] if at else len(raw)] if 0 not in gone else []
        for k, (i, end) in enumerate(zip(at, at[1:] + [len(raw)])):
            if k not in gone:
                kept += raw[i:end]
            elif k + 1 < len(at) and k + 1 not in gone:
                kept += raw[i + 1:end]
        of_one = brute_chunks(x, lines.SEEDS[0], True)
        out[r] = kept, len(of_one), sum(gone >= set(range(*c)) for c in of_one)
    return out


@pytest.mark.parametrize("length", [2, 3, 4, 6, 10, 20])
def test_line_dedup_short_passages(spark, length):
    """A passage goes whole from the later copy; of two lines, that a boundary may part, most do."""
    rows = []
    for p in range(20):
        passage = "\n".join(f"passage {p} of {length} line {k}" for k in range(length))
        rows += [(2 * p + c, f"own {p} {c}\nsecond {p} {c}\n{passage}\nlast {p} {c}") for c in (0, 1)]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    no_python(out)
    whole = 0
    for r in out.collect():
        p, c = divmod(r.doc_id, 2)
        if r.n_removed_lines:
            assert r.n_removed_lines == c * length and r.kept_text == f"own {p} {c}\nsecond {p} {c}\nlast {p} {c}"
            whole += 1
        else:
            assert r.kept_text == r.text
    assert whole >= (15 if length == 2 else 20)


MORE = [(300, "la\nla\nla\nla\nla"), (301, "la\n\nla"), (302, "x\nla\nla"), (303, None), (304, ""), (305, "\n\n"),
        (306, "a\nb\n\nc"), (307, "b\n\nc\nd"), (308, "b\nc"), (309, "q\nr"), (309, "z\nq\nr"), (None, "q\nr\ns"),
        (None, "t\nu"), (None, "t\nu\nv"), (310, "a\nb"), (310, "a\nb"), (311, "\n\na\n \nb\n\n"), (312, "a\nb\n\n\nnew\n\na\nb")]


def test_line_dedup_against_brute(spark, rows):
    rng = __import__("random").Random(4)
    more = rows + MORE + [(400 + k, "\n".join(rng.choice("abcdefgh \t") for _ in range(rng.randint(1, 60)))) for k in range(40)]
    passage = [f"line {k}" for k in range(60)]
    more += [(500 + k, "\n".join([f"own {k}", *passage[rng.randint(0, 20):rng.randint(30, 60)], f"end {k}"])) for k in range(20)]
    want = brute_line_dedup(more)
    got = lines.dedup(data.frame(spark, more)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(more)
    kept = set()
    for r in got:
        if r.text is None:
            assert r.kept_text is None and r.n_removed_lines == r.n_lines == r.n_chunks == 0
            continue
        left, n, removed = want[r.doc_id, r.text]
        assert r.kept_text == "\n".join(left), r.doc_id
        n_lines = len(r.text.split("\n"))
        assert (r.n_lines, r.n_removed_lines, r.n_chunks, r.n_removed_chunks) == (n_lines, n_lines - len(left), n, removed)
        kept.update(left)
    assert all(line in kept for _, t in more if t for line in t.split("\n") if brute.SPACE_WORD.search(line))  # nothing is lost


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Lines of one hash and other bytes are never taken for copies."""
    monkeypatch.setattr(lines, "line_hash", lambda line: F.when(line.startswith("clash"), 5).otherwise(F.xxhash64(line)))
    rows = [(k, f"clash {k}\nclash {k + 100}\nclash {k + 200}") for k in range(20)]
    rows += [(100 + k, "same one\nsame two\nclash 1\nsame three\nsame four") for k in range(3)]
    got = {r.doc_id: r.kept_text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == t for k, t in rows[:21]) and got[101] == got[102] == "clash 1"


def test_line_dedup_query_takes_short_passages(spark, tmp_path):
    from claimtext.llm.queries import op7_line_dedup
    rows = [(k, f"own {k}\nshared one\nshared two\nshared three\nend {k}") for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed_lines for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: 3 * (k > 0) for k in range(30)}


OTHER_PROSE = {
    "id": "Pagi itu petani yang tua pergi ke sawah dengan anaknya karena hujan sudah turun. Mereka membawa bibit padi dan "
          "bekerja sampai siang di bawah matahari. Setelah itu ibu datang dengan nasi hangat untuk semua orang yang lapar. "
          "Air dari sungai mengalir pelan ke ladang, dan burung kecil bernyanyi di pohon. Malam tiba, lalu keluarga itu "
          "pulang ke rumah mereka di desa.",
    "sw": "Mkulima mzee alikwenda shambani na mtoto wake kwa sababu mvua ilinyesha usiku. Walibeba mbegu za mahindi na "
          "kufanya kazi hadi mchana chini ya jua kali. Baadaye mama alileta chakula cha moto kwa watu wote. Maji ya mto "
          "yalitiririka polepole katika bustani, na ndege wadogo waliimba juu ya mti. Usiku ulipofika familia ilirudi "
          "nyumbani kwa furaha kubwa sana.",
    "sv": "Den gamla bonden gick ut på åkern med sin son när regnet hade slutat. De bar säckar och arbetade till middag under "
          "solen som var stark. Sedan kom mor med varm mat till alla som hade varit ute. Vattnet från ån rann sakta över "
          "ängen, och små fåglar sjöng i träden. När kvällen kom gick familjen hem till byn och sov.",
    "vi": "Người nông dân già đi ra đồng với con trai của ông khi mưa đã tạnh. Họ mang hạt giống và làm việc đến trưa dưới "
          "ánh nắng. Sau đó mẹ mang cơm nóng đến cho mọi người. Nước từ sông chảy chậm vào ruộng, và những con chim nhỏ hát "
          "trên cây. Khi đêm đến gia đình trở về nhà ở trong làng.",
    # Samoan and Maori have no list
    "sm": "Na alu le tamaloa i le faatoaga ma lona atalii ina ua uma le timu. Sa la ave fatu ma galulue i le la vevela. Mulimuli "
          "ane sa sau le tina ma le taumafa mo tagata uma. O le vai sa tafe lemu i le laueleele, ma sa pepese manu laiti i luga "
          "o le laau. Ina ua po, sa toe foi le aiga i le nuu.",
    "mi": "I haere te kaumatua ki te mara me tana tama i te mutunga o te ua. I kawea e raua nga purapura me te mahi i raro i te "
          "ra. Muri iho ka tae mai te whaea me te kai wera mo nga tangata katoa. I rere te wai o te awa ki te mara, a ka waiata "
          "nga manu iti i runga i te rakau. I te po ka hoki te whanau ki te kainga.",
}


def test_quality_other_languages(spark):
    """Clean prose in languages without stop words is kept; word lists and menus are not."""
    rng = __import__("random").Random(2)
    menu = "Login Register Products Services Download Gallery Support Pricing Careers Partners Events Blog Press Shop Cart".split()
    junk = {"menu": " ".join(f"{w} {w[::-1]}" for w in menu * 2), "random": " ".join(
        "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(90)),
        "keywords": " ".join(rng.sample([f"{a}{b}" for a in ("foto", "video", "mp3", "game", "hotel") for b in menu], 70))}
    df = spark.createDataFrame(list((OTHER_PROSE | junk).items()), "doc_id string, text string")
    judged = quality.judge(df)
    no_python(judged)
    got = {r.doc_id: r for r in judged.collect()}
    assert all(r.n_words >= 50 for r in got.values())
    assert {k for k, r in got.items() if r.kept} == set(OTHER_PROSE)
    assert {r.doc_id for r in quality.keep(df).collect()} == set(OTHER_PROSE)
    assert "kept" in judged.columns and judged.columns[:2] == ["doc_id", "text"] and len(judged.columns) == 13
