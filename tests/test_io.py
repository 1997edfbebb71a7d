"""Sources and sinks: round trips in scratch folders."""

import os
import tempfile

from pyspark.sql import functions as F

from claimtext.sources import tables as TB
from claimtext.sources import text_files as TF


def test_ordered_lines_and_append(spark):
    d = tempfile.mkdtemp(prefix="claimtext-io-")
    p = os.path.join(d, "listing.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("S00 a\n\nS000 b\r\nS01 c\n")
    got = [(r["line_no"], r["line"]) for r in TF.read_lines(spark, p, ordered=True).orderBy("line_no").collect()]
    assert got == [(0, "S00 a"), (2, "S000 b"), (3, "S01 c")]
    out = os.path.join(d, "out")
    df = spark.createDataFrame([("x",), ("y",)], "w string")
    TF.append_text(df, out)
    TF.append_text(df, out)
    assert TF.read_lines(spark, out).count() == 4


def test_artifacts_round_trip_and_csv(spark):
    d = tempfile.mkdtemp(prefix="claimtext-io-")
    members = spark.createDataFrame([("genou",), ("main",)], "member string")
    tuples = spark.createDataFrame([(1, 0, "a b", "genou", "gauche")], "claim_id long, seq int, phrase string, member string, side string")
    TB.save_artifacts({"members": members, "tuples": tuples}, d)
    TB.save_artifacts({"members": members, "tuples": tuples}, d)  # rerun is idempotent
    loaded = TB.load_artifacts(spark, d, ["members", "tuples"])
    assert sorted(r[0] for r in loaded["members"].collect()) == ["genou", "main"]
    assert loaded["tuples"].count() == 1
    TB.write_csv(tuples, os.path.join(d, "csv"), order_by=["claim_id"])
    back = TB.read_table(spark, os.path.join(d, "csv"), fmt="csv", schema=tuples.schema)
    assert back.select(F.col("phrase")).first()[0] == "a b"


def test_html_container(spark):
    from claimtext.sources import html as HT
    pages = spark.createDataFrame([
        (1, '<html><div class="nav">x</div><div class="main ad">Bonjour &amp; <b>salut</b></div></html>'),
        (2, "<html><p>none</p></html>"),
        (3, '<div class="ad">a<div class="in">b</div>c</div>'),
    ], "page_id long, html string")
    more = spark.createDataFrame([
        (4, "<div class='ad'>q</div>"), (5, '<DIV id=x CLASS="x ad y">a<div>b</div><!-- </div> --><p>c</DIV>d'),
        (6, '<div class="screen"></div><div class="ad">&eacute; &#233; &#xE9; &#128512; &nope; &amp;lt; 1 < 2</div>'),
        (7, '<div class="adx">no</div>'), (8, None), (9, '<div class="ad">open <div>end'), (10, '<div class="ad"></div>'),
        (11, '<div class="ad">' + "<div>a" * 3000 + "</div>" * 3000 + "z</div>tail"),
    ], "page_id long, html string")
    got = {r["page_id"]: r["t"] for r in
           pages.unionByName(more).select("page_id", HT.container_text("html", "ad").alias("t")).collect()}
    assert got == {1: "Bonjour & salut ", 2: None, 3: "abc ", 4: "q ", 5: "abc ", 6: "é é é 😀 &nope; &lt; 1 < 2 ",
                   7: None, 8: None, 9: "open end ", 10: " ", 11: "a" * 3000 + "z "}


def test_unordered_lines_and_csv_needs_schema(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="claimtext-io-")
    p = os.path.join(d, "corpus.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("genou\n\n  \nmain\n")
    assert sorted(r["line"] for r in TF.read_lines(spark, p).collect()) == ["genou", "main"]
    with pytest.raises(ValueError):
        TB.read_table(spark, p, fmt="csv")


def test_html_comments_and_quoted_values(spark):
    from claimtext.sources import html as HT
    pages = {1: ('<!-- <div class="ad">x</div> --><div class="ad">y</div>', "y "),
             2: ('<div class="ad"><img alt="1>2">w</div>', "w "),
             3: ("<div data-a='a>b' class=\"x ad\" title='c>d'>in<p title=\"</div>\">side</p></div>out", "inside "),
             4: ('<div title=\' class="ad"\'>no</div>', None),
             5: ('<div class="ad">a < b &amp;&lt; <i title="x>lone</i> &nbsp;&eacute;&copy;</div>', None),
             6: ("<div class=ad>plain<div>nested <br/></div>!</div>?", "plainnested ! ")}
    df = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "id int, html string")
    got = {r.id: r.t for r in df.select("id", HT.container_text("html", "ad").alias("t")).collect()}
    assert got[5] == "a < b &< lone \u00a0é© "
    assert {k: v for k, v in got.items() if k != 5} == {k: t for k, (_, t) in pages.items() if k != 5}


def test_ordered_lines_over_several_splits(spark, tmp_path):
    """The lines of whole files, read in blocks of a few hundred bytes."""
    from claimtext.sources import text_files as TF
    texts = {"a.txt": "\n".join(f"line {i} {'x' * (i % 70)}" if i % 7 else "" for i in range(400)) + "\n",
             "b.txt": "one\r\ntwo\r\n\r\nfour", "c.txt": "", "d.txt": "\n", "e.txt": "no end " + "é" * 900}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {(n, i, x[:-1] if x.endswith("\r") else x) for n, t in texts.items() if t for i, x in enumerate(t.split("\n"))}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for keep in (False, True):
            df = TF.read_lines(spark, str(tmp_path), ordered=True, keep_blank=keep)
            rows = [(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in df.collect()]
            assert set(rows) ^ {w for w in want if keep or w[2].strip()} == set() and len(rows) == len(set(rows))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_a_named_run_appends_once(spark, tmp_path):
    from claimtext.sources import text_files as TF
    out = str(tmp_path / "t")
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    for run in ("one", "one", "two"):
        TF.append_text(df, out, run=run)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["a", "a", "b", "b"]
    assert sorted(r.line for r in TF.read_lines(spark, out).collect()) == ["a", "a", "b", "b"]


def test_ids_from_content_are_the_same_again(spark):
    from claimtext import jobs
    df = spark.createDataFrame([("x", None), ("x", None), ("y", 1)], "a string, b int")
    ids = [sorted(r.id for r in jobs.content_ids(df.repartition(n), "id").collect()) for n in (1, 3)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3
