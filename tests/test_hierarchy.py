"""Code hierarchy: line classes, ordered scan, substring containment join."""

import re

from pyspark.sql import functions as F

from claimtext.operators import hierarchy as HI

LINES = [
    "S00-S09 Lesions de la tete",
    "S00 Lesion superficielle",
    "S000 Cuir chevelu",
    "S001 Paupiere",
    "S01 Plaie ouverte",          # 3-char followed by 3-char -> emitted
    "S02 Fracture",               # 3-char followed by range -> emitted
    "S10-S19 Lesions du cou",
    "S100 Gorge",                 # 4-char keeps the last sub (S02), not reset by the category
    "bad line",                   # no class -> reject
    "S11 Plaie du cou",           # 3-char on the last line -> lost (G9)
]


def lines_df(spark, chapter="19"):
    return spark.createDataFrame([(chapter, i, s) for i, s in enumerate(LINES)], "chapter string, line_no long, line string")


EXPECTED = [
    (2, "S00-S09 Lesions de la tete", "S00 Lesion superficielle", "S000 Cuir chevelu"),
    (3, "S00-S09 Lesions de la tete", "S00 Lesion superficielle", "S001 Paupiere"),
    (4, "S00-S09 Lesions de la tete", "S01 Plaie ouverte", ""),
    (5, "S00-S09 Lesions de la tete", "S02 Fracture", ""),
    (7, "S10-S19 Lesions du cou", "S02 Fracture", "S100 Gorge"),
]


def test_nodes_and_rejects(spark):
    nodes, rejects = HI.hierarchy_nodes(lines_df(spark))
    got = [(r["line_no"], r["Categorie"], r["Sous_Categorie"], r["Sous_Sous_Categorie"])
           for r in nodes.orderBy("line_no").collect()]
    assert got == EXPECTED
    assert [r["line"] for r in rejects.collect()] == ["bad line"]


def test_chunked_scan_equals_single_chunk(spark):
    df = lines_df(spark).unionByName(lines_df(spark, "13"))
    a = HI.hierarchy_nodes(df, chunk=1_000_000)[0]
    for chunk in (1, 2, 3):
        b = HI.hierarchy_nodes(df, chunk=chunk)[0]
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_contains_join_equals_brute_force(spark):
    nodes = spark.createDataFrame([("", "S00 x", ""), ("", "S02 y", "S021 z"), ("", "S02 y", ""), ("", "S1 q", "")],
                                  "Categorie string, Sous_Categorie string, Sous_Sous_Categorie string")
    codes = spark.createDataFrame([("S001", "a"), ("S0210", "b"), ("XS00", "c"), ("S02", "d"), ("S1S1", "e"), ("S", "f")],
                                  "diagnostic_num string, diagnostic string")
    out = HI.attach_codes(nodes, codes, "19", "chap")
    got = sorted((r["Sous_Sous_Categorie"], r["Sous_Sous_Sous_Categorie"], r["diagnostic_num"]) for r in out.collect())
    want = []
    for n in nodes.collect():
        code = (n["Sous_Sous_Categorie"] or n["Sous_Categorie"]).split(" ")[0]
        for c in codes.collect():
            if code in c["diagnostic_num"]:
                want.append((n["Sous_Categorie"], n["Sous_Sous_Categorie"], c["diagnostic_num"]))
    assert got == sorted(want)
    row = out.filter(F.col("diagnostic_num") == "S001").first()
    assert (row["Chapitre_num"], row["Sous_Categorie"]) == ("19", "")


def test_exploded_codes_are_never_broadcast(spark, tmp_path):
    nodes = spark.createDataFrame([("c", "S00 x", ""), ("c", "S00 x", ""), ("d", "S02 y", ""), ("d", None, "")],
                                  "Categorie string, Sous_Categorie string, Sous_Sous_Categorie string")
    codes = spark.createDataFrame([("S001", "a"), ("S001", "a"), ("XS02", "b"), (None, "n"), ("T", "t")],
                                  "diagnostic_num string, diagnostic string")
    for name, df in (("nodes", nodes), ("codes", codes)):  # files have a size that Spark plans by
        df.write.parquet(f"{tmp_path}/{name}")
    out = HI.attach_codes(spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/codes"), "19", "chap")
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda ln: re.search("[A-Z]", ln + "A").start()
    for i, ln in enumerate(lines):
        if "BroadcastExchange" in ln:
            below = []
            for other in lines[i + 1:]:
                if depth(other) <= depth(ln):
                    break
                below.append(other)
            assert not any("Generate" in other for other in below)
    got = sorted((r["Categorie"], r["Sous_Sous_Categorie"], r["diagnostic_num"]) for r in out.collect())
    assert got == [("c", "S00 x", "S001")] * 4 + [("d", "S02 y", "XS02")]


def test_document_concat_doubles_fifth_and_writes_nan(spark):
    df = spark.createDataFrame([("19", "chap", "cat", "", "sub", None, "S001")],
                               "Chapitre_num string, Chapitre_nom string, Categorie string, Sous_Categorie string, "
                               "Sous_Sous_Categorie string, Sous_Sous_Sous_Categorie string, diagnostic_num string")
    assert df.select(HI.hierarchy_document().alias("d")).first()["d"] == "19 chap cat  sub sub nan S001"


# --- H2 against a Python model of the line loop, random listings, tiny chunks -------

import re as _re

from hypothesis import given, settings
from hypothesis import strategies as st

from claimtext import constants as K


def model_nodes(lines):
    rx = _re.compile(K.HIERARCHY_LINE_PATTERN)
    classified = [(i, rx.findall(s)) for i, s in enumerate(lines)]
    classified = [(i, r[0]) for i, r in classified if r]          # rejects leave the sequence
    out, cat, sub = [], "", ""
    for j, (i, (g1, g2, g3)) in enumerate(classified):
        if g1:
            cat = g1
        elif g2:
            sub = g2
            if j + 1 < len(classified) and classified[j + 1][1][2] == "":
                out.append((i, cat, sub, ""))
        elif g3:
            out.append((i, cat, sub, g3))
    return out


LINE_KINDS = ["S00-S09 cat a", "S10-S19 cat b", "S01 sub x", "S02 sub y", "S010 leaf p", "S021 leaf q", "junk"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(LINE_KINDS), min_size=1, max_size=25), st.sampled_from([1, 2, 5, 1000]))
def test_nodes_agree_with_line_loop(spark, lines, chunk):
    df = spark.createDataFrame([("c", i, s) for i, s in enumerate(lines)], "chapter string, line_no long, line string")
    nodes, _ = HI.hierarchy_nodes(df, chunk=chunk)
    got = sorted((r["line_no"], r["Categorie"], r["Sous_Categorie"], r["Sous_Sous_Categorie"]) for r in nodes.collect())
    assert got == sorted(model_nodes(lines))
