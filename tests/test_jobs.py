"""End-to-end jobs on small inputs in scratch folders."""

import os
import tempfile

from claimtext import jobs


def test_hierarchy_then_retrieve(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    listing = os.path.join(d, "chapitre19.txt")
    with open(listing, "w", encoding="utf-8") as f:
        f.write("S00-S09 Lesions de la tete\nS00 Lesion superficielle de la tete\nS000 Cuir chevelu\n"
                "S01 Plaie ouverte de la tete\nS02 Fracture du crane\nS10-S19 Lesions du cou\nS100 Gorge\n")
    codes = spark.createDataFrame([("S000", "contusion du cuir chevelu"), ("S0100", "plaie de la levre"),
                                   ("S020", "fracture de la voute du crane"), ("S1000", "contusion de la gorge")],
                                  "diagnostic_num string, diagnostic string")
    codes.write.parquet(os.path.join(d, "codes"))
    out = os.path.join(d, "hierarchy")
    jobs.job_hierarchy(spark, listing, os.path.join(d, "codes"), out, "19", "Lesions traumatiques")
    h = spark.read.option("header", True).csv(out)
    rows = sorted((r["Sous_Sous_Categorie"], r["diagnostic_num"]) for r in h.collect())
    assert rows == [("S00 Lesion superficielle de la tete", "S000"), ("S01 Plaie ouverte de la tete", "S0100"),
                    ("S02 Fracture du crane", "S020"), ("S02 Fracture du crane", "S1000")]
    q = spark.createDataFrame([(1, "fracture du crane"), (2, "gorge")], "query_id long, text string")
    q.write.parquet(os.path.join(d, "q"))
    jobs.job_retrieve(spark, out, os.path.join(d, "q"), os.path.join(d, "res"), k=2)   # the CSV as written
    res = {r["query_id"]: r for r in spark.read.parquet(os.path.join(d, "res")).collect()}
    assert res[1]["CIM10s"][0] == "S020 - fracture de la voute du crane"
    assert res[2]["CIM10s"][0] == "S1000 - contusion de la gorge"
    h.repartition(4).write.parquet(os.path.join(d, "h4"))   # the same rows as parquet, in four files
    jobs.job_retrieve(spark, os.path.join(d, "h4"), os.path.join(d, "q"), os.path.join(d, "res4"), k=2,
                      hierarchy_format="parquet")
    assert {r["query_id"]: r for r in spark.read.parquet(os.path.join(d, "res4")).collect()} == res


def test_vocabulary_and_extract(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    txt = os.path.join(d, "sci.txt")
    with open(txt, "w", encoding="utf-8") as f:
        f.write("Entorse du genou.\nFracture de la main, douleur au genou\n")
    jobs.job_vocabulary(spark, txt, os.path.join(d, "vocab"), stem=True)
    vocab = sorted(r[0] for r in spark.read.parquet(os.path.join(d, "vocab")).collect())
    assert "genou" in vocab and "fractur" in vocab
    jobs.job_abbreviations(spark, txt, os.path.join(d, "abbr"))
    assert spark.read.parquet(os.path.join(d, "abbr")).count() > 5
    claims = spark.createDataFrame(
        [(0, 1, "Entorse genou gauche en tombant", True, False, None),
         (1, 2, None, True, False, None)],
        "`Unnamed: 0` long, claim_id long, DescriptionDiagnostic string, IndLesionGenouGauche boolean, "
        "IndLesionAutrePartieCorps boolean, PrecisionLesionAutrePartieCorps string")
    claims.write.parquet(os.path.join(d, "claims"))
    jobs.job_extract(spark, os.path.join(d, "claims"), os.path.join(d, "vocab"), os.path.join(d, "out"))
    t = spark.read.parquet(os.path.join(d, "out", "tuples")).collect()
    assert [(r["phrase"], r["member"], r["side"]) for r in t] == [("entorse genou gauche", "genou", "gauche")]
    c = spark.read.parquet(os.path.join(d, "out", "cleaned_tuples")).collect()
    assert [r["phrase"] for r in c] == ["entorse genou "]


def test_detection_variables(spark):
    v = jobs.detection_variables(spark, ["IndLesionGenouGauche", "IndLesionGenouDroit", "IndLesionMain"])
    assert [r[0] for r in v["members"].collect()] == ["genou", "main"]
    assert v["sides"].count() == 11


def test_extract_stream_job(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    claims = spark.createDataFrame(
        [(1, "Entorse genou gauche", True, False, None), (2, "mal au genou et a la main", True, True, None)],
        "claim_id long, DescriptionDiagnostic string, IndLesionGenouGauche boolean, IndLesionMain boolean, "
        "PrecisionLesionAutrePartieCorps string")
    claims.write.parquet(os.path.join(d, "in"))
    jobs.job_extract_stream(spark, os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck"))
    got = sorted((r["claim_id"], r["seq"], r["member"]) for r in spark.read.parquet(os.path.join(d, "out")).collect())
    assert got == [(1, 0, "genou"), (2, 0, "genou"), (2, 1, "main"), (2, 2, "main")]


def test_pages_job_appends(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    pages = spark.createDataFrame([(1, "u", '<div class="screenContainer">Os &amp; muscle</div>'),
                                   (2, "v", "<p>none</p>")], "page_id long, url string, html string")
    pages.write.parquet(os.path.join(d, "pages"))
    out = os.path.join(d, "web_dataset")
    jobs.job_pages(spark, os.path.join(d, "pages"), out)
    jobs.job_pages(spark, os.path.join(d, "pages"), out)
    assert sorted(r[0] for r in spark.read.text(out).collect()) == ["Os & muscle ", "Os & muscle "]


def test_cli_arguments_are_typed(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    txt = os.path.join(d, "sci.txt")
    with open(txt, "w", encoding="utf-8") as f:
        f.write("Fractures du genou\n")
    jobs.main(["vocabulary", txt, os.path.join(d, "v_nostem"), "false"])
    assert sorted(r[0] for r in spark.read.parquet(os.path.join(d, "v_nostem")).collect()) == ["fractures", "genou"]


def test_extract_uses_spreadsheet_index_as_id(spark):
    d = tempfile.mkdtemp(prefix="claimtext-jobs-")
    claims = spark.createDataFrame([(7, "Entorse genou gauche", True), (8, None, True)],
                                   "`Unnamed: 0` long, DescriptionDiagnostic string, IndLesionGenouGauche boolean")
    claims.write.parquet(os.path.join(d, "claims"))
    spark.createDataFrame([("genou",)], "word string").write.parquet(os.path.join(d, "vocab"))
    jobs.job_extract(spark, os.path.join(d, "claims"), os.path.join(d, "vocab"), os.path.join(d, "out"), stem="false")
    rows = spark.read.parquet(os.path.join(d, "out", "cleaned_tuples")).collect()
    assert [(r["claim_id"], r["seq"], r["phrase"], r["member"], r["side"]) for r in rows] == \
        [(7, 0, "genou ", "genou", "gauche")]
