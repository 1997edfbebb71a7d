"""Bundles, the stored model and the jobs that open it."""

import pytest

from claimtext import jobs
from claimtext.constants import HIERARCHY_COLUMNS
from claimtext.operators import retrieve as RT
from claimtext.sources import bundle as BU


def test_bundle_is_checked_and_versioned(spark, tmp_path):
    root = str(tmp_path / "b")
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n int, s string")
    assert BU.load_bundle(spark, root) is None
    one = BU.save_bundle({"a": a}, root, settings={"stem": True})
    got = BU.load_bundle(spark, root, settings={"stem": True}, verify=True)["a"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, a.collect()), key=str) and got.schema == a.schema
    with pytest.raises(ValueError):
        BU.load_bundle(spark, root, settings={"stem": False})
    # the same run again leaves one copy, another run is the last version
    BU.save_bundle({"a": a}, root, version=one, settings={"stem": True})
    assert BU.load_bundle(spark, root, one, verify=True)["a"].count() == 3
    two = BU.save_bundle({"a": a.limit(1)}, root)
    assert BU.load_bundle(spark, root)["a"].count() == 1 and BU.load_bundle(spark, root, one)["a"].count() == 3
    # a version without its manifest is not there; changed rows are found
    BU._remove(spark, f"{root}/{two}/{BU.MANIFEST}")
    assert BU.load_bundle(spark, root)["a"].count() == 3
    a.write.mode("append").parquet(f"{root}/{one}/a")
    with pytest.raises(ValueError):
        BU.load_bundle(spark, root, one, verify=True)


def test_detection_bundle(spark, tmp_path):
    words = spark.createDataFrame([("genou",)], "word string")
    jobs.save_detection_bundle(spark, ["IndLesionGenouGauche", "IndLesionMain"], words, str(tmp_path))
    got = BU.load_bundle(spark, str(tmp_path), verify=True)
    assert set(got) == {"members", "columns", "sides", "vocabulary"}
    assert [r[0] for r in got["members"].orderBy("member").collect()] == ["genou", "main"]


def test_added_documents_give_the_model_of_all(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "gamma delta alpha"), (4, ""), (5, "beta")],
                                   "doc_id long, text string")
    root = str(tmp_path / "m")
    first = RT.save_model(corpus.where("doc_id < 3"), root)
    RT.save_model(corpus, root, before=BU.load_bundle(spark, root, first), version="second")
    got, want = RT.open_model(BU.load_bundle(spark, root, "second")), RT.fit(corpus)
    def rows(df):
        return sorted((r[0], r[1], round(r[2], 12)) for r in df.select("doc_id", "term", "weight").collect())

    assert rows(got.weights) == rows(want.weights)
    assert sorted(r[0] for r in got.docs.collect()) == [1, 2, 3, 4, 5]


def hierarchy(spark, path, codes):
    columns = list(HIERARCHY_COLUMNS)
    rows = [{x: "" for x in columns} | {"Sous_Categorie": n, "diagnostic_num": c, "diagnostic": n} for c, n in codes]
    spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns)
                          ).write.mode("overwrite").parquet(path)


def test_second_retrieval_opens_the_stored_model(spark, tmp_path, monkeypatch):
    h, q, t, root = (str(tmp_path / x) for x in ("h", "q", "t", "model"))
    hierarchy(spark, h, [("S82", "Fracture genou"), ("S61", "Plaie main"), ("S93", "Entorse cheville")])
    spark.createDataFrame([(1, "fracture genoux"), (2, "plaies mains")], "id long, text string").write.parquet(q)
    spark.createDataFrame([(7, 0, "fracture ", "genou", "gauche"), (7, 1, "inconnu", "main", "inconnu")],
                          "claim_id long, seq int, phrase string, member string, side string").write.parquet(t)
    plain = str(tmp_path / "plain")
    jobs.job_retrieve(spark, h, q, plain, k=1, hierarchy_format="parquet")
    outs = [str(tmp_path / f"out{i}") for i in range(2)]
    jobs.job_retrieve(spark, h, q, outs[0], k=1, hierarchy_format="parquet", model_root=root)

    def no_fit(*args, **kw):
        raise AssertionError("fitted again")

    monkeypatch.setattr(RT, "postings", lambda df, *a: no_fit() if "doc" in df.columns else _postings(df, *a))
    monkeypatch.setattr(RT, "save_model", no_fit)
    monkeypatch.setattr(jobs, "_hierarchy_corpus", no_fit)
    jobs.job_retrieve(spark, h, q, outs[1], k=1, hierarchy_format="parquet", model_root=root)
    rows = [sorted(map(str, spark.read.parquet(p).collect())) for p in (plain, *outs)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 2
    # tuples as queries: phrase, member and side, unknown ones left out
    out = str(tmp_path / "tuples")
    jobs.job_retrieve_tuples(spark, h, t, out, root, k=1, hierarchy_format="parquet")
    got = {(r.claim_id, r.seq): r for r in spark.read.parquet(out).collect()}
    assert got[7, 0].CIM10s[0].startswith("S82") and got[7, 1].CIM10s[0].startswith("S61") and got[7, 1].member == "main"


_postings = RT.postings
