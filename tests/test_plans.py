"""Physical-plan checks: the shapes the design relies on."""

from claimtext.plans import catalog
from tests.conftest import SF01


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_has_no_shuffle(spark):
    p = plan(catalog.QUERIES["extract_tuples"](spark, SF01))
    assert "Exchange" not in p and "Generate" in p


def test_contains_join_is_a_hash_join(spark):
    p = plan(catalog.QUERIES["hierarchy_codes"](spark, SF01))
    assert "NestedLoopJoin" not in p and "HashJoin" in p


def test_topk_uses_group_limit(spark):
    p = catalog.QUERIES["topk_similar"](spark, SF01)
    p.collect()
    assert "WindowGroupLimit" in plan(p)


def test_scan_prunes_columns(spark):
    p = plan(catalog.QUERIES["hierarchy_levels"](spark, SF01))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in p


def test_topk_padding_has_no_union_or_cross_join(spark):
    df = catalog.QUERIES["topk_similar"](spark, SF01)
    df.collect()
    p = plan(df)
    assert "Union" not in p and "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_hierarchy_end_to_end_has_no_nested_loop(spark):
    p = plan(catalog.QUERIES["hierarchy_full"](spark, SF01))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_vocabulary_filter_scans_documents_once(spark):
    p = plan(catalog.QUERIES["vocabulary_filter"](spark, SF01))
    assert p.count("documents.parquet") == 1


def test_no_inferred_generator_filter(spark):
    # a plain explode lets Catalyst infer "size(array) > 0" below the projection,
    # which evaluates the whole array expression (every regex) twice
    for name in ("extract_tuples", "vocabulary_nostem", "tfidf_weights"):
        lines = plan(catalog.QUERIES[name](spark, SF01)).split("\n")
        assert not any("Filter" in ln and "size(" in ln and "> 0" in ln for ln in lines), name


def test_no_query_uses_a_cross_or_nested_loop_join(spark):
    from tests.conftest import SF001
    for name, fn in catalog.QUERIES.items():
        p = plan(fn(spark, SF001))
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p, name


# what these read back are files that they wrote from the tables
THROUGH_FILES = {"appended_lines": "text", "ordered_lines": "text", "hierarchy_csv": "csv"}


def test_every_query_reads_the_tables(spark):
    from tests.conftest import SF001
    for name, fn in catalog.QUERIES.items():
        assert f"FileScan {THROUGH_FILES.get(name, 'parquet')}" in plan(fn(spark, SF001)), name


def test_stems_are_of_distinct_words(spark):
    """One Python node, above the aggregate that makes the words distinct; none over rows in the stemmed retrieval."""
    lines = plan(catalog.QUERIES["vocabulary_stem"](spark, SF01)).split("\n")
    python = [i for i, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert len(python) == 1 and any("HashAggregate" in x for x in lines[python[0] + 1:])
    df = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    from claimtext.operators import vocab as VO
    lines = plan(VO.process_strings(df, "doc_id", "text", "clean")).split("\n")
    python = [i for i, x in enumerate(lines) if "ArrowEvalPython" in x]
    assert len(python) == 1 and "HashAggregate" in "".join(lines[python[0] + 1:python[0] + 3])
