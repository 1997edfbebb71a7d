"""Batch jobs: one function (and one ``spark-submit claimtext/jobs.py <job>``
target) per processing step of the reference.

Every job reads its inputs with Spark, runs one plan and writes parquet
(overwrite, so a rerun after a failure is idempotent) or appends text where
the reference appends.  Nothing is collected to the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimtext import constants as K
from claimtext.functions.patterns import Lexicon, member_and_side, members_from_columns
from claimtext.functions.stem import stem_tokens_ignore_stop
from claimtext.operators import extract as EX
from claimtext.operators import hierarchy as HI
from claimtext.operators import retrieve as RT
from claimtext.operators import vocab as VO
from claimtext.sources import bundle as BU
from claimtext.sources import html as HT
from claimtext.sources import tables as TB
from claimtext.sources import text_files as TF


def _flag(v) -> bool:
    """Boolean option given as a bool or as command-line text."""
    return v if isinstance(v, bool) else str(v).strip().lower() in ("1", "true", "yes")


# --- claims (P1-P3, M6) -----------------------------------------------------------

def load_claims(df: DataFrame, text_col: str = "DescriptionDiagnostic", index_col: str | None = "Unnamed: 0",
                id_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """Drop the spreadsheet index column, drop rows without a
    description, and return the flag columns (every column after it)."""
    if index_col and index_col in df.columns:
        df = df.drop(index_col)
    df = df.na.drop(subset=[text_col])
    cols = [c for c in df.columns if c not in (text_col, id_col)]
    return df, cols


def content_ids(df: DataFrame, id_col: str) -> DataFrame:
    """df with an id from each row's content; equal rows are numbered."""
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    among = F.row_number().over(Window.partitionBy("_digest").orderBy(F.lit(1)))
    return df.withColumn("_digest", digest).withColumn(id_col, F.concat_ws("-", "_digest", among)).drop("_digest")


def detection_variables(spark: SparkSession, flag_columns: list[str]) -> dict[str, DataFrame]:
    """M6: the configuration the extraction needs, as small tables."""
    members = spark.createDataFrame([(m,) for m in members_from_columns(flag_columns)], "member string")
    cols = spark.createDataFrame([(i, c, *member_and_side(c)[:2]) for i, c in enumerate(flag_columns)],
                                 "col_pos int, col_name string, member string, side string")
    sides = spark.createDataFrame([("gauche", p) for p in K.LEFT_SIDE_PATTERNS]
                                  + [("droit", p) for p in K.RIGHT_SIDE_PATTERNS], "side string, pattern string")
    return {"members": members, "columns": cols, "sides": sides}


def save_detection_variables(spark: SparkSession, flag_columns: list[str], root: str) -> None:
    TB.save_artifacts(detection_variables(spark, flag_columns), root)


def save_detection_bundle(spark: SparkSession, flag_columns: list[str], vocabulary: DataFrame, root: str,
                          version: str | None = None) -> str:
    """S3, M6: members, columns, sides and the vocabulary as one checked bundle (``BU.load_bundle`` opens it)."""
    return BU.save_bundle(detection_variables(spark, flag_columns) | {"vocabulary": vocabulary}, root, version)


# --- jobs ------------------------------------------------------------------------

def job_vocabulary(spark: SparkSession, text_path: str, out: str, stem: bool = True) -> None:
    """Process 0: stem vocabulary of a text corpus."""
    lines = TF.read_lines(spark, text_path)
    VO.vocabulary(lines, "line", stem=_flag(stem)).write.mode("overwrite").parquet(out)


def job_abbreviations(spark: SparkSession, text_path: str, out: str) -> None:
    """Process 1: distinct lower-cased raw tokens."""
    lines = TF.read_lines(spark, text_path)
    VO.abbreviation_vocabulary(lines, "line").write.mode("overwrite").parquet(out)


def job_pages(spark: SparkSession, pages_path: str, out: str, cls: str = K.PAGE_CONTAINER_CLASS,
              run: str | None = None) -> None:
    """Process 2 (data part): container text of stored pages, appended as text (S7, S4); a named run appends once."""
    pages = spark.read.parquet(pages_path)
    TF.append_text(pages.select(HT.container_text("html", cls).alias("t")).na.drop(), out, run=run)


def job_extract(spark: SparkSession, claims_path: str, vocab_path: str, out_root: str,
                id_col: str = "claim_id", text_col: str = "DescriptionDiagnostic", stem: bool = True,
                lexicon: Lexicon | None = None) -> None:
    """Process 3: tuples (E9) saved, then cleaned against the vocabulary (V1) and saved.

    Without an id column the spreadsheet index (``Unnamed: 0``) identifies a
    claim; failing that, the digest of its content and a number among equal
    claims, so that a rerun gives the same ids.
    """
    raw = spark.read.parquet(claims_path)
    if id_col not in raw.columns:
        raw = (raw.withColumnRenamed("Unnamed: 0", id_col) if "Unnamed: 0" in raw.columns
               else content_ids(raw, id_col))
    claims, _cols = load_claims(raw, text_col=text_col, id_col=id_col)
    tuples = EX.extract_tuples(claims, id_col, text_col, lexicon=lexicon)
    tuples.write.mode("overwrite").parquet(f"{out_root}/tuples")
    saved = spark.read.parquet(f"{out_root}/tuples")
    vocab = spark.read.parquet(vocab_path)
    cleaned = VO.vocabulary_filter(saved, [id_col, "seq"], "phrase", vocab, vocab_col=vocab.columns[0],
                                   stem=_flag(stem))
    cleaned.write.mode("overwrite").parquet(f"{out_root}/cleaned_tuples")


def job_hierarchy(spark: SparkSession, listing_path: str, codes_path: str, out: str,
                  chapter_num: str = "19", chapter_name: str = "") -> None:
    """Process 4: ordered chapter listing + code table -> hierarchy CSV."""
    lines = TF.read_lines(spark, listing_path, ordered=True).withColumnRenamed("file", "chapter")
    nodes, rejects = HI.hierarchy_nodes(lines, "chapter", "line_no", "line")
    codes = spark.read.parquet(codes_path)
    h = HI.attach_codes(nodes, codes, chapter_num, chapter_name,
                        num_col=codes.columns[0], label_col=codes.columns[1],
                        code_lengths=HI.LISTING_CODE_LENGTHS)
    TB.write_csv(h.orderBy("chapter", "line_no", "diagnostic_num").select(*K.HIERARCHY_COLUMNS), out)
    rejects.write.mode("overwrite").parquet(f"{out}_rejects")


def read_hierarchy(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The hierarchy table as written by ``job_hierarchy`` (``csv``, read with an
    explicit all-string schema) or as ``parquet``."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in K.HIERARCHY_COLUMNS])
    return TB.read_table(spark, path, fmt=fmt, schema=schema)


def _hierarchy_corpus(spark: SparkSession, path: str, fmt: str, stem: bool, remove_duplicate: bool) -> DataFrame:
    """(doc_id, diagnostic_num, diagnostic, doc) of a hierarchy table."""
    h = read_hierarchy(spark, path, fmt)
    h = h.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in h.columns])  # as the CSV reads them
    # the key orders ties by content, the same for any number of files and either format
    key = F.struct("diagnostic_num", *[c for c in h.columns if c != "diagnostic_num"])
    corpus = h.select(key.alias("doc_id"), "diagnostic_num", "diagnostic",
                      HI.hierarchy_corpus(h, remove_duplicate=remove_duplicate, stem=stem_tokens_ignore_stop if stem else None)
                      .alias("doc"))
    return corpus.dropDuplicates(["doc_id"]).checkpoint(eager=True)


def job_fit(spark: SparkSession, hierarchy_path: str, model_root: str, stem: bool = True, remove_duplicate: bool = False,
            hierarchy_format: str = "csv", version: str | None = None, add: bool = False) -> str:
    """Fit the hierarchy corpus once and store model and labels as a bundle; ``add`` adds its codes to the last version."""
    from claimtext.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    stem, remove_duplicate = _flag(stem), _flag(remove_duplicate)
    settings = {"stem": stem, "remove_duplicate": remove_duplicate}
    corpus = _hierarchy_corpus(spark, hierarchy_path, hierarchy_format, stem, remove_duplicate)
    labels = corpus.select("doc_id", F.col("diagnostic_num").alias("code"), F.col("diagnostic").alias("label"))
    before = BU.load_bundle(spark, model_root, settings=settings) if _flag(add) else None
    return RT.save_model(corpus, model_root, "doc_id", "doc", labels=labels, settings=settings, version=version, before=before)


def _opened(spark: SparkSession, hierarchy_path: str, model_root: str, stem: bool, remove_duplicate: bool, fmt: str):
    """The stored model for these settings and its labels; fitted and stored first if there is none."""
    settings = {"stem": stem, "remove_duplicate": remove_duplicate}
    bundle = BU.load_bundle(spark, model_root, settings=settings)
    if bundle is None:
        job_fit(spark, hierarchy_path, model_root, stem, remove_duplicate, fmt)
        bundle = BU.load_bundle(spark, model_root, settings=settings)
    return RT.open_model(bundle), bundle["labels"]


def job_retrieve(spark: SparkSession, hierarchy_path: str, queries_path: str, out: str, k: int = 5,
                 text_col: str = "text", stem: bool = True, remove_duplicate: bool = False,
                 vocab_path: str | None = None, hierarchy_format: str = "csv", model_root: str | None = None) -> None:
    """Top-k codes for query texts against the hierarchy corpus (P19, R1-R8); with a vocabulary its words alone count (V1-V3).

    With ``model_root`` the stored model is opened, and only fitted when none is there.
    """
    from claimtext.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    k, stem, remove_duplicate = int(k), _flag(stem), _flag(remove_duplicate)
    if model_root:
        model, labels = _opened(spark, hierarchy_path, model_root, stem, remove_duplicate, hierarchy_format)
    else:
        corpus = _hierarchy_corpus(spark, hierarchy_path, hierarchy_format, stem, remove_duplicate)
        model = RT.fit(corpus, "doc_id", "doc")
        labels = corpus.select("doc_id", F.col("diagnostic_num").alias("code"), F.col("diagnostic").alias("label"))
    q = spark.read.parquet(queries_path)
    if vocab_path:
        vocab = spark.read.parquet(vocab_path)
        q = VO.vocabulary_filter(q, q.columns[0], text_col, vocab, vocab_col=vocab.columns[0], tokenizer="raw",
                                 stem=stem, out_col="_kept", keep_original=True)
    res = RT.retrieve(model, q, labels, k, query_id=q.columns[0], text_col="_kept" if vocab_path else text_col,
                      diagnostic_col=text_col, stem=stem or None)
    res.write.mode("overwrite").parquet(out)


def job_retrieve_tuples(spark: SparkSession, hierarchy_path: str, tuples_path: str, out: str, model_root: str, k: int = 5,
                        stem: bool = True, remove_duplicate: bool = False, hierarchy_format: str = "csv",
                        id_col: str = "claim_id") -> None:
    """The tuples that ``job_extract`` cleaned -> query text of phrase, member and side -> top-k codes."""
    from claimtext.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    stem, remove_duplicate = _flag(stem), _flag(remove_duplicate)
    model, labels = _opened(spark, hierarchy_path, model_root, stem, remove_duplicate, hierarchy_format)
    tuples = spark.read.parquet(tuples_path)
    q = tuples.select(F.struct(id_col, "seq").alias("query_id"), "phrase",
                      RT.query_text_from_tuple("phrase", "member", "side").alias("qtext"))
    res = RT.retrieve(model, q, labels, int(k), text_col="qtext", diagnostic_col="phrase", stem=stem or None)
    named = tuples.select(id_col, "seq", "member", "side")
    res = res.select(f"query_id.{id_col}", "query_id.seq", "Diagnostic", "CIM10s")
    named.join(res, [id_col, "seq"]).write.mode("overwrite").parquet(out)


def job_extract_stream(spark: SparkSession, claims_dir: str, sink_dir: str, checkpoint_location: str,
                       id_col: str = "claim_id", text_col: str = "DescriptionDiagnostic",
                       available_now: str = "true"):
    """Process 3 on arriving claim files: tuples appended to a parquet sink.

    The claims schema is taken from the files already present; the stream's
    checkpoint makes the sink exactly-once across restarts.
    """
    from claimtext.streaming import extract_stream as XS
    schema = spark.read.parquet(claims_dir).schema
    claims = XS.read_claims_stream(spark, claims_dir, schema)
    claims, _cols = load_claims(claims, text_col=text_col, id_col=id_col)
    q = XS.start_file_sink(XS.extract_stream(claims, id_col, text_col), sink_dir, checkpoint_location,
                           available_now=str(available_now).lower() == "true")
    if str(available_now).lower() == "true":
        q.awaitTermination()
    return q


def main(argv=None) -> None:
    from claimtext.session import ensure_checkpoint_dir
    ap = argparse.ArgumentParser(prog="claimtext.jobs")
    ap.add_argument("job", choices=["vocabulary", "abbreviations", "pages", "extract", "extract_stream",
                                    "hierarchy", "fit", "retrieve", "retrieve_tuples"])
    ap.add_argument("args", nargs="+")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"claimtext-{a.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    fn = {"vocabulary": job_vocabulary, "abbreviations": job_abbreviations, "pages": job_pages,
          "extract": job_extract, "extract_stream": job_extract_stream, "hierarchy": job_hierarchy,
          "retrieve": job_retrieve}[a.job]
    started = fn(spark, *a.args)
    if started is not None:  # a stream that goes on: stay until it ends
        started.awaitTermination()


if __name__ == "__main__":
    main()
