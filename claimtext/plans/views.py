"""Derived views over the driver's tables (FIXTURES.md group B).

The driver's corpus is invented multilingual prose, not medical claims, so
the claims view keeps every document and its whole text and only *adds*
flag columns (assigned from the id, no row is dropped).  The test lexicon
uses words the corpus really contains.  Every view is a lazy DataFrame over
the parquet scan, so its work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtext.functions.patterns import Lexicon
from claimtext.session import table_path

# FIXED VALUES: flag columns of the derived claims view, as (name, modulus of
# doc_id that sets the flag).  The order is the column order.
CLAIM_FLAGS = [
    ("IndLesionPourGauche", 3),
    ("IndLesionPourDroit", 5),
    ("IndLesionSur", 4),
    ("IndLesionDansDroite", 11),
    ("IndLesionEau", 13),
    ("IndLesionAutrePartieCorps", 7),
]

# FIXED VALUES: test lexicon over the corpus' own words (member -> label, patterns).
TEST_LEXICON_ROWS = [
    ("pour", ["\\bpour\\b"], "pour"),
    ("sur", ["\\bsur\\b", "\\bsous\\b"], "dessus"),
    ("dans", ["\\bdans\\b", "\\bavec\\b"], "dans"),
    ("eau", ["eau(x)?\\b"], "eau"),
]
TEST_LEFT = ["\\bde\\b", "\\bdes\\b"]
TEST_RIGHT = ["\\bla\\b", "\\bles\\b"]


def test_lexicon() -> Lexicon:
    return Lexicon.from_rows(TEST_LEXICON_ROWS, left=TEST_LEFT, right=TEST_RIGHT)


# FIXED VALUES: flag columns of the claims view with the default lexicon, as (name, modulus
# of doc_id that sets the flag): every member of the lexicon, the hip, sides in both spellings.
BODY_FLAGS = [
    ("IndLesionAbdomen", 41), ("IndLesionAvantBrasDroit", 23), ("IndLesionAvantBrasGauche", 43), ("IndLesionBassin", 47),
    ("IndLesionBrasDroit", 29), ("IndLesionBrasGauche", 53), ("IndLesionCervical", 31), ("IndLesionChevilleDroite", 37),
    ("IndLesionChevilleGauche", 59), ("IndLesionCoudeDroit", 61), ("IndLesionCrane", 67), ("IndLesionCuisseGauche", 71),
    ("IndLesionCuissse", 73), ("IndLesionDents", 79), ("IndLesionDoigtsMainDroite", 83), ("IndLesionDorsal", 89),
    ("IndLesionEpauleDroite", 11), ("IndLesionEpauleGauche", 13), ("IndLesionGenouDroit", 17), ("IndLesionGenouGauche", 19),
    ("IndLesionHancheDroite", 97), ("IndLesionJambeGauche", 101), ("IndLesionLombaire", 103), ("IndLesionMainDroite", 107),
    ("IndLesionOreilles", 109), ("IndLesionOrteilsPied", 113), ("IndLesionPiedDroit", 127), ("IndLesionPoignetGauche", 131),
    ("IndLesionSacre", 137), ("IndLesionThorax", 139), ("IndLesionVisage", 149), ("IndLesionYeux", 151),
    ("IndLesionAutrePartieCorps", 157),
]

# FIXED VALUES: what the claims with the default lexicon add to their texts, by doc_id.
BODY_PHRASES = [
    "douleur épaule gauche", "entorse du genou droit", "fracture main gauche et main droite", "lombaire", "hernie discale",
    "tendinite coude d et epicondylite g", "commotion cerebrale", "plaie au pied droit", "talons", "contusion hanche droite",
    "dorsales et cervicale", "brulure aux yeux", "entorse cheville gch", "mal de dos", "surdite", "bras", "costale",
    "genoux gauche epaule",
]


# Tables whose rows carry long text: per-row work dominates their queries.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}
SCAN_PARTITIONS_CONF = "claimtext.scan.partitions"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table.

    When ``claimtext.scan.partitions`` is set, text tables are hash
    redistributed on their id into that many partitions right after the
    scan.  This is for small inputs stored as one parquet row group (one
    scan task would otherwise do all the text work); leave it unset on a
    cluster, where a large table is many row groups and the scan itself is
    parallel.
    """
    df = spark.read.parquet(table_path(sf_dir, name))
    n = spark.conf.get(SCAN_PARTITIONS_CONF, None)
    if n and name in TEXT_TABLES:
        df = df.repartition(int(n), TEXT_TABLES[name])
    return df


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: documents as a claims table (id, description, flags, other text)."""
    d = read(spark, sf_dir, "documents")
    flags = [((F.col("doc_id") % m) == 0).alias(name) for name, m in CLAIM_FLAGS]
    return d.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("description"), *flags,
                    F.col("source").alias("PrecisionLesionAutrePartieCorps"))


def claims_sql() -> str:
    flags = ", ".join(f"(doc_id % {m} = 0) AS {name}" for name, m in CLAIM_FLAGS)
    return (f"SELECT doc_id AS claim_id, text AS description, {flags}, "
            f"source AS PrecisionLesionAutrePartieCorps FROM documents")


def body_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as claims with the default lexicon's flags; each whole text ends in a phrase on the body."""
    d = read(spark, sf_dir, "documents")
    flags = [((F.col("doc_id") % m) == 0).alias(name) for name, m in BODY_FLAGS]
    phrase = F.get(F.array(*map(F.lit, BODY_PHRASES)), (F.col("doc_id") % len(BODY_PHRASES)).cast("int"))
    return d.select(F.col("doc_id").alias("claim_id"), F.concat("text", F.lit(" "), phrase).alias("description"), *flags,
                    F.col("source").alias("PrecisionLesionAutrePartieCorps"))


def body_claims_sql() -> str:
    flags = ", ".join(f"(doc_id % {m} = 0) AS {name}" for name, m in BODY_FLAGS)
    phrases = ", ".join(f"'{p}'" for p in BODY_PHRASES)
    return (f"SELECT doc_id AS claim_id, text || ' ' || [{phrases}][doc_id % {len(BODY_PHRASES)} + 1] AS description, {flags}, "
            f"source AS PrecisionLesionAutrePartieCorps FROM documents")
