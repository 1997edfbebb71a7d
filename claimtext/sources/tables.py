"""Tables and saved artefacts.

Artefacts the reference pickles (member lists, side lists, tuples,
vocabularies, TF-IDF postings, labels) are parquet directories here, written
with ``overwrite`` so that a rerun after a lost executor or a failed job is
idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CLAIMS_BASE_SCHEMA = T.StructType([
    T.StructField("claim_id", T.LongType()),
    T.StructField("description", T.StringType()),
])


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               header: bool = True) -> DataFrame:
    """A claims / code / hierarchy table.  CSV needs an explicit schema
    (no inference pass over the data)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv tables need an explicit schema")
        return r.option("header", header).csv(path)
    return r.format(fmt).load(path)


def save_artifacts(artifacts: dict[str, DataFrame], root: str) -> None:
    """Each DataFrame to ``root/<name>`` as parquet (overwrite)."""
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def load_artifacts(spark: SparkSession, root: str, names) -> dict[str, DataFrame]:
    """S3: the named parquet artefacts under ``root``."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{n}") for n in names}


def write_csv(df: DataFrame, path: str, order_by=None) -> None:
    """CSV with a header, no index column; optional global order."""
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode("overwrite").option("header", True).csv(path)
