"""A bundle of artefacts: versioned, checked when loaded.

A version is a folder of Parquet tables with a manifest, written last, that
names each table's schema, row count and content digest (the sum of its rows'
64-bit hashes, whatever their order).  A version without a manifest was not
finished and is never loaded.  A run that is repeated under its version's name
replaces that version, so it leaves one copy.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "version string, written timestamp, settings string, artifacts string"


def content(df: DataFrame) -> dict:
    """Schema, rows and digest of a table."""
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("d")).first()
    return {"schema": json.loads(df.schema.json()), "rows": row.n, "digest": row.d}


def save_bundle(artifacts: dict[str, DataFrame], root: str, version: str | None = None, settings: dict | None = None) -> str:
    """Write the tables and then the manifest; returns the version."""
    spark = next(iter(artifacts.values())).sparkSession
    version, root = version or uuid.uuid4().hex, root.rstrip("/")
    _remove(spark, f"{root}/{version}/{MANIFEST}")  # until it is whole again
    found = {}
    for name, df in artifacts.items():
        path = f"{root}/{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        found[name] = content(_read(spark, path, df.schema))
    one = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"),
                                F.lit(json.dumps(settings or {}, sort_keys=True)).alias("settings"),
                                F.lit(json.dumps(found)).alias("artifacts"))
    one.coalesce(1).write.mode("overwrite").json(f"{root}/{version}/{MANIFEST}")
    return version


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[F.col(f"`{f.name}`") for f in schema])


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all finished versions."""
    where, fs = _path(spark, f"{root.rstrip('/')}/*/{MANIFEST}/_SUCCESS")
    done = [str(x.getPath().getParent()) for x in fs.globStatus(where) or []]
    if not done:
        return spark.createDataFrame([], _MANIFEST_SCHEMA)
    return spark.read.schema(_MANIFEST_SCHEMA).json(done)


def load_bundle(spark: SparkSession, root: str, version: str | None = None, settings: dict | None = None,
                verify: bool = False) -> dict[str, DataFrame] | None:
    """The tables of a version (the last one written), or None if there is none.

    ``settings`` must be those the version was written with, else it is an
    error.  Tables are read with the schema of the manifest; with ``verify``
    their rows and digest are compared too.
    """
    found = manifests(spark, root)
    if version is not None:
        found = found.where(F.col("version") == version)
    last = found.orderBy(F.desc("written"), "version").first()
    if last is None:
        return None
    if settings is not None and json.loads(last.settings) != json.loads(json.dumps(settings)):
        raise ValueError(f"bundle {last.version} was written with {last.settings}")
    out = {}
    for name, kept in json.loads(last.artifacts).items():
        df = _read(spark, f"{root.rstrip('/')}/{last.version}/{name}", T.StructType.fromJson(kept["schema"]))
        if verify and content(df) != {k: kept[k] for k in ("schema", "rows", "digest")}:
            raise ValueError(f"{name} of bundle {last.version} is not what was written")
        out[name] = df
    return out
