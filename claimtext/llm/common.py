"""Session and column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtext.session import ensure_checkpoint_dir, table_path

# ASCII white space as a Java character class; words are what lies between.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and cut its lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(make, spark) -> DataFrame:
    """make(), whose shuffle files Spark removes when they have been read.

    make ends in a checkpoint, so nothing reads those files again; without
    this they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return make()
    finally:
        spark.conf.set(CLEANUP, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have (case-insensitively), made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator's result columns replace."""
    lower = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in lower])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def computed(df: DataFrame, columns: dict[str, Column], *others: Column) -> DataFrame:
    """Select others and the named columns, evaluated once and where they stand.

    Catalyst moves a filter on a projected column below the projection by
    writing the expression into it; for lambdas over arrays of earlier
    projections that means evaluating them again for each element.  A
    generator's output stays where it is.
    """
    made, = fresh(df, "made")
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    out = df.select(*others, F.explode_outer(one).alias(made))
    return out.select(*[quoted(c) for c in out.columns[:-1]], *[F.col(f"{made}.`{n}`").alias(n) for n in columns])


def remove_folder(spark, path: str) -> None:
    """Delete a folder that the job wrote below the checkpoint folder and has read to the end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
