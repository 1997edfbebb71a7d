"""Structured Streaming front ends for the stateless row operators.

Cleaning (P4-P14 without stemming) and tuple extraction (E1-E9) are pure
projections, generators and filters, so the very same functions run on a
streaming DataFrame: no state, no watermark, exactly-once through the file
sink's commit log and the checkpoint.  Vocabulary filtering, hierarchy and
retrieval aggregate over whole tables and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimtext.functions import text as TX
from claimtext.functions.patterns import Lexicon
from claimtext.operators.extract import extract_tuples


def read_claims_stream(spark: SparkSession, source_dir: str, schema: T.StructType, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def extract_stream(claims: DataFrame, id_col: str = "claim_id", text_col: str = "description",
                   lexicon: Lexicon | None = None) -> DataFrame:
    """Tuples of a claims stream (same plan as the batch job)."""
    return extract_tuples(claims, id_col, text_col, lexicon=lexicon)


def clean_stream(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """P13 cleaning of a text stream."""
    return docs.select(id_col, TX.process_string(F.col(text_col)).alias("processed"))


def start_file_sink(df: DataFrame, sink_dir: str, checkpoint_location: str, fmt: str = "parquet",
                    available_now: bool = True, query_name: str | None = None) -> StreamingQuery:
    """Append the stream to files; ``available_now`` processes what is there and stops."""
    w = df.writeStream.format(fmt).option("checkpointLocation", checkpoint_location).outputMode("append")
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(sink_dir)
