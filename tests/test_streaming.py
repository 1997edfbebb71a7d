"""The stateless extraction runs unchanged on a file stream."""

import os
import tempfile

from claimtext.operators.extract import extract_tuples
from claimtext.streaming import extract_stream as XS

SCHEMA = ("claim_id long, description string, IndLesionGenouGauche boolean, IndLesionMain boolean, "
          "PrecisionLesionAutrePartieCorps string")


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="claimtext-stream-")
    src, sink, ck = (os.path.join(d, x) for x in ("src", "sink", "ck"))
    rows = [(1, "entorse genou gauche", True, False, None), (2, "mal genou et main", True, True, None),
            (3, "rien du tout ici", False, False, None)]
    batch = spark.createDataFrame(rows, SCHEMA)
    batch.write.parquet(src)
    stream = XS.read_claims_stream(spark, src, batch.schema)
    q = XS.start_file_sink(XS.extract_stream(stream), sink, ck)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    assert got == sorted(map(tuple, extract_tuples(batch).collect()))
    assert len(got) == 4


def test_clean_stream_equals_batch(spark):
    from claimtext.functions import text as TX
    d = tempfile.mkdtemp(prefix="claimtext-stream-")
    src, sink, ck = (os.path.join(d, x) for x in ("src", "sink", "ck"))
    batch = spark.createDataFrame([(1, "Été 2020: l'épaule de la main droite"), (2, "Genou, genou!")],
                                  "doc_id long, text string")
    batch.write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = XS.start_file_sink(XS.clean_stream(stream, "doc_id", "text"), sink, ck)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(sink).collect()))
    want = sorted(map(tuple, batch.select("doc_id", TX.process_string("text").alias("processed")).collect()))
    assert got == want == [(1, "ete epaule main droite "), (2, "genou genou ")]
