"""New vectors coded as they arrive: a stateless stream against a fixed model."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.quantizers import Quantizer

SCHEMA = "vec_id long, embedding array<float>"


def encode_stream(spark: SparkSession, model: Quantizer, source: str, sink: str, state: str, schema: str = SCHEMA, continuous: bool = False) -> StreamingQuery:
    """Parquet files of a folder to codes in another; with ``continuous`` it waits for more, else it ends
    with what is there. ``state`` is the stream's checkpoint folder, shared by the cluster."""
    codes = model.encode(spark.readStream.schema(schema).parquet(source))
    out = codes.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append")
    return (out if continuous else out.trigger(availableNow=True)).start()
