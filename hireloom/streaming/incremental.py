"""Processing as a stream of postings: each micro-batch appends its new decisions.

Decisions are keyed by posting, revision and versions, so a batch that is run again
after a failure adds nothing twice: what its earlier attempt has written is no longer
pending. One writer a table is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import Candidate
from ..operators.normalize import HardFilterConfig
from ..operators.process import decide, process
from ..scratch import checkpointed


def append_decisions(batch: DataFrame, path: str, candidate: Candidate, config: HardFilterConfig, processing_time: str) -> None:
    """Decisions of the batch's postings that have none at path yet, appended there."""
    spark: SparkSession = batch.sparkSession
    shape = decide(batch.limit(0), candidate, config, processing_time)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    made = spark.read.schema(shape.schema).parquet(path) if exists else shape
    new = process(batch, made, candidate, config, processing_time)
    checkpointed(new).write.mode("append").parquet(path)


def start(postings: DataFrame, path: str, checkpoint: str, candidate: Candidate, config: HardFilterConfig, processing_time: str, available_now: bool = True) -> StreamingQuery:
    """A query over a stream of postings; available_now ends with what is there."""
    writer = postings.writeStream.foreachBatch(lambda batch, _: append_decisions(batch, path, candidate, config, processing_time)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
