"""Structured Streaming forms of the resumable scoring job (U3 + J4 + K5) and of
running evaluation metrics.

New input files are picked up incrementally; the stream's checkpoint (under
the cluster's shared ``spark.checkpoint.dir`` unless given) records which
files were processed, so a restarted job — or one that lost executors —
continues where it stopped.  Each micro-batch writes to its own
``epoch=<id>`` folder with overwrite, so a replayed batch replaces its own
output instead of duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from evalcrate.operators.classify import clean_binary_responses, em_confusion
from evalcrate.operators.scoring import score_fn


def _ckpt(spark: SparkSession, name: str, given: str | None) -> str:
    """A folder that outlives the process: the given one, else one under the configured ``spark.checkpoint.dir``."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not given and not shared:
        raise ValueError("give a checkpoint folder or set spark.checkpoint.dir: a stream restarts from it")
    return given or f"{shared.rstrip('/')}/streams/{name}"


def stream_score(spark: SparkSession, input_path: str, schema: StructType | str, fn: Callable[[list[str]], list[str]],
                 id_col: str, input_col: str, output_path: str, checkpoint: str | None = None,
                 max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Score parquet files as they arrive; outputs land in ``output_path/epoch=N``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(input_path)

    def each(batch: DataFrame, epoch_id: int) -> None:
        scored = score_fn(batch, fn, id_col, input_col)
        scored.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/epoch={epoch_id}")

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", _ckpt(spark, "score", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_em_metrics(spark: SparkSession, input_path: str, schema: StructType | str, response_col: str,
                      truth_col: str, positive: str = "y", negative: str = "n", stop_tokens=None,
                      query_name: str = "em_metrics", checkpoint: str | None = None,
                      available_now: bool = True) -> StreamingQuery:
    """Running entity-matching metrics (M1) over prediction files as they arrive
    (complete-mode aggregate: the state is a handful of counters)."""
    src = spark.readStream.schema(schema).parquet(input_path)
    cleaned = clean_binary_responses(src, response_col, truth_col, positive, negative, stop_tokens=stop_tokens)
    metrics = em_confusion(cleaned)
    w = (metrics.writeStream.outputMode("complete").format("memory").queryName(query_name)
         .option("checkpointLocation", _ckpt(spark, query_name, checkpoint)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
