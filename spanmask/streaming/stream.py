"""The redaction transform as a Structured Streaming job.

The deterministic layer is stateless per row, as is a scorer that works in the row, so the
batch transform is reused unchanged on a streaming DataFrame: no state store, no watermark.
With any other scorer each micro-batch runs the batch transform and replaces its own folder of
the sink, so a micro-batch that is run again writes the same rows once.  A restarted query resumes after the last micro-batch
its checkpoint has committed; therefore the checkpoint, or a query name that fixes its
place under ``spark.checkpoint.dir``, must be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import RedactConfig
from ..functions.detectors import PinRegistry
from ..plans.pipeline import redact
from ..plans.pipeline_full import release, row_scorer
from ..session import ensure_checkpoint_dir
from ..sources.io import decoded
from .totals import RunTotals


def read_text_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None, text_col: str = "text") -> DataFrame:
    """A stream of files; undecodable bytes of ``text_col`` become U+FFFD, no text "" (S1)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return decoded(reader.load(path), text_col)


def redact_stream(stream: DataFrame, sink_path: str, text_col: str = "text",
                  registry: PinRegistry | None = None, config: RedactConfig | None = None,
                  scorer=None, checkpoint: str | None = None, fmt: str = "parquet",
                  available_now: bool = True, query_name: str | None = None, totals: RunTotals | None = None) -> StreamingQuery:
    """Start the streaming redaction of ``stream`` into ``sink_path``; ``totals``, a listener that
    the session knows (``spark.streams.addListener``), gets the run's totals."""
    if checkpoint is None and query_name is None:
        raise ValueError("give checkpoint or query_name: without a fixed place a restart would begin again")
    spark, config = stream.sparkSession, config or RedactConfig()
    if checkpoint is None:
        checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{query_name}"
    no_model = config.disable_model or scorer is None
    if no_model or row_scorer(scorer, config):
        out = redact(stream, text_col, registry=registry, config=config, disable_model=no_model, scorer=scorer)
        if totals:
            out = totals.observe_stream(out)
        writer = out.writeStream.format(fmt).outputMode("append").option("path", sink_path)
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            done = redact(batch, text_col, registry=registry, config=config, disable_model=False, scorer=scorer)
            folder = f"{sink_path.rstrip('/')}/batch={batch_id}"

            def save(rows: DataFrame) -> DataFrame:
                rows.write.format(fmt).mode("overwrite").save(folder)
                return rows.sparkSession.read.format(fmt).schema(rows.schema).load(folder)

            try:
                totals.write_batch(done, save) if totals else save(done)
            finally:
                release(done)

        writer = stream.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", checkpoint)
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
