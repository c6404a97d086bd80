"""Structured Streaming flows: segment pickup, outbound gate, QA memory, audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import deident, gates
from palimpsest.streaming import memory


def stream_table(spark: SparkSession, folder: str, schema, glob: str = "*", per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def stream_segments(segments: DataFrame, *, path: str = "path") -> DataFrame:
    """Each closed, non-empty segment once, however late a path is seen again: the state holds every path (its hash partition's)."""
    return segments.where(F.col("size") > 0).dropDuplicates([path])


def gate_stream(texts: DataFrame, *, key: str = "doc_id", explicit=None, confirmed=None) -> DataFrame:
    """Scan and decide row by row; stateless, so the batch expressions run unchanged."""
    return gates.gate_documents(texts, key=key, explicit=explicit, confirmed=confirmed)


def start_gate(texts: DataFrame, allowed: str, blocked: str, checkpoint: str, *, key: str = "doc_id", text: str = "text"):
    """Route each micro-batch into two folders; a replayed batch overwrites itself."""

    def route(batch: DataFrame, epoch: int) -> None:
        passed = deident.scan_pass(batch.withColumn("original_text", F.col(text)), "mask", text=text)
        scans = passed.select(key, "original_text", F.size("hits").alias("n_hits")).persist()
        for folder, wanted in ((allowed, F.col("n_hits") == 0), (blocked, F.col("n_hits") > 0)):
            scans.where(wanted).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        scans.unpersist()

    return texts.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_qa(turns: DataFrame, answers: str, checkpoint: str, *, k: int = 3, session: str = "conv_id",
             turn: str = "turn", role: str = "role", text: str = "text", ttl_ms: int | None = None, every: str | None = None):
    """Answers with per-session memory, each written once.

    What a session has said and what was cited is keyed state in RocksDB
    (:mod:`palimpsest.streaming.memory`), saved with each micro-batch in
    ``checkpoint`` and found there when the flow starts again.  With ``ttl_ms``
    what is older is forgotten; such a flow never runs out of work, so it needs
    ``every``, the time between its micro-batches (``"10 seconds"``).  Without
    ``every`` the flow ends when what is there has been answered.
    """
    if ttl_ms and not every:
        raise ValueError("a flow that forgets runs until it is stopped: say how often")
    conf = turns.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, _ROCKSDB)
    try:
        done = memory.answers(turns, k=k, session=session, turn=turn, role=role, text=text, ttl_ms=ttl_ms)
        writer = done.writeStream.format("parquet").outputMode("append").option("path", answers)
        when = {"processingTime": every} if every else {"availableNow": True}
        return writer.option("checkpointLocation", checkpoint).trigger(**when).start()
    finally:
        conf.set(_STORE, before) if before is not None else conf.unset(_STORE)


def stream_audit(decisions: DataFrame, path: str, checkpoint: str):
    """Append-only decision log, exactly once through the sink's own log."""
    return decisions.writeStream.format("json").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain what is available into Parquet files and read them back."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
