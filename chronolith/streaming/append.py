"""Streaming append and fold: the batch operators' results, kept up to date by Structured Streaming.

One number of state a stream (its last position) decides each command. Rows of one batch and stream are taken
in order of ``seq``. Sinks are files in the shared folder, written once for each batch id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from chronolith.sources.storage import new_path

VERDICTS = "seq long, stream_name string, expected long, kind string, ok boolean, got long"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AppendCheck(StatefulProcessor):
    """Accepts a command whose expected position is the stream's last one, and moves that on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("position", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        for r in sorted(rows, key=lambda r: r["seq"]):
            ok = r["expected"] == last and r["kind"] in ("sequential", None)
            yield Row(seq=r["seq"], stream_name=key[0], expected=r["expected"], kind=r["kind"], ok=ok, got=last)
            if ok:
                last = 0 if last is None else last + 1
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def judged(commands: DataFrame) -> DataFrame:
    """Verdicts of a stream of commands (columns as in the batch form)."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = commands.select("seq", "stream_name", "expected", "kind")
    return rows.groupBy("stream_name").transformWithState(AppendCheck(), VERDICTS, "Update", "None")


def files(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, at most ``max_files`` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def drained(stream: DataFrame, label: str, mode: str = "update", finish: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what there is now, each batch into a folder of its own, and return the result so far.

    In ``complete`` mode the last batch is the result, otherwise all of them are. A batch that is run again
    after a failure overwrites its own folder. With the ``folder`` of an earlier call the stream goes on from there.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, label)
    out = f"{folder}/batches"

    def sink(batch: DataFrame, batch_id: int) -> None:
        (finish(batch) if finish else batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    done = spark.read.parquet(out)
    if mode == "complete":
        done = done.filter(F.col("batch") == done.agg(F.max("batch")).first()[0])
    return done.drop("batch")


def last_writer(messages: DataFrame, fields: dict[str, tuple[Column, Column]], stream: str = "stream_name", order: str = "global_position") -> DataFrame:
    """The streaming form of the last-writer fold; run it in ``complete`` mode."""
    aggs = [F.max_by(value, F.when(writes, F.col(order))).alias(name) for name, (value, writes) in fields.items()]
    return messages.groupBy(stream).agg(*aggs, F.count("*").alias("n_messages"))
