"""Ordered, limited reads of a log."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import names
from chronolith.sources.log import Log

DEFAULT_LIMIT, MAX_LIMIT = 1000, 10_000


@dataclass(frozen=True)
class ReadSpec:
    """What to read: ``ReadSpec().from_global(5).in_stream("a-1").with_limit(10).of(log)``.

    With both a global start and a stream, the limit counts rows of the whole log and the stream is picked from
    those. ``from_position`` starts inside the stream. Limits are held between 1 and 10,000.
    """

    start: int | None = None
    stream: str | None = None
    position: int | None = None
    limit: int = DEFAULT_LIMIT

    def from_global(self, position: int) -> ReadSpec:
        return replace(self, start=position)

    def in_stream(self, name: str) -> ReadSpec:
        return replace(self, stream=name)

    def from_position(self, position: int) -> ReadSpec:
        return replace(self, position=position)

    def with_limit(self, n: int) -> ReadSpec:
        return replace(self, limit=max(1, min(n, MAX_LIMIT)))

    def of(self, log: Log) -> DataFrame:
        if self.start is None and self.stream is None:
            raise ValueError("give a global start, a stream, or both")
        if self.position is not None and (self.stream is None or self.start is not None):
            raise ValueError("a position inside a stream needs a stream and no global start")
        if self.start is not None:
            first = log.df.filter(log.from_global(self.start)).orderBy("global_position").limit(self.limit)
            return first if self.stream is None else first.filter(F.col("stream_name") == self.stream)
        rows = log.df.filter(log.in_stream(self.stream))
        by = "global_position" if "global_position" in log.df.columns else "stream_position"
        if self.position is not None:
            rows = rows.filter(F.col("stream_position") >= self.position)
        return rows.orderBy(by).limit(self.limit)


def category_scan(log: Log, category: str, start: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    rows = log.df.filter(log.from_global(start) & (names.category(F.col("stream_name")) == category))
    return rows.orderBy("global_position").limit(max(1, min(limit, MAX_LIMIT)))


def latest(log: Log, stream: str) -> DataFrame:
    """The stream's last message, or no row."""
    return log.df.filter(log.in_stream(stream)).orderBy(F.col("global_position").desc()).limit(1)


def latest_of_all(messages: DataFrame, *cols: str) -> DataFrame:
    """Every stream's last message: one aggregation, combined before the shuffle."""
    last = F.max_by(F.struct("global_position", *cols), "global_position").alias("m")
    return messages.groupBy("stream_name").agg(last).select("stream_name", "m.*")


def last_positions(messages: DataFrame) -> DataFrame:
    """Every stream's largest encoded position as it is stored; a stream without messages has no row."""
    return messages.groupBy("stream_name").agg(F.max("position_enc").alias("position_enc"))


def last_global_position(messages: DataFrame) -> DataFrame:
    return messages.agg(F.coalesce(F.max("global_position"), F.lit(0)).cast("long").alias("global_position"))


def as_message(messages: DataFrame) -> DataFrame:
    """What readers see: empty metadata is null; ids and times stay inside."""
    return messages.select("global_position", "stream_position", "stream_name", "message_type", "data", F.nullif("metadata", F.lit("")).alias("metadata"))


def decoded(rows: DataFrame, json: Column, schema: str, keep_errors: bool = True) -> DataFrame:
    """The body as ``body``; rows that don't decode have ``error`` set and stay unless ``keep_errors`` is off."""
    body = F.from_json(json, schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    out = rows.withColumn("body", body).withColumn("error", F.col("body").isNull() | F.col("body._corrupt_record").isNotNull())
    return out if keep_errors else out.filter(~F.col("error"))


def decoded_strictly(rows: DataFrame, message_type: str, json: Column, schema: str) -> DataFrame:
    """Messages of exactly this type with their body; others have no row, and a body that doesn't decode fails the query."""
    body = F.from_json(json, schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    mine = rows.filter(F.col("message_type") == message_type).withColumn("body", body)
    bad = F.col("body").isNull() | F.col("body._corrupt_record").isNotNull()
    failed = F.raise_error(F.concat(F.lit("could not decode: "), F.coalesce(json, F.lit("null"))))
    return mine.withColumn("body", F.when(bad, failed).otherwise(F.col("body").dropFields("_corrupt_record")))
