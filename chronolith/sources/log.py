"""The log's schemas, logs over the given tables, and stored logs.

A ``Log`` is a DataFrame of messages and the predicates by which its source can start at a position or keep to
a stream; where those columns are derived, the predicates name the stored ones, so they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions import names, positions

def _schema(fields: str) -> T.StructType:
    kinds = {"bigint": T.LongType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))])


MESSAGES = _schema("global_position bigint, stream_name string, stream_position bigint, position_enc bigint, message_type string, data string, metadata string, id string, time_ms bigint")
COMMANDS = _schema("seq bigint, id string, stream_name string, message_type string, data string, metadata string, expected bigint, kind string")
RECEIPTS = _schema("seq bigint, stream_name string, global_position bigint, stream_position bigint")
REJECTS = _schema("seq bigint, stream_name string, expected bigint, got bigint, reason string")


@dataclass(frozen=True)
class Log:
    df: DataFrame
    from_global: Callable[[int], Column] = lambda p: F.col("global_position") >= p
    in_stream: Callable[[str], Column] = lambda s: F.col("stream_name") == s


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream_position(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("stream_name").orderBy("global_position")
    df = df.withColumn("stream_position", (F.row_number().over(order) - 1).cast("long"))
    return df.withColumn("position_enc", positions.encode(F.col("stream_position")))


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``events`` without positions in their streams (those need a shuffle by stream)."""
    e = table(spark, sf_dir, "events")
    meta = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit('{"correlationStreamName": "user-'), F.col("user_id"), F.lit('"}')))
    return e.select(
        "event_id", "event_type", "user_id", (F.col("event_id") + 1).alias("global_position"), F.concat_ws("-", "event_type", "user_id").alias("stream_name"),
        F.col("event_type").alias("message_type"), F.col("props").alias("data"), meta.alias("metadata"), names.encode_id(F.col("event_id")).alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"),
    )


def _number(text: str) -> int | None:
    """The number that prints as this text; None for any other text."""
    return int(text) if text.isascii() and text.isdigit() and str(int(text)) == text and int(text) < 1 << 63 else None


def _numbered(s: str, prefix: str, column: str) -> Column:
    """Rows of the stream ``prefix-<number>``; of any other name there are none."""
    kind, _, number = s.partition("-")
    return F.lit(False) if kind != prefix or _number(number) is None else F.col(column) == _number(number)


def _in_event_stream(s: str) -> Column:
    kind, _, user = s.partition("-")
    return F.lit(False) if _number(user) is None else (F.col("event_type") == kind) & (F.col("user_id") == _number(user))


def events_log(spark: SparkSession, sf_dir: str) -> Log:
    return Log(events_base(spark, sf_dir), lambda p: F.col("event_id") >= p - 1, _in_event_stream)


def events_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_position(events_base(spark, sf_dir))


def orders_log(spark: SparkSession, sf_dir: str) -> Log:
    """Orders as a longer log: a stream for each customer."""
    o = table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", "o_custkey", (F.col("o_orderkey") + 1).alias("global_position"), F.concat(F.lit("customer-"), F.col("o_custkey")).alias("stream_name"), F.col("o_orderstatus").alias("message_type"))
    return Log(df, lambda p: F.col("o_orderkey") >= p - 1, lambda s: _numbered(s, "customer", "o_custkey"))


def conversations_log(spark: SparkSession, sf_dir: str) -> Log:
    """Conversations as a log whose positions are stored with it."""
    c = table(spark, sf_dir, "conversations")
    return Log(c.select(F.concat(F.lit("conv-"), F.col("conv_id")).alias("stream_name"), F.col("turn").alias("stream_position"), F.col("role").alias("message_type"), F.col("text").alias("data"), "conv_id"), in_stream=lambda s: _numbered(s, "conv", "conv_id"))


def commands(spark: SparkSession, sf_dir: str, gappy: bool = False) -> DataFrame:
    """Write commands for ``events``, each expecting the position before its own; every tenth is sent twice.

    ``gappy`` leaves out some first sends, so that later commands of those streams are rejected as well.
    """
    m = events_messages(spark, sf_dir)
    base = m.select(
        (2 * F.col("event_id")).alias("seq"), "id", "stream_name", "message_type", "data", "metadata",
        F.when(F.col("stream_position") > 0, F.col("stream_position") - 1).alias("expected"), F.lit("sequential").alias("kind"), "event_id",
    )
    again = base.filter("event_id % 10 = 0").withColumn("seq", F.col("seq") + 1)
    first = base.filter("event_id % 97 != 13") if gappy else base
    return first.unionByName(again).drop("event_id")


def store(messages: DataFrame, path: str, by: str = "global") -> None:
    """Write a log clustered for global scans (``global``) or for stream scans (``stream``)."""
    if by == "global":
        out = messages.repartitionByRange("global_position").sortWithinPartitions("global_position")
    else:
        out = messages.repartitionByRange("stream_name", "position_enc").sortWithinPartitions("stream_name", "position_enc")
    out.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> Log:
    return Log(spark.read.schema(MESSAGES).parquet(path))
