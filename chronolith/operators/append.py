"""Appending commands to a log under optimistic concurrency.

A command names the stream position that it expects to be the last one (null: the stream is new). In order of
``seq`` it is accepted where that holds, which moves the stream on by one, and rejected otherwise. Accepted
commands get dense global positions.

Streams of up to ``LONG`` commands in a batch are folded as one sorted array. Longer ones aren't gathered: each
command finds, by a window over (stream, position), the first later command that expects what it would write,
and the chain of accepted ones is followed by doubling those pointers in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith import errors
from chronolith.functions import positions
from chronolith.sources.storage import written

from .ordered import number

#: A stream's commands are folded as one array up to here: each step copies one flag a command, a byte.
LONG = 1000


def _folded(cmds: DataFrame, last: DataFrame) -> DataFrame:
    """seq, stream_name, expected, kind, ok and the stream's stored last position."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "expected", "kind"))).alias("rows")
    streams = cmds.groupBy("stream_name").agg(rows).join(last, "stream_name", "left")

    def judge(acc, c):
        ok = c["expected"].eqNullSafe(acc["last"]) & F.coalesce(c["kind"] == "sequential", F.lit(True))
        moved = F.when(ok, F.coalesce(acc["last"] + 1, F.lit(0).cast("long"))).otherwise(acc["last"])
        return F.struct(moved.alias("last"), F.concat(acc["flags"], F.when(ok, "1").otherwise("0")).alias("flags"))

    start = F.struct(F.col("last").alias("last"), F.lit("").alias("flags"))
    done = streams.withColumn("flags", F.aggregate("rows", start, judge)["flags"])
    each = done.select("stream_name", "last", "flags", F.posexplode("rows").alias("at", "c"))
    return each.select("c.seq", "stream_name", "c.expected", "c.kind", (F.substr("flags", F.col("at") + 1, F.lit(1)) == "1").alias("ok"), "last")


def _chained(cmds: DataFrame, last: DataFrame) -> DataFrame:
    """The same for long streams, by pointers from each command to the one that would follow it."""
    c = written(cmds.join(last, "stream_name", "left").select("seq", "stream_name", "expected", "kind", "last"), "append-long")
    usable = c.filter(F.coalesce(F.col("kind") == "sequential", F.lit(True)))
    need = F.coalesce(F.col("expected") + 1, F.lit(0))
    asks = usable.select("stream_name", need.alias("p"), "seq", F.lit(False).alias("offer"))
    offers = usable.select("stream_name", "expected", "seq", F.lit(True).alias("offer")).filter("expected is not null").withColumnRenamed("expected", "p")
    after = Window.partitionBy("stream_name", "p").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    both = asks.unionByName(offers)
    jump = both.withColumn("next", F.first(F.when(F.col("offer"), F.col("seq")), ignorenulls=True).over(after)).filter(~F.col("offer")).select("seq", "next")
    jump = written(jump.filter("next is not null"), "append-jump")
    roots = usable.filter(F.col("expected").eqNullSafe(F.col("last"))).groupBy("stream_name").agg(F.min("seq").alias("seq")).select("seq")
    took = written(roots, "append-took")
    while not jump.isEmpty():
        more = took.join(jump, "seq").select(F.col("next").alias("seq"))
        took = written(took.union(more).distinct(), "append-took")
        far = jump.select("seq", F.col("next").alias("via")).join(jump.select(F.col("seq").alias("via"), "next"), "via")
        jump = written(far.select("seq", "next"), "append-jump")
    return c.join(took.withColumn("ok", F.lit(True)), "seq", "left").select("seq", "stream_name", "expected", "kind", F.coalesce("ok", F.lit(False)).alias("ok"), "last")


def judged(cmds: DataFrame, log: DataFrame | None = None, long: int = LONG) -> DataFrame:
    """seq, stream_name, expected, kind, ok, got of every command; ``log``: stream_name, stream_position of what is stored.

    The commands are read more than once: give a stored table, not one that is costly to compute.
    """
    spark = cmds.sparkSession
    cols = cmds.select("seq", "stream_name", F.col("expected").cast("long").alias("expected"), "kind")
    if log is None:
        last = spark.createDataFrame([], "stream_name string, last bigint")
    else:
        last = log.groupBy("stream_name").agg(F.max("stream_position").alias("last"))
    big = written(cols.groupBy("stream_name").count().filter(F.col("count") > long).select("stream_name"), "append-big")
    out = _folded(cols.join(big, "stream_name", "left_anti"), last)
    if not big.isEmpty():
        out = out.unionByName(_chained(cols.join(big, "stream_name"), last))
    upto = Window.partitionBy("stream_name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.sum(F.col("ok").cast("long")).over(upto)
    got = F.coalesce(F.col("last"), F.lit(-1)) + F.coalesce(taken, F.lit(0))
    return out.withColumn("got", F.when(got >= 0, got)).drop("last")


def receipts(verdicts: DataFrame, last_global: int = 0) -> DataFrame:
    """seq, stream_name, global_position, stream_position of the accepted commands."""
    ok = verdicts.filter("ok").select("seq", "stream_name", F.coalesce(F.col("expected") + 1, F.lit(0)).cast("long").alias("stream_position"))
    return number(ok, "seq", "global_position", last_global).select("seq", "stream_name", "global_position", "stream_position")


def rejects(verdicts: DataFrame) -> DataFrame:
    reason = F.when(F.coalesce(F.col("kind") == "sequential", F.lit(True)), errors.WRONG_POSITION).otherwise(errors.UNSUPPORTED_KIND)
    return verdicts.filter(~F.col("ok")).select("seq", "stream_name", "expected", "got", reason.alias("reason"))


def message_rows(cmds: DataFrame, receipts_: DataFrame, time_ms: Column | None = None) -> DataFrame:
    """The messages that accepted commands become: position = expected + 1 or 0, empty metadata null."""
    time_ms = F.lit(0) if time_ms is None else time_ms
    rows = cmds.drop("expected", "kind").join(receipts_.select("seq", "global_position", "stream_position"), "seq")
    return rows.select(
        "global_position", "stream_name", "stream_position", positions.encode(F.col("stream_position")).alias("position_enc"), "message_type", "data",
        F.nullif("metadata", F.lit("")).alias("metadata"), "id", time_ms.cast("long").alias("time_ms"),
    )


def raise_first(rejected: DataFrame) -> None:
    """The first rejected command as an exception, for callers who want all or an error."""
    r = rejected.orderBy("seq").first()
    if r is None:
        return
    if r["reason"] == errors.WRONG_POSITION:
        raise errors.WrongStreamPosition(r["stream_name"], r["expected"], r["got"])
    raise errors.LogError(f"{r['reason']}: command {r['seq']} of {r['stream_name']}")


def duplicate_ids(messages: DataFrame) -> DataFrame:
    return messages.groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).filter("n > 1")
