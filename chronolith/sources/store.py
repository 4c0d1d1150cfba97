"""A stored log that commands are put into: both layouts, receipts and rejects of each put become visible together.

A put judges its commands against the last positions that are stored, numbers the accepted ones after the last
global position, and writes everything to a new folder under ``data``. Then one small file under ``commits``, made
only if no other writer has made it, publishes that folder. What was written without it is never read: so a put that
fails leaves nothing behind, and of two writers one gets ``CommitConflict``. A put with a tag that is already
committed does nothing, so a batch may be sent again after a failure.

Each commit also holds the last positions of the streams that it moved, so a put reads those narrow tables and not
the messages. Commit files hold the schema's version; older messages go through ``MIGRATIONS`` when they are read,
and newer ones are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith import errors
from chronolith.functions import positions
from chronolith.operators import append, read

from .log import MESSAGES, RECEIPTS, REJECTS, Log, store
from .storage import written

SCHEMA_VERSION = 2
#: Version -> what turns its messages into those of the next one. Version 1 had no encoded positions.
MIGRATIONS: dict[int, Callable[[DataFrame], DataFrame]] = {1: lambda m: m.withColumn("position_enc", positions.encode(F.col("stream_position")))}
_LAST = "stream_name string, position_enc bigint"


@dataclass(frozen=True)
class Commit:
    number: int
    data: str
    schema_version: int
    last_global: int
    tag: str | None


def migrated(messages: DataFrame, version: int) -> DataFrame:
    """Messages of an older version in today's schema."""
    if version > SCHEMA_VERSION:
        raise errors.SchemaVersionError(f"the log has schema version {version}; this is {SCHEMA_VERSION}")
    for v in range(version, SCHEMA_VERSION):
        if v not in MIGRATIONS:
            raise errors.SchemaVersionError(f"no migration from schema version {v}")
        messages = MIGRATIONS[v](messages)
    return messages.select(*MESSAGES.names)


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[Commit]:
        """What was published, in order. One small file a put; only the driver reads them."""
        at = self._hadoop.Path(f"{self.path}/commits")
        if not self._fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        return [Commit(**json.loads(self._read(f"{self.path}/commits/{n}"))) for n in names]

    def _read(self, file: str) -> str:
        stream = self._fs.open(self._hadoop.Path(file))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, c: Commit) -> None:
        """The whole file under a name of its own, then a rename, which file systems such as HDFS refuse where the number is taken."""
        folder = f"{self.path}/commits"
        self._fs.mkdirs(self._hadoop.Path(folder))
        own, final = self._hadoop.Path(f"{folder}/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{folder}/{c.number:012d}.json")
        out = self._fs.create(own, False)
        out.write(json.dumps(c.__dict__).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(own, final):
            self._fs.delete(own, False)
            raise errors.CommitConflict(f"commit {c.number} of {self.path} was made by another writer")

    def _parts(self, kind: str, schema) -> DataFrame:
        """The committed folders of one kind; those of one schema version are read in one scan."""
        by_version: dict[int, list[str]] = {}
        for c in self.commits():
            by_version.setdefault(c.schema_version, []).append(f"{self.path}/data/{c.data}/{kind}")
        out = None
        for version, folders in sorted(by_version.items()):
            part = self.spark.read.schema(schema).parquet(*folders)
            if kind in ("global", "stream"):
                part = migrated(part, version)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def log(self, layout: str = "global") -> Log:
        """The messages, clustered for global (``global``) or for stream scans (``stream``)."""
        return Log(self._parts(layout, MESSAGES))

    def last_positions(self) -> DataFrame:
        """stream_name, position_enc: the last stored one of every stream."""
        return read.last_positions(self._parts("last", _LAST))

    def receipts(self) -> DataFrame:
        return self._parts("receipts", RECEIPTS)

    def rejects(self) -> DataFrame:
        return self._parts("rejects", REJECTS)

    def put(self, cmds: DataFrame, tag: str | None = None, only_json: bool = False, time_ms: Column | None = None) -> Commit | None:
        """Append what is accepted of these commands; None if a commit has this tag already.

        ``only_json`` rejects commands whose data isn't JSON, before their positions are looked at.
        """
        before = self.commits()
        if tag is not None and any(c.tag == tag for c in before):
            return None
        last_global = before[-1].last_global if before else 0
        data = uuid.uuid4().hex
        at = f"{self.path}/data/{data}"
        good = F.coalesce(F.try_parse_json("data").isNotNull(), F.lit(False)) if only_json else F.lit(True)
        cmds = written(cmds.select("seq", "id", "stream_name", "message_type", "data", "metadata", F.col("expected").cast("long").alias("expected"), "kind", good.alias("_good")), "put-commands")
        stored = self.last_positions().select("stream_name", positions.position(F.col("position_enc")).alias("stream_position"))
        verdicts = written(append.judged(cmds.filter("_good").drop("_good"), stored), "put-verdicts")
        rejected = append.rejects(verdicts)
        if only_json:
            bad = cmds.filter(~F.col("_good")).select("seq", "stream_name", "expected", F.lit(None).cast("long").alias("got"), F.lit(errors.BAD_JSON).alias("reason"))
            rejected = rejected.unionByName(bad)
        append.receipts(verdicts, last_global).write.parquet(f"{at}/receipts")
        rejected.write.parquet(f"{at}/rejects")
        receipts = self.spark.read.schema(RECEIPTS).parquet(f"{at}/receipts")
        rows = append.message_rows(cmds.drop("_good"), receipts, time_ms)
        store(rows, f"{at}/global", "global")
        rows = self.spark.read.schema(MESSAGES).parquet(f"{at}/global")
        store(rows, f"{at}/stream", "stream")
        read.last_positions(rows).write.parquet(f"{at}/last")
        n = receipts.agg(F.coalesce(F.max("global_position"), F.lit(last_global))).first()[0]
        commit = Commit(before[-1].number + 1 if before else 1, data, SCHEMA_VERSION, n, tag)
        self._publish(commit)
        return commit


def append_stream(commands: DataFrame, target: LogStore, checkpoint: str, name: str = "append", only_json: bool = False):
    """A streaming query that puts each micro-batch; start it again with the same checkpoint and it goes on.

    Batches are taken in order and each is numbered after what is stored. The tag holds the batch id: a batch that
    was committed before the query stopped is not put twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        target.put(batch, f"{name}-{batch_id}", only_json)

    return commands.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
