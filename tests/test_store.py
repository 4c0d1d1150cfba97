"""Stored logs: puts against the dictionary model, repeated and lost puts, restarts, versions, and the events around them."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronolith import errors
from chronolith.functions import clock, names, positions
from chronolith.operators import append, events, fold, read
from chronolith.operators.read import ReadSpec
from chronolith.plans.queries import decoded_posts, post_fields
from chronolith.sources import log
from chronolith.sources.store import LogStore, append_stream, migrated
from chronolith.streaming import append as streaming

from .test_log import COMMANDS, commands, model, one


def some(seed, n, streams=4):
    r = random.Random(seed)
    return [(i, f"s{r.randrange(streams)}", r.choice([None, 0, 1, 2, 3, 4]), r.choice(["sequential"] * 9 + ["relaxed"])) for i in range(n)]


def check(target, rows):
    """Everything that is stored against the model of all commands in order."""
    want = model(rows)
    seqs = [q for q in sorted(want) if want[q][0]]
    receipts = {x.seq: (x.global_position, x.stream_position) for x in target.receipts().collect()}
    assert receipts == {q: (i, 0 if want[q][1] is None else want[q][1] + 1) for i, q in enumerate(seqs, 1)}
    for layout in ("global", "stream"):
        m = target.log(layout).df.collect()
        assert sorted((x.id, x.global_position, x.stream_position, x.position_enc) for x in m) == sorted((f"i{q}", *receipts[q], 2 * receipts[q][1]) for q in seqs)
    assert {x.seq: x.got for x in target.rejects().collect()} == {q: got for q, (ok, got) in want.items() if not ok}
    last = {}
    for q in seqs:
        last[next(s for i, s, _, _ in rows if i == q)] = 2 * receipts[q][1]
    assert {x.stream_name: x.position_enc for x in target.last_positions().collect()} == last


def test_puts_equal_the_model(spark, tmp_path):
    rows = some(3, 120)
    target = LogStore(spark, f"file://{tmp_path}/log")
    assert target.log().df.count() == 0 and target.last_positions().count() == 0
    for at in (0, 50, 90):
        target.put(commands(spark, rows[at : {0: 50, 50: 90, 90: 120}[at]]))
    check(target, rows)
    target.put(commands(spark, rows[:0]))  # nothing to put
    check(target, rows)
    rows_of = ReadSpec().in_stream("s1").of(target.log("stream"))
    assert "EqualTo(stream_name,s1)" in rows_of._jdf.queryExecution().toString()


def test_a_tag_is_put_once_and_a_lost_put_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = some(4, 60)
    target = LogStore(spark, f"file://{tmp_path}/log")
    assert target.put(commands(spark, rows[:30]), "a").number == 1
    assert target.put(commands(spark, rows[:30]), "a") is None

    def stop(self, commit):
        raise RuntimeError("stopped before the commit")

    with monkeypatch.context() as m:
        m.setattr(LogStore, "_publish", stop)
        with pytest.raises(RuntimeError):
            target.put(commands(spark, rows[30:]), "b")
    check(target, rows[:30])
    target.put(commands(spark, rows[30:]), "b")
    check(target, rows)


def test_two_writers(spark, tmp_path, monkeypatch):
    rows = some(5, 40)
    target, other = (LogStore(spark, f"file://{tmp_path}/log") for _ in range(2))
    publish = LogStore._publish

    def late(self, commit):
        monkeypatch.setattr(LogStore, "_publish", publish)
        other.put(commands(spark, rows[:20]))
        publish(self, commit)

    monkeypatch.setattr(LogStore, "_publish", late)
    with pytest.raises(errors.CommitConflict):
        target.put(commands(spark, rows[20:]))
    check(target, rows[:20])


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = some(6, 90)
    target, at = LogStore(spark, f"file://{tmp_path}/log"), str(tmp_path / "in")
    put, stopped = LogStore.put, []

    def fail_once(self, cmds, tag=None, only_json=False, time_ms=None):
        out = put(self, cmds, tag, only_json, time_ms)
        if tag == "append-1" and not stopped:
            stopped.append(tag)
            raise RuntimeError("stopped after the commit, before the batch was done")
        return out

    for k in range(3):
        commands(spark, rows[30 * k : 30 * k + 30]).write.mode("append").parquet(at)
        q = lambda: append_stream(spark.readStream.schema(commands(spark, rows).schema).parquet(at), target, str(tmp_path / "checkpoint")).awaitTermination()
        LogStore.put = fail_once
        try:
            q()
        except PySparkException:
            assert k == 1
            q()
        finally:
            LogStore.put = put
    assert stopped and len(target.commits()) == 3
    check(target, rows)


def test_drained_goes_on(spark, tmp_path):
    rows, at, folder = some(7, 80), str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        commands(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(at)
        got = streaming.drained(streaming.judged(streaming.files(spark, at, commands(spark, rows).schema)), "t", folder=folder).collect()
        assert {x.seq: (x.ok, x.got) for x in got} == model(rows[: 40 * k + 40])


def test_schema_versions(spark, tmp_path, monkeypatch):
    m = spark.createDataFrame([(1, "s", 0, None, "T", "{}", None, "i", 0)], log.MESSAGES)
    assert migrated(m, 1).first().position_enc == 0
    for bad in (0, 3):
        with pytest.raises(errors.SchemaVersionError):
            migrated(m, bad)
    target = LogStore(spark, f"file://{tmp_path}/log")
    monkeypatch.setattr("chronolith.sources.store.SCHEMA_VERSION", 3)
    target.put(commands(spark, [(1, "s", None, None)]))
    monkeypatch.undo()
    with pytest.raises(errors.SchemaVersionError):
        target.log()


def test_data_that_is_not_json(spark, tmp_path):
    rows = [(1, "i1", "a", "T", "{}", "", None, None), (2, "i2", "a", "T", "{", None, 0, None), (3, "i3", "a", "T", '{"x": 1}', '{"m": 1}', 0, None), (4, "i4", "a", "T", None, None, 1, None)]
    target = LogStore(spark, f"file://{tmp_path}/log")
    target.put(spark.createDataFrame(rows, COMMANDS), only_json=True)
    assert {x.id: (x.stream_position, x.metadata) for x in target.log().df.collect()} == {"i1": (0, None), "i3": (1, '{"m": 1}')}
    assert {x.seq: x.reason for x in target.rejects().collect()} == {2: errors.BAD_JSON, 4: errors.BAD_JSON}
    with pytest.raises(errors.LogError, match="command 2 of a"):
        append.raise_first(target.rejects())


def test_wrong_position_as_an_exception(spark):
    v = append.judged(commands(spark, [(1, "a", None, None), (2, "a", 5, None)]))
    with pytest.raises(errors.WrongStreamPosition, match="expected 5, got 0") as e:
        append.raise_first(append.rejects(v))
    assert (e.value.stream, e.value.expected, e.value.got) == ("a", 5, 0)
    append.raise_first(append.rejects(v).filter("false"))


def test_long_streams_around_the_bound(spark):
    rows = some(8, 400, 3)
    for long in (133, 134, 10_000):
        assert {x.seq: (x.ok, x.got) for x in append.judged(commands(spark, rows), long=long).collect()} == model(rows)


def test_last_positions_golden(spark):
    m = spark.createDataFrame([("s1", 0x20), ("s1", 0x30), ("s1", 0x10), ("s2", 0x16), ("s2", 0x26), ("s2", 0x10)], "stream_name string, position_enc long")
    assert {x.stream_name: x.position_enc for x in read.last_positions(m).collect()} == {"s1": 0x30, "s2": 0x26}


def test_keys_and_wide_ids(spark):
    s, at = F.lit("a"), F.lit(26).cast("long")
    assert one(spark, positions.next_stream_key(s, at)) == one(spark, positions.stream_key(s, F.lit(28).cast("long")))
    assert one(spark, positions.max_stream_key(s)) == "617C" + "F" * 16
    assert one(spark, positions.key_error(positions.parse_stream_key(F.lit("00")))) == errors.BAD_KEY
    wide = lambda n: one(spark, names.encode_wide_id(F.lit(str(n)).cast("decimal(38,0)")))
    assert one(spark, names.build(F.lit("stream"), names.encode_wide_id(F.lit(str(2**100 - 1)).cast("decimal(38,0)")))) == "stream-zzzzzz-zzzzzzzz-zzzzzz"
    assert wide(2**10) == "000000-00000000-000100" and wide(0) == "000000-00000000-000000" and wide(2**50) == "000000-00010000-000000"


def test_clock_on_whole_numbers(spark):
    step = 50_000
    for k in (0, 1, 10**9, 10**11 + 7):
        us = 1_577_836_800_000_000 + k * step
        assert [one(spark, F.shiftright(clock.tick(F.lit(x).cast("long")), 16)) for x in (us - 1, us, us + step - 1)] == [max(0, k - 1), k, k]
    assert [one(spark, clock.millis(F.lit(x).cast("long"))) for x in (-1, 0, 1999, -1000)] == [-1, 0, 1, -1]


def test_unknown_streams_have_no_rows(spark):
    d = "/root/testdata/sf0.001"
    for source, known in ((log.conversations_log, "conv-3"), (log.orders_log, "customer-1"), (log.events_log, "click-7")):
        for name in ("other", "conv-x", "customer-²", "click-07", "conv-", "", "conv-99999999999999999999999"):
            assert ReadSpec().in_stream(name).of(source(spark, d)).count() == 0
        ReadSpec().in_stream(known).of(source(spark, d)).count()
    plan = ReadSpec().in_stream("customer-7").of(log.orders_log(spark, d))._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan


def test_strict_decoding(spark):
    rows = spark.createDataFrame([(1, "posted", '{"poster_id": "p"}'), (2, "Posted", "{"), (3, "other", "{")], "i long, message_type string, data string")
    got = read.decoded_strictly(rows, "posted", F.col("data"), "poster_id string").collect()
    assert [(x.i, x.body.poster_id) for x in got] == [(1, "p")]
    with pytest.raises(PySparkException, match="could not decode"):
        read.decoded_strictly(rows, "Posted", F.col("data"), "poster_id string").collect()


def test_events_put_and_folded(spark, tmp_path):
    rows = [(1, "1", "Posted", "p", "hello", "Unpublished", None), (2, "2", "Posted", "q", "hi", "Visible", None), (3, "1", "HiddenByPoster", None, None, None, 0), (4, "2", "Other", None, None, None, 0), (5, "1", "Posted", "p", "again", "HiddenByModerator", 1), (6, "2", "Posted", "q", "x", "Bogus", 1), (7, "1", "Posted", "p", "late", "Visible", 0)]
    e = spark.createDataFrame(rows, "seq long, entity string, event string, poster_id string, body string, status string, version long")
    body = F.when(F.col("event") == "Posted", F.struct("poster_id", "body", "status"))
    c = events.to_commands(e, F.lit("post"), F.col("entity"), F.col("event"), body, F.col("version"))
    target = LogStore(spark, f"file://{tmp_path}/log")
    target.put(c)
    assert [x.seq for x in target.rejects().collect()] == [7]
    state = {x.stream_name: (x.poster_id, x.body, x.status, x.n_messages) for x in fold.last_writer(decoded_posts(target.log().df), post_fields()).collect()}
    assert state == {"post-1": ("p", "again", "HiddenByModerator", 3), "post-2": ("q", "hi", "Visible", 3)}
    assert {x.metadata for x in target.log().df.collect()} == {None}
