"""The log engine: golden values, a dictionary model of appends, and streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import clock, names, positions
from chronolith.operators import append, fold, ordered, read
from chronolith.operators.read import ReadSpec
from chronolith.plans.queries import with_ord
from chronolith.sources import log
from chronolith.streaming import append as streaming

COMMANDS = "seq long, id string, stream_name string, message_type string, data string, metadata string, expected long, kind string"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def messages(spark, per_stream):
    rows = []
    for i in range(per_stream):
        for s in ("stream1", "stream2"):
            rows.append((len(rows) + 1, s, i, 2 * i, "X", str(i), None, f"{s}-{i}", 0))
    return log.Log(spark.createDataFrame(rows, log.MESSAGES))


# --- reads


def test_limits_are_held_between_1_and_10000():
    assert ReadSpec().limit == 1000 and ReadSpec().start is None and ReadSpec().stream is None
    assert [ReadSpec().with_limit(n).limit for n in (-200, 0, 1, 500, 10**9)] == [1, 1, 1, 500, 10_000]


def test_spec_needs_a_start_or_a_stream(spark):
    for bad in (ReadSpec(), ReadSpec().from_position(1), ReadSpec().from_global(1).in_stream("s").from_position(1)):
        with pytest.raises(ValueError):
            bad.of(messages(spark, 1))


def test_scans(spark):
    m = messages(spark, 5)
    rows = ReadSpec().from_global(0).with_limit(6).of(m).collect()
    assert len(rows) == 6 and (rows[0].global_position, rows[0].stream_name, rows[0].stream_position) == (1, "stream1", 0)
    first = ReadSpec().from_global(5).of(m).first()
    assert (first.global_position, first.stream_name, first.stream_position) == (5, "stream1", 2)
    assert ReadSpec().from_global(500).of(m).count() == 0
    assert {x.stream_name for x in ReadSpec().in_stream("stream2").of(m).collect()} == {"stream2"}
    assert [x.stream_position for x in ReadSpec().in_stream("stream1").from_position(3).of(m).collect()] == [3, 4]
    # the limit counts rows of the whole log before the stream is picked
    assert ReadSpec().from_global(1).in_stream("stream2").with_limit(4).of(m).count() == 2
    last = read.latest(m, "stream1").first()
    assert (last.global_position, last.stream_position, last.data) == (9, 4, "4")
    assert read.latest(m, "other").count() == 0
    assert read.last_global_position(m.df).first().global_position == 10
    assert read.last_global_position(m.df.limit(0)).first().global_position == 0


def test_default_and_largest_limit(spark):
    assert ReadSpec().from_global(0).of(messages(spark, 550)).count() == 1000
    assert ReadSpec().from_global(0).with_limit(100_000).of(messages(spark, 5010)).count() == 10_000


def test_stored_log_pushes_filters(spark, tmp_path):
    log.store(messages(spark, 20).df, str(tmp_path / "g"))
    m = log.stored(spark, str(tmp_path / "g"))
    plan = ReadSpec().from_global(5).of(m)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(global_position,5)" in plan and "TakeOrderedAndProject" in plan


# --- positions, clock, names


def test_positions(spark):
    seven = F.lit(7).cast("long")
    assert one(spark, positions.encode(seven)) == 14 and one(spark, positions.encode(seven, True)) == 15
    for e, relaxed in ((14, False), (15, True)):
        enc = F.lit(e).cast("long")
        assert one(spark, positions.is_relaxed(enc)) is relaxed and one(spark, positions.position(enc)) == 7
    assert one(spark, positions.global_key(F.lit(10).cast("long"))) == "000000000000000A"
    key = positions.stream_key(F.lit("somestream"), F.lit(26).cast("long"))
    assert one(spark, key) == "somestream|".encode().hex().upper() + "000000000000001A"
    parsed = one(spark, positions.parse_stream_key(key))
    assert (parsed.stream_name, parsed.position_enc) == ("somestream", 26)
    for bad in ("00000000", "0" * 22):
        assert one(spark, positions.parse_global_key(F.lit(bad))) is None
    for bad in ("7C" + "0" * 16, "41" * 12, "00"):
        assert one(spark, positions.parse_stream_key(F.lit(bad))) is None


def test_clock(spark):
    t = clock.tick(F.lit(1_672_628_645_678_000).cast("long"))
    assert one(spark, clock.seconds(t)) == 1_672_628_645
    assert abs(one(spark, clock.seconds_exact(t)) - 1_672_628_645.678) < 0.1
    assert one(spark, clock.with_offset(t, 17) - t) == 17
    assert one(spark, clock.tick(F.lit(0).cast("long"))) == 0
    assert [one(spark, clock.next_after(F.lit(a), F.lit(b))) for a, b in ((100, 200), (300, 200), (200, 200))] == [200, 301, 200]


def test_running_values_equal_a_loop(spark):
    r = random.Random(1)
    ticks = [r.randrange(50) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(ticks, 1)), "global_position long, tick long")
    got = [x.ord for x in with_ord(df).orderBy("global_position").collect()]
    want, last = [], None
    for t in ticks:
        last = t if last is None else max(t, last + 1)
        want.append(last)
    assert got == want
    seen = [x.m for x in ordered.running_max(df, "global_position", F.col("tick"), "m", current=False).orderBy("global_position").collect()]
    assert seen == [None] + [max(ticks[:i]) for i in range(1, 300)]
    assert [x.n for x in ordered.number(df, "global_position", "n", 7).orderBy("global_position").collect()] == list(range(8, 308))


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("stream-1234", ("stream", "1234", None)), ("stream-1234:extra", ("stream", "1234", "extra")), ("stream-12-34", ("stream", "12-34", None)), ("stream:ex-tra", ("stream", None, "ex-tra")),
        ("str:eam-12-34", ("str", None, "eam-12-34")), ("str:eam-12-34:ex-tra", ("str", None, "eam-12-34:ex-tra")), ("", ("", None, None)), ("-1:x", ("", "1", "x")),
    ],
)
def test_entity_names(spark, name, parts):
    n = F.lit(name)
    assert (one(spark, names.component(n)), one(spark, names.entity_id(n)), one(spark, names.extra(n))) == parts


@pytest.mark.parametrize(("name", "parts"), [("thing-xyz123+v2", ("thing", "xyz123+v2", "xyz123")), ("a-b+c+d", ("a", "b+c+d", "b")), ("thing-a-b", ("thing", "a-b", "")), ("nodash", ("", "nodash", "")), ("-x", ("", "x", "")), ("thing-", ("thing", "", ""))])
def test_storage_names(spark, name, parts):
    n = F.lit(name)
    assert (one(spark, names.category(n)), one(spark, names.stream_id(n)), one(spark, names.cardinal_id(n))) == parts


def test_ids_and_built_names(spark):
    big = names.encode_id(F.lit(2**10).cast("long"))
    assert one(spark, names.build(F.lit("streamWithMoreWords"), big)) == "streamWithMoreWords-000000-00000000-000100"
    assert one(spark, names.build(F.lit(""), big)) == ""
    assert one(spark, names.build(F.lit("a"), F.lit("1"), F.array(F.lit("x"), F.lit("y")))) == "a-1:x,y"


# --- append


def model(rows):
    """Arrival order, one last position a stream."""
    last, out = {}, {}
    for seq, s, expected, kind in sorted(rows, key=lambda r: r[0]):
        ok = expected == last.get(s) and kind in ("sequential", None)
        out[seq] = (ok, last.get(s))
        if ok:
            last[s] = 0 if expected is None else expected + 1
    return out


def commands(spark, rows):
    return spark.createDataFrame([(q, f"i{q}", s, "T", "{}", None, e, k) for q, s, e, k in rows], COMMANDS)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("long", [10_000, 0])
def test_append_equals_the_model(spark, seed, long):
    r = random.Random(seed)
    rows = [(3 * i + 1, f"s{r.randrange(3)}", r.choice([None, *range(6)]), r.choice(["sequential"] * 9 + ["relaxed"])) for i in range(150)]
    got = append.judged(commands(spark, rows), long=long).collect()
    assert {x.seq: (x.ok, x.got) for x in got} == model(rows)


def test_append_golden(spark):
    rows = [(1, "stream1", None, None), (2, "stream2", None, None), (3, "stream1", 0, None), (4, "stream2", 0, None), (5, "stream1", 2, None), (6, "new", 77, None), (7, "", None, None), (8, "stream1|x", None, None)]
    v = append.judged(commands(spark, rows))
    got = [(x.seq, x.global_position, x.stream_position) for x in append.receipts(v).orderBy("seq").collect()]
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 1), (4, 4, 1), (7, 5, 0), (8, 6, 0)]
    bad = {x.seq: (x.expected, x.got) for x in append.rejects(v).collect()}
    assert bad == {5: (2, 1), 6: (77, None)}
    stored = spark.createDataFrame([("stream1", 0), ("stream1", 1)], "stream_name string, stream_position long")
    later = append.judged(commands(spark, [(9, "stream1", 1, "sequential"), (10, "stream1", None, "sequential")]), stored)
    assert {x.seq: x.ok for x in later.collect()} == {9: True, 10: False}
    assert append.receipts(later, last_global=40).first().global_position == 41


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, f"s{r.randrange(4)}", r.choice([None, 0, 1, 2, 3]), "sequential") for i in range(120)]
    for k in range(3):
        commands(spark, rows[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streaming.files(spark, str(tmp_path / "in"), commands(spark, rows).schema)
    got = streaming.drained(streaming.judged(live), "t").collect()
    assert {x.seq: (x.ok, x.got) for x in got} == model(rows)


# --- folds


def test_folds(spark):
    rows = [(i + 1, f"e{i % 3}", i % 7) for i in range(60)]
    m = spark.createDataFrame(rows, "global_position long, stream_name string, k long")
    last = fold.last_writer(m, {"k": (F.col("k"), F.col("k") < 5)}).collect()
    want = {s: [k for _, t, k in rows if t == s and k < 5][-1] for s in ("e0", "e1", "e2")}
    assert {x.stream_name: x.k for x in last} == want
    assert fold.first_n(m, n=4).count() == 12
    total = fold.by_array(m, F.lit(0).cast("long"), lambda s, x: s + x["k"], ["k"], n=4).collect()
    assert {x.stream_name: x.state for x in total} == {s: sum([k for _, t, k in rows if t == s][:4]) for s in want}
    some = fold.with_defaults(spark.createDataFrame([("e0",), ("none",)], "stream_name string"), fold.last_writer(m, {"k": (F.col("k"), F.lit(True))}), {"k": F.lit(-1)})
    assert {x.stream_name: x.k for x in some.collect()} == {"e0": rows[57][2], "none": -1}


def test_decoding_keeps_or_drops_errors(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{"), (3, None)], "i long, data string")
    kept = {x.i: (x.body.k if x.body else None, x.error) for x in read.decoded(df, F.col("data"), "k long").collect()}
    assert kept == {1: (3, False), 2: (None, True), 3: (None, True)}
    assert [x.i for x in read.decoded(df, F.col("data"), "k long", False).collect()] == [1]
