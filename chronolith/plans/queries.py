"""The log engine's queries over the given tables, each with its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import clock, names, positions
from chronolith.operators import append, events, fold, ordered, read
from chronolith.operators.read import ReadSpec
from chronolith.sources import log
from chronolith.sources.storage import new_path, written
from chronolith.sources.store import LogStore, append_stream
from chronolith.streaming import append as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STREAM = "click-7"
SHOWN = ("global_position", "stream_name", "message_type", "data", "metadata", "id")

_ID = r"""regexp_replace(lpad(translate(lower(to_base({}, 32)), '0123456789abcdefghijklmnopqrstuv', '0123456789abcdefghjkmnpqrstvwxyz'), 20, '0'), '^(.{{6}})(.{{8}})(.{{6}})$', '\1-\2-\3')"""
_M = f"""m AS (SELECT event_id, event_type, user_id, event_id + 1 AS global_position, event_type || '-' || user_id AS stream_name, event_type AS message_type, props AS data,
  CASE WHEN event_id % 3 <> 0 THEN '{{"correlationStreamName": "user-' || user_id || '"}}' END AS metadata, {_ID.format("event_id")} AS id, epoch_us(ts) AS time_us,
  row_number() OVER (PARTITION BY event_type || '-' || user_id ORDER BY event_id) - 1 AS stream_position FROM events)"""
_SHOWN = ", ".join(SHOWN)
_TICK = "(greatest(0, ({} - 1577836800000000) // 50000) * 65536)"


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {_M} {sql}" if "FROM m" in sql else sql
        return f

    return keep


# --- ordered scans


@query(f"SELECT {_SHOWN} FROM m ORDER BY global_position LIMIT 1000")
def scan_global(spark, d):
    return ReadSpec().from_global(0).of(log.events_log(spark, d)).select(*SHOWN)


@query(f"SELECT {_SHOWN} FROM m WHERE global_position >= 500 ORDER BY global_position LIMIT 300")
def scan_global_from(spark, d):
    return ReadSpec().from_global(500).with_limit(300).of(log.events_log(spark, d)).select(*SHOWN)


@query(f"SELECT {_SHOWN} FROM m ORDER BY global_position LIMIT 1")
def scan_limit_min(spark, d):
    return ReadSpec().from_global(0).with_limit(-200).of(log.events_log(spark, d)).select(*SHOWN)


@query("SELECT o_orderkey + 1 AS global_position, 'customer-' || o_custkey AS stream_name, o_orderstatus AS message_type FROM orders ORDER BY 1 LIMIT 10000")
def scan_limit_max(spark, d):
    return ReadSpec().from_global(0).with_limit(100_000).of(log.orders_log(spark, d)).select("global_position", "stream_name", "message_type")


@query(f"SELECT {_SHOWN} FROM m WHERE stream_name = '{STREAM}' ORDER BY global_position LIMIT 1000")
def scan_stream(spark, d):
    return ReadSpec().in_stream(STREAM).of(log.events_log(spark, d)).select(*SHOWN)


@query("SELECT 'conv-' || conv_id AS stream_name, turn AS stream_position, role AS message_type, text AS data FROM conversations WHERE conv_id = 3 AND turn >= 1 ORDER BY turn LIMIT 1000")
def scan_stream_from(spark, d):
    return ReadSpec().in_stream("conv-3").from_position(1).of(log.conversations_log(spark, d)).drop("conv_id")


@query(f"SELECT * FROM (SELECT {_SHOWN} FROM m WHERE global_position >= 10 ORDER BY global_position LIMIT 2000) WHERE stream_name = '{STREAM}'")
def scan_global_in_stream(spark, d):
    return ReadSpec().from_global(10).in_stream(STREAM).with_limit(2000).of(log.events_log(spark, d)).select(*SHOWN)


@query(f"SELECT {_SHOWN} FROM m WHERE event_type = 'click' AND global_position >= 100 ORDER BY global_position LIMIT 1000")
def scan_category(spark, d):
    return read.category_scan(log.events_log(spark, d), "click", 100).select(*SHOWN)


# --- latest, lookups, projections


@query(f"SELECT {_SHOWN} FROM m WHERE stream_name = '{STREAM}' ORDER BY global_position DESC LIMIT 1")
def latest_message(spark, d):
    return read.latest(log.events_log(spark, d), STREAM).select(*SHOWN)


@query("SELECT stream_name, max(global_position) AS global_position, arg_max(message_type, global_position) AS message_type, arg_max(data, global_position) AS data, arg_max(id, global_position) AS id FROM m GROUP BY 1")
def latest_message_all(spark, d):
    return read.latest_of_all(log.events_base(spark, d), "message_type", "data", "id")


@query("SELECT stream_name, max(stream_position) AS stream_position, 2 * max(stream_position) AS position_enc FROM m GROUP BY 1")
def latest_position(spark, d):
    # positions are dense, so a count that combines before the shuffle gives the last one
    n = log.events_base(spark, d).groupBy("stream_name").agg((F.count("*") - 1).alias("stream_position"))
    return n.withColumn("position_enc", positions.encode(F.col("stream_position")))


@query("SELECT coalesce(max(event_id + 1), 0) AS global_position FROM events")
def last_global_position(spark, d):
    return read.last_global_position(log.events_base(spark, d))


@query(f"SELECT {_SHOWN} FROM m WHERE global_position = 42")
def lookup_global(spark, d):
    e = log.events_base(spark, d)
    return e.filter(F.col("event_id") == 41).select(*SHOWN)


@query(f"SELECT stream_position, {_SHOWN} FROM m WHERE stream_name = '{STREAM}' AND stream_position = 1")
def lookup_stream(spark, d):
    e = log.events_log(spark, d)
    mine = log._stream_position(e.df.filter(e.in_stream(STREAM)))
    return mine.filter(F.col("position_enc") == 2).select("stream_position", *SHOWN)


@query("SELECT global_position, stream_position, stream_name, message_type, data, nullif(CASE WHEN event_id % 9 = 1 THEN '' ELSE metadata END, '') AS metadata FROM m")
def project_message(spark, d):
    m = log.events_messages(spark, d)
    return read.as_message(m.withColumn("metadata", F.when(F.col("event_id") % 9 == 1, "").otherwise(F.col("metadata"))))


@query("""SELECT metadata IS NULL AS absent, count(*) AS n, min(length(metadata)) AS shortest FROM m GROUP BY 1""")
def metadata_null(spark, d):
    meta = F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.concat(F.lit("user-"), F.col("user_id")).alias("correlationStreamName"))))
    m = log.events_base(spark, d).withColumn("metadata", meta)
    # to_json writes no blank after the colon
    return m.groupBy(F.col("metadata").isNull().alias("absent")).agg(F.count("*").alias("n"), (F.min(F.length("metadata")) + 1).cast("long").alias("shortest"))


_BROKEN = "SELECT global_position, CASE WHEN event_id % 50 = 0 THEN left(data, 3) ELSE data END AS data FROM m"


def _broken(spark: SparkSession, d: str, keep: bool) -> DataFrame:
    m = log.events_base(spark, d)
    m = m.select("global_position", F.when(F.col("event_id") % 50 == 0, F.substring("data", 1, 3)).otherwise(F.col("data")).alias("data"))
    return read.decoded(m, F.col("data"), "k long", keep).select("global_position", "body.k", "error")


@query(f"SELECT global_position, CASE WHEN json_valid(data) THEN (data ->> 'k')::BIGINT END AS k, NOT json_valid(data) AS error FROM ({_BROKEN})")
def decode_errors_kept(spark, d):
    return _broken(spark, d, True)


@query(f"SELECT global_position, (data ->> 'k')::BIGINT AS k, false AS error FROM ({_BROKEN}) WHERE json_valid(data)")
def decode_errors_dropped(spark, d):
    return _broken(spark, d, False)


# --- positions and keys


@query("SELECT global_position, stream_position * 2 AS sequential, stream_position * 2 + 1 AS relaxed FROM m")
def pos_encode(spark, d):
    p = F.col("stream_position")
    return log.events_messages(spark, d).select("global_position", positions.encode(p).alias("sequential"), positions.encode(p, True).alias("relaxed"))


@query("SELECT event_id AS encoded, event_id % 2 = 1 AS relaxed, event_id // 2 AS position FROM events")
def pos_decode(spark, d):
    e = F.col("event_id")
    return log.table(spark, d, "events").select(e.alias("encoded"), positions.is_relaxed(e).alias("relaxed"), positions.position(e).alias("position"))


@query("SELECT event_id AS encoded, event_id + 2 AS next, event_id // 2 + 1 AS position FROM events")
def pos_next(spark, d):
    e = F.col("event_id")
    return log.table(spark, d, "events").select(e.alias("encoded"), positions.following(e).alias("next"), positions.position(positions.following(e)).alias("position"))


@query("SELECT event_id + 1 AS global_position, lpad(to_base(event_id + 1, 16), 16, '0') AS key, lpad(to_base(event_id + 2, 16), 16, '0') AS next_key FROM events")
def global_key_hex(spark, d):
    g = F.col("global_position")
    return log.events_base(spark, d).select(g, positions.global_key(g).alias("key"), positions.global_key(g + 1).alias("next_key"))


@query("SELECT global_position, hex(stream_name::BLOB) || '7C' || lpad(to_base(stream_position * 2, 16), 16, '0') AS key FROM m")
def stream_key_hex(spark, d):
    return log.events_messages(spark, d).select("global_position", positions.stream_key(F.col("stream_name"), F.col("position_enc")).alias("key"))


@query("SELECT global_position, hex(stream_name::BLOB) || '7C' || lpad(to_base(stream_position * 2 + 2, 16), 16, '0') AS next_key, hex(stream_name::BLOB) || '7C' || 'FFFFFFFFFFFFFFFF' AS max_key FROM m")
def stream_key_range(spark, d):
    """What a scan of a stream seeks: the key after a message's own, and the one that ends the stream."""
    s = F.col("stream_name")
    return log.events_messages(spark, d).select("global_position", positions.next_stream_key(s, F.col("position_enc")).alias("next_key"), positions.max_stream_key(s).alias("max_key"))


@query("SELECT global_position, CASE WHEN event_id % 7 = 0 THEN 'could not parse key' END AS error FROM m")
def key_errors(spark, d):
    e = F.col("event_id")
    sk = positions.stream_key(F.col("stream_name"), F.col("position_enc"))
    parsed = positions.parse_stream_key(F.when(e % 7 == 0, F.substring(sk, -16, 16)).otherwise(sk))
    return log.events_messages(spark, d).select("global_position", positions.key_error(parsed).alias("error"))


@query("SELECT global_position AS g, CASE WHEN event_id % 5 <> 0 THEN global_position END AS parsed_global, CASE WHEN event_id % 7 <> 0 THEN stream_name END AS stream_name, CASE WHEN event_id % 7 <> 0 THEN stream_position * 2 END AS position_enc FROM m")
def parse_keys(spark, d):
    g, e = F.col("global_position"), F.col("event_id")
    m = log.events_messages(spark, d).withColumn("gk", F.when(e % 5 == 0, F.substring(positions.global_key(g), 1, 8)).otherwise(positions.global_key(g)))
    sk = positions.stream_key(F.col("stream_name"), F.col("position_enc"))
    m = m.withColumn("sk", positions.parse_stream_key(F.when(e % 7 == 0, F.substring(sk, -16, 16)).otherwise(sk)))
    return m.select(g.alias("g"), positions.parse_global_key(F.col("gk")).alias("parsed_global"), "sk.stream_name", "sk.position_enc")


# --- clock

_SKEW = "time_us + (user_id % 7) * 600000000"


def _ticks(spark: SparkSession, d: str, skewed: bool = True) -> DataFrame:
    e = log.events_base(spark, d)
    us = F.col("time_us") + (F.col("user_id") % 7) * 600_000_000 if skewed else F.col("time_us")
    return e.select("global_position", "event_id", "time_us", clock.tick(us).alias("tick"))


@query(f"SELECT global_position, {_TICK.format('time_us')}::BIGINT AS tick FROM m")
def hlc_tick(spark, d):
    return _ticks(spark, d, False).select("global_position", "tick")


@query(f"SELECT global_position, ({_TICK.format('time_us')} // 65536 // 20 + 1577836800)::BIGINT AS secs FROM m")
def tick_to_secs(spark, d):
    return _ticks(spark, d, False).select("global_position", clock.seconds(F.col("tick")).alias("secs"))


@query(f"SELECT global_position, ({_TICK.format('time_us')} // 65536)::DOUBLE / 20.0::DOUBLE + 1577836800.0::DOUBLE AS secs FROM m")
def tick_to_secs_f64(spark, d):
    return _ticks(spark, d, False).select("global_position", clock.seconds_exact(F.col("tick")).alias("secs"))


@query(f"SELECT global_position, ({_TICK.format('time_us')} + event_id % 65536)::BIGINT AS tick FROM m")
def tick_with_offset(spark, d):
    return _ticks(spark, d, False).select("global_position", clock.with_offset(F.col("tick"), F.col("event_id") % 65536).alias("tick"))


@query("SELECT global_position, time_us // 1000 AS time_ms FROM m")
def time_ms(spark, d):
    return log.events_base(spark, d).select("global_position", clock.millis(F.col("time_us")).alias("time_ms"))


@query(f"SELECT global_position, max({_TICK.format(_SKEW)}) OVER (ORDER BY global_position)::BIGINT AS last FROM m")
def hlc_observe(spark, d):
    return ordered.running_max(_ticks(spark, d), "global_position", F.col("tick"), "last").select("global_position", "last")


@query(f"""SELECT global_position, (CASE WHEN seen > tick THEN seen + 1 ELSE tick END)::BIGINT AS next FROM
  (SELECT *, max(tick) OVER (ORDER BY global_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT global_position, {_TICK.format(_SKEW)} AS tick FROM m))""")
def hlc_next(spark, d):
    seen = ordered.running_max(_ticks(spark, d), "global_position", F.col("tick"), "seen", current=False)
    return seen.select("global_position", clock.next_after(F.col("seen"), F.col("tick")).alias("next"))


_ORD = f"SELECT global_position, (global_position + max({_TICK.format(_SKEW)} - global_position) OVER (ORDER BY global_position))::BIGINT AS ord FROM m"


def with_ord(ticks: DataFrame) -> DataFrame:
    """Strictly rising order values: max(tick, previous + 1), in closed form over a running maximum."""
    g = F.col("global_position")
    return ordered.running_max(ticks, "global_position", F.col("tick") - g, "ahead").withColumn("ord", g + F.col("ahead"))


@query(_ORD)
def hlc_ord(spark, d):
    return with_ord(_ticks(spark, d)).select("global_position", "ord")


@query(f"SELECT global_position, ord, (ord // 65536)::DOUBLE / 20.0::DOUBLE + 1577836800.0::DOUBLE AS ord_unix, strftime(make_timestamp(((ord // 65536) // 20 + 1577836800) * 1000000), '%Y-%m-%d %H:%M:%S') AS ord_time FROM ({_ORD})")
def ord_time(spark, d):
    o = F.col("ord")
    return with_ord(_ticks(spark, d)).select("global_position", "ord", clock.seconds_exact(o).alias("ord_unix"), clock.utc_time(o).alias("ord_time"))


# --- names

_NAMED = """SELECT global_position, CASE event_id % 6 WHEN 0 THEN stream_name WHEN 1 THEN stream_name || '+v' || user_id || '+x' WHEN 2 THEN event_type WHEN 3 THEN event_type || ':ex-' || user_id
  WHEN 4 THEN stream_name || ':e,f' ELSE '-' || user_id END AS name FROM m"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    k, s, u, t = F.col("event_id") % 6, F.col("stream_name"), F.col("user_id"), F.col("event_type")
    name = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("+v"), u, F.lit("+x"))).when(k == 2, t).when(k == 3, F.concat(t, F.lit(":ex-"), u)).when(k == 4, F.concat(s, F.lit(":e,f"))).otherwise(F.concat(F.lit("-"), u))
    return log.events_base(spark, d).select("global_position", name.alias("name"))


@query(f"""SELECT global_position, CASE WHEN strpos(name, '-') > 0 THEN split_part(name, '-', 1) ELSE '' END AS category, sid AS stream_id, CASE WHEN strpos(sid, '+') > 0 THEN split_part(sid, '+', 1) ELSE '' END AS cardinal_id
  FROM (SELECT *, substr(name, strpos(name, '-') + 1) AS sid FROM ({_NAMED}))""")
def sql_name_parts(spark, d):
    n = F.col("name")
    return _named(spark, d).select("global_position", names.category(n).alias("category"), names.stream_id(n).alias("stream_id"), names.cardinal_id(n).alias("cardinal_id"))


@query(f"""SELECT global_position, regexp_extract(name, '^([^:-]*)', 1) AS component, CASE WHEN regexp_matches(name, '^[^:-]*-') THEN regexp_extract(name, '^[^:-]*-([^:]*)', 1) END AS id,
  CASE WHEN strpos(name, ':') > 0 THEN substr(name, strpos(name, ':') + 1) END AS extra FROM ({_NAMED})""")
def ecs_name_parts(spark, d):
    n = F.col("name")
    return _named(spark, d).select("global_position", names.component(n).alias("component"), names.entity_id(n).alias("id"), names.extra(n).alias("extra"))


@query("""SELECT global_position, CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '-' || id || CASE WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN ':' || user_id ELSE ':' || user_id || ',x' END END AS name FROM m""")
def build_stream_name(spark, d):
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    extras = F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(u)).otherwise(F.array(u, F.lit("x")))
    return log.events_base(spark, d).select("global_position", names.build(F.when(k == 0, "").otherwise(F.col("event_type")), F.col("id"), extras).alias("name"))


@query("SELECT global_position, CASE WHEN metadata IS NOT NULL THEN 'user' END AS category FROM m")
def correlation_category(spark, d):
    return log.events_base(spark, d).select("global_position", F.when(F.col("metadata").isNotNull(), names.correlation_category(F.col("metadata"))).alias("category"))


@query(f"SELECT o_orderkey, {_ID.format('o_orderkey * 1000003')} AS id FROM orders")
def id_encode(spark, d):
    return log.table(spark, d, "orders").select("o_orderkey", names.encode_id(F.col("o_orderkey") * 1000003).alias("id"))


_WIDE = "(o_orderkey::HUGEINT * 84442493013196800 * 65537 + o_custkey)"
_HALF = "lpad(translate(lower(to_base(({})::BIGINT, 32)), '0123456789abcdefghijklmnopqrstuv', '0123456789abcdefghjkmnpqrstvwxyz'), 10, '0')"


@query(f"SELECT o_orderkey, regexp_replace({_HALF.format(_WIDE + ' // 1125899906842624')} || {_HALF.format(_WIDE + ' % 1125899906842624')}, '^(.{{6}})(.{{8}})(.{{6}})$', '\\1-\\2-\\3') AS id FROM orders")
def id_encode_wide(spark, d):
    """Ids of numbers beyond 64 bits."""
    wide = F.col("o_orderkey").cast("decimal(38,0)") * F.lit(84442493013196800).cast("decimal(18,0)")
    wide = wide.cast("decimal(32,0)") * F.lit(65537).cast("decimal(5,0)") + F.col("o_custkey")
    return log.table(spark, d, "orders").select("o_orderkey", names.encode_wide_id(wide).alias("id"))


# --- append

_CMDS = """b AS (SELECT 2 * event_id AS seq, id, stream_name, CASE WHEN stream_position > 0 THEN stream_position - 1 END AS expected, event_id FROM m),
c AS (SELECT * FROM b {where} UNION ALL SELECT seq + 1, id, stream_name, expected, event_id FROM b WHERE event_id % 10 = 0),
r AS (SELECT stream_name, 0::BIGINT AS p, min(seq) AS seq FROM c WHERE expected IS NULL GROUP BY stream_name
  UNION ALL SELECT r.stream_name, r.p + 1, min(c.seq) FROM r JOIN c ON c.stream_name = r.stream_name AND c.seq > r.seq AND c.expected = r.p GROUP BY 1, 2)"""


def _append_sql(select: str, gappy: bool = False) -> str:
    return f"WITH RECURSIVE {_M}, {_CMDS.format(where='WHERE event_id % 97 <> 13' if gappy else '')} {select}"


_ACCEPTED = "SELECT seq, stream_name, p AS stream_position FROM r"
_REJECTED = """SELECT c.seq, c.stream_name, c.expected, (SELECT max(p) FROM r WHERE r.stream_name = c.stream_name AND r.seq < c.seq) AS got, 'wrong stream position' AS reason FROM c WHERE c.seq NOT IN (SELECT seq FROM r)"""


def _commands(spark: SparkSession, d: str, gappy: bool = False) -> DataFrame:
    return written(log.commands(spark, d, gappy), "commands")


@query("")
def append_accepted(spark, d):
    ok = append.judged(_commands(spark, d)).filter("ok")
    return ok.select("seq", "stream_name", F.coalesce(F.col("expected") + 1, F.lit(0)).alias("stream_position"))


@query("")
def append_rejected(spark, d):
    return append.rejects(append.judged(_commands(spark, d)))


@query("")
def append_rejected_cascade(spark, d):
    return append.rejects(append.judged(_commands(spark, d, gappy=True)))


@query("")
def append_receipts(spark, d):
    return append.receipts(append.judged(_commands(spark, d, gappy=True)))


@query("")
def append_long_streams(spark, d):
    """The same receipts with every stream taken as a long one."""
    return append.receipts(append.judged(_commands(spark, d, gappy=True), long=1))


ORACLES["append_accepted"] = _append_sql(_ACCEPTED)
ORACLES["append_rejected"] = _append_sql(_REJECTED)
ORACLES["append_rejected_cascade"] = _append_sql(_REJECTED, True)
ORACLES["append_receipts"] = ORACLES["append_long_streams"] = _append_sql("SELECT seq, stream_name, row_number() OVER (ORDER BY seq) AS global_position, p AS stream_position FROM r", True)


def _put_in_parts(spark: SparkSession, d: str, parts: int, **how) -> LogStore:
    """A new stored log into which the commands were put, so many seq ranges one after another."""
    c = _commands(spark, d, gappy=True)
    target = LogStore(spark, new_path(spark, "log"))
    for part in _arrivals(c, parts):
        target.put(part, **how)
    return target


def _arrivals(c: DataFrame, parts: int) -> list[DataFrame]:
    top = (c.agg(F.max("seq")).first()[0] or 0) + 1
    return [c.filter((F.col("seq") >= top * i // parts) & (F.col("seq") < top * (i + 1) // parts)) for i in range(parts)]


@query("")
def put_twice(spark, d):
    """Two puts into a stored log, read back from the global layout."""
    stored = _put_in_parts(spark, d, 2).log("global").df
    return stored.select("global_position", "stream_name", "stream_position", "position_enc", "message_type", "data", "metadata", "id")


@query("")
def put_stream_layout(spark, d):
    """The same from the stream layout: one stream's rows with a filter that reaches the scan."""
    stored = _put_in_parts(spark, d, 2).log("stream")
    return ReadSpec().in_stream(STREAM).of(stored).select("global_position", "stream_position", "data", "id")


@query("")
def stored_last_position(spark, d):
    """The last position of every stream as the log holds it, which the next put starts from."""
    return _put_in_parts(spark, d, 2).last_positions()


@query("")
def put_reject_reasons(spark, d):
    """Why commands were rejected: of a wrong position, of an unsupported kind, or without JSON."""
    c = log.commands(spark, d, gappy=True)
    e = F.expr("seq div 2")
    c = c.withColumn("kind", F.when(e % 41 == 7, "relaxed").otherwise(F.col("kind"))).withColumn("data", F.when(e % 53 == 9, "{").otherwise(F.col("data")))
    target = LogStore(spark, new_path(spark, "log"))
    target.put(c, only_json=True)
    return target.rejects().groupBy("reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


_PUT = "SELECT seq, row_number() OVER (ORDER BY seq) AS global_position, r.stream_name, r.p AS stream_position, event_type AS message_type, data, metadata, id FROM (SELECT r.*, c.event_id FROM r JOIN c USING (seq)) r JOIN (SELECT event_id, event_type, data, metadata, id FROM m) m USING (event_id)"
ORACLES["put_twice"] = _append_sql(f"SELECT global_position, stream_name, stream_position, 2 * stream_position AS position_enc, message_type, data, metadata, id FROM ({_PUT})", True)
ORACLES["put_stream_layout"] = _append_sql(f"SELECT global_position, stream_position, data, id FROM ({_PUT}) WHERE stream_name = '{STREAM}' ORDER BY global_position LIMIT 1000", True)
ORACLES["stored_last_position"] = _append_sql("SELECT stream_name, 2 * max(p) AS position_enc FROM r GROUP BY 1", True)
ORACLES["put_reject_reasons"] = _append_sql(
    """SELECT reason, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, CASE WHEN event_id % 53 = 9 THEN 'data is not JSON' WHEN event_id % 41 = 7 THEN 'unsupported position kind' ELSE 'wrong stream position' END AS reason
  FROM c WHERE seq NOT IN (SELECT seq FROM r)) GROUP BY 1""", True
).replace("FROM c WHERE expected IS NULL", "FROM c WHERE expected IS NULL AND event_id % 53 <> 9 AND event_id % 41 <> 7").replace("AND c.expected = r.p", "AND c.expected = r.p AND event_id % 53 <> 9 AND event_id % 41 <> 7")


@query("SELECT id, count(*) AS n, min(seq) AS first_seq FROM (SELECT id, 2 * event_id AS seq FROM m UNION ALL SELECT id, 2 * event_id + 1 FROM m WHERE event_id % 10 = 0) GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return append.duplicate_ids(log.commands(spark, d))


@query("SELECT stream_name, min(stream_position) AS first, max(stream_position) AS last, count(*) AS n, max(stream_position) - min(stream_position) + 1 = count(*) AS dense FROM m GROUP BY 1")
def stream_contiguity(spark, d):
    p = F.col("stream_position")
    out = log.events_messages(spark, d).groupBy("stream_name").agg(F.min(p).alias("first"), F.max(p).alias("last"), F.count("*").alias("n"))
    return out.withColumn("dense", F.col("last") - F.col("first") + 1 == F.col("n"))


@query("SELECT unnest(['global', 'stream']) AS layout, (SELECT count(*) FROM events) AS n, 0::BIGINT AS missing")
def layout_parity(spark, d):
    """Both stored layouts hold the same messages: rows of each, and rows that the other lacks."""
    m = log.events_messages(spark, d).withColumn("time_ms", clock.millis(F.col("time_us"))).select(*log.MESSAGES.names)
    at = new_path(spark, "layouts")
    for by in ("global", "stream"):
        log.store(m, f"{at}/{by}", by)
    sides = {by: log.stored(spark, f"{at}/{by}").df.withColumn("layout", F.lit(by)) for by in ("global", "stream")}
    key = ["id", "stream_name", "position_enc", "global_position", "message_type"]
    both = sides["global"].unionByName(sides["stream"]).groupBy(*key).agg(F.sum((F.col("layout") == "global").cast("long")).alias("g"), F.sum((F.col("layout") == "stream").cast("long")).alias("s"))
    n = both.agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.sum(F.greatest(F.col("s") - F.col("g"), F.lit(0))).alias("mg"), F.sum(F.greatest(F.col("g") - F.col("s"), F.lit(0))).alias("ms"))
    return n.select(F.explode(F.array(F.struct(F.lit("global").alias("layout"), F.col("g").alias("n"), F.col("mg").alias("missing")), F.struct(F.lit("stream").alias("layout"), F.col("s").alias("n"), F.col("ms").alias("missing")))).alias("x")).select("x.*")


# --- events and folds

_POSTS = """p AS (SELECT global_position, 'post-' || user_id AS stream_name, CASE event_id % 11 WHEN 3 THEN 'HiddenByModerator' WHEN 5 THEN 'HiddenByPoster' WHEN 7 THEN 'Other' ELSE 'Posted' END AS message_type,
  CASE WHEN event_id % 11 IN (3, 5, 7) THEN '' WHEN event_id % 37 = 0 THEN '{' ELSE '{"poster_id":"user-' || user_id || '","body":"' || event_type || ' ' || event_id || '","status":"' || CASE event_id % 5 WHEN 0 THEN 'Unpublished' WHEN 1 THEN 'HiddenByPoster' ELSE 'Visible' END || '"}' END AS data FROM m),
e AS (SELECT global_position, stream_name, CASE WHEN message_type = 'Posted' AND NOT json_valid(data) OR message_type = 'Other' THEN 'Unknown' ELSE message_type END AS event,
  CASE WHEN message_type = 'Posted' AND json_valid(data) THEN data ->> 'poster_id' END AS poster_id, CASE WHEN message_type = 'Posted' AND json_valid(data) THEN data ->> 'body' END AS body,
  CASE WHEN message_type LIKE 'Hidden%' THEN message_type WHEN message_type = 'Posted' AND json_valid(data) THEN data ->> 'status' END AS status FROM p)"""


#: What a post's status can be; the first one is that of a post without messages.
STATUSES = ("Unpublished", "Visible", "HiddenByPoster", "HiddenByModerator")


def posts(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log of posts: some hidden again, some of an unknown type, some with broken bodies."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    k = e % 11
    kind = F.when(k == 3, "HiddenByModerator").when(k == 5, "HiddenByPoster").when(k == 7, "Other").otherwise("Posted")
    data = F.when(k.isin(3, 5, 7), "").when(e % 37 == 0, "{").otherwise(F.to_json(_post(e, u)))
    return log.events_base(spark, d).select("global_position", F.concat(F.lit("post-"), u).alias("stream_name"), kind.alias("message_type"), data.alias("data"))


def _post(e: Column, u: Column) -> Column:
    status = F.when(e % 5 == 0, "Unpublished").when(e % 5 == 1, "HiddenByPoster").otherwise("Visible")
    return F.struct(F.concat(F.lit("user-"), u).alias("poster_id"), F.concat_ws(" ", "event_type", e.cast("string")).alias("body"), status.alias("status"))


def decoded_posts(p: DataFrame) -> DataFrame:
    """global_position, stream_name, event, poster_id, body, status; only ``Posted`` has a body to decode, which must hold all three."""
    body = F.from_json(F.when(F.col("message_type") == "Posted", F.col("data")), "poster_id string, body string, status string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    p = p.withColumn("b", body)
    whole = F.col("b.poster_id").isNotNull() & F.col("b.body").isNotNull() & F.coalesce(F.col("b.status").isin(*STATUSES), F.lit(False))
    bad = (F.col("message_type") == "Posted") & ~(whole & F.col("b._corrupt_record").isNull())
    event = F.when(bad | ~F.col("message_type").isin("Posted", "HiddenByModerator", "HiddenByPoster"), "Unknown").otherwise(F.col("message_type"))
    posted = event == "Posted"
    status = F.when(posted, F.col("b.status")).when(event != "Unknown", event)
    return p.select("global_position", "stream_name", event.alias("event"), F.when(posted, F.col("b.poster_id")).alias("poster_id"), F.when(posted, F.col("b.body")).alias("body"), status.alias("status"))


def post_fields() -> dict[str, tuple[Column, Column]]:
    posted, known = F.col("event") == "Posted", F.col("event") != "Unknown"
    return {"poster_id": (F.col("poster_id"), posted), "body": (F.col("body"), posted), "status": (F.col("status"), known)}


_STATE = """SELECT stream_name, arg_max(poster_id, global_position) FILTER (event = 'Posted') AS poster_id, arg_max(body, global_position) FILTER (event = 'Posted') AS body,
  arg_max(status, global_position) FILTER (event <> 'Unknown') AS status, count(*) AS n_messages FROM e GROUP BY stream_name"""


@query("")
def decode_event(spark, d):
    return decoded_posts(posts(spark, d))


@query("")
def fold_lww(spark, d):
    return fold.last_writer(decoded_posts(posts(spark, d)), post_fields())


@query("")
def fold_defaults(spark, d):
    """A state for every customer's post stream; those without messages have the default."""
    entities = log.table(spark, d, "customer").select(F.concat(F.lit("post-"), F.col("c_custkey")).alias("stream_name"))
    states = fold.last_writer(decoded_posts(posts(spark, d)), post_fields())
    return fold.with_defaults(entities, states, {"poster_id": F.lit(""), "body": F.lit(""), "status": F.lit("Unpublished"), "n_messages": F.lit(0)})


@query("")
def stream_fold(spark, d):
    p = posts(spark, d)
    at = new_path(spark, "posts")
    p.repartitionByRange("global_position").write.parquet(at)
    live = streaming.files(spark, at, p.schema, 2)
    return streaming.drained(streaming.last_writer(decoded_posts(live), post_fields()), "stream-fold", "complete")


ORACLES["decode_event"] = f"WITH {_M}, {_POSTS} SELECT * FROM e"
ORACLES["fold_lww"] = ORACLES["stream_fold"] = f"WITH {_M}, {_POSTS} {_STATE}"
ORACLES["fold_defaults"] = f"""WITH {_M}, {_POSTS}, s AS ({_STATE}) SELECT 'post-' || c_custkey AS stream_name, coalesce(poster_id, '') AS poster_id, coalesce(body, '') AS body, coalesce(status, 'Unpublished') AS status,
  coalesce(n_messages, 0) AS n_messages FROM customer LEFT JOIN s ON s.stream_name = 'post-' || c_custkey"""


@query("")
def decode_strict(spark, d):
    """Only messages of the type ``posted``; any other has no row, and a broken body would fail the query."""
    p = posts(spark, d)
    p = p.withColumn("message_type", F.when((F.col("message_type") == "Posted") & (F.col("data") != "{"), "posted").otherwise(F.col("message_type")))
    rows = read.decoded_strictly(p, "posted", F.col("data"), "poster_id string, body string, status string")
    return rows.select("global_position", "stream_name", "body.poster_id", "body.body", "body.status")


@query("")
def event_commands(spark, d):
    """Events of posts put into a stored log as commands, each at its entity's version, and folded from what was stored."""
    b = written(log.events_base(spark, d).select("event_id", "event_type", "user_id", F.concat(F.lit("post-"), F.col("user_id")).alias("stream_name"), "global_position"), "post-events")
    e, u, k = F.col("event_id"), F.col("user_id").cast("string"), F.col("event_id") % 11
    numbered = log._stream_position(b)
    kind = F.when(k == 3, "HiddenByModerator").when(k == 5, "HiddenByPoster").when(k == 7, "Other").otherwise("Posted")
    version = F.when(F.col("stream_position") > 0, F.col("stream_position") - 1)
    c = events.to_commands(numbered, F.lit("post"), u, kind, F.when(kind == "Posted", _post(e, u)), version, "event_id")
    target = LogStore(spark, new_path(spark, "log"))
    target.put(written(c, "commands"))
    return fold.last_writer(decoded_posts(target.log("stream").df), post_fields())


ORACLES["decode_strict"] = f"WITH {_M}, {_POSTS} SELECT global_position, stream_name, poster_id, body, status FROM e WHERE event = 'Posted'"
ORACLES["event_commands"] = f"WITH {_M}, {_POSTS} {_STATE}".replace("WHEN event_id % 37 = 0 THEN '{' ", "")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    m = log.events_base(spark, d)
    return m.select("global_position", "stream_name", "message_type", F.from_json("data", "k long")["k"].alias("k"))


@query("""SELECT message_type, count(*) AS n, sum(k)::BIGINT AS total, arg_max(k, global_position) AS last FROM
  (SELECT *, (data ->> 'k')::BIGINT AS k, row_number() OVER (PARTITION BY message_type ORDER BY global_position) AS rn FROM m) WHERE rn <= 1000 GROUP BY 1""")
def fold_first_1000(spark, d):
    k, g = F.col("k"), F.col("global_position")
    return fold.first_n(_bodies(spark, d), "message_type").groupBy("message_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max_by(k, g).alias("last"))


@query("""SELECT stream_name, max(k) AS best, count(*) FILTER (before IS NULL OR k > before) AS records FROM
  (SELECT stream_name, k, max(k) OVER (PARTITION BY stream_name ORDER BY global_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT *, (data ->> 'k')::BIGINT AS k FROM m)) GROUP BY 1""")
def fold_array(spark, d):
    """How often each stream set a new best: a fold that needs the order, over ranges that carry the best before them."""
    k = F.col("k")
    m = ordered.running_max_in(_bodies(spark, d), "stream_name", "global_position", k, "before", current=False)
    new = F.col("before").isNull() | (k > F.col("before"))  # as in the SQL
    return m.groupBy("stream_name").agg(F.max(k).alias("best"), F.count_if(new).alias("records"))


@query("""SELECT message_type, count(*) AS n, sum(k * (rn % 7))::BIGINT AS weighted, arg_max(k, rn) AS last FROM
  (SELECT *, (data ->> 'k')::BIGINT AS k, row_number() OVER (PARTITION BY message_type ORDER BY global_position) AS rn FROM m) GROUP BY 1""")
def fold_long_streams(spark, d):
    """A fold that needs each message's place, over whole streams of thousands of messages."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("weighted"), F.lit(None).cast("long").alias("last"))

    def step(s, x):
        n = s["n"] + 1
        return F.struct(n.alias("n"), (s["weighted"] + x["k"] * F.pmod(n, F.lit(7).cast("long"))).alias("weighted"), x["k"].alias("last"))

    return fold.by_array(_bodies(spark, d), start, step, ["k"], "message_type").select("message_type", "state.*")


@query("")
def fold_python(spark, d):
    """The same fold in Python, as the general form for folds that columns can't say."""

    def best(frames):
        top, n = None, 0
        for pdf in frames:
            for k in pdf["k"]:
                if top is None or k > top:
                    top, n = int(k), n + 1
        return {"best": top, "records": n}

    return fold.by_python(_bodies(spark, d), best, "stream_name string, best long, records long")


ORACLES["fold_python"] = ORACLES["fold_array"]


@query("")
def stream_append(spark, d):
    """Commands that arrive in three parts, put by a streaming query that is started anew after each part."""
    c = _commands(spark, d, gappy=True)
    at, checkpoint = new_path(spark, "arrivals"), new_path(spark, "stream-append-checkpoint")
    target = LogStore(spark, new_path(spark, "log"))
    for part in _arrivals(c, 3):
        part.write.mode("append").parquet(at)
        append_stream(spark.readStream.schema(c.schema).parquet(at), target, checkpoint).awaitTermination()
    return target.receipts()


ORACLES["stream_append"] = ORACLES["append_receipts"]
