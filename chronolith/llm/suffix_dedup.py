"""Removal of everything that lies in a string of a given length which also starts anywhere else in the corpus.

A text is a string of bytes (``BYTES``: 400 of them) or of words (``WORDS``: 51, whatever white space is between).

1. Anchors. Every window of ``length`` symbols owns one anchor, the leftmost least gram hash inside it, so equal
   windows have equal anchors at equal places. Consecutive windows with one anchor are one context: the symbols
   from the first window's start to the last one's end. Only anchors whose gram occurs twice or more go on.
   Equal texts go on as one with a count, and what a text holds several times as one row with its starts.
2. Contexts with the same gram meet in one group, equal ones as one row with a count. A group that has more
   than ``GROUP`` different contexts is split by the part that all windows of either half of it must contain,
   as often as needed (in the end a context is a single window), so no group outgrows a task.
   Only different contexts are split; where they occur is not looked at before step 4.
3. The contexts of a task's groups, each that occurs more than once as two strings, are aligned by their anchors.
   Linear grouping (``ordered_columns``) orders all suffixes of these strings; a window is repeated where its suffix
   shares ``length`` symbols or more with a neighbour in that order.
4. The covered ranges go back from parts to the contexts that were split, step by step, then to the texts that hold
   these and to all documents with such a text.

Windows that are equal have one anchor and so stand at the same columns of one group. The result is exact up to
equal hashes: of 128 bits for contexts, of 64 bits for words.

Defined cases: null texts are empty; shorter texts lose nothing; a repeated row is a copy like any other, so both
lose what they share; an empty table gives an empty result; other columns are ignored by ``spans`` and kept by
``cleaned``. In ``cleaned`` a character that a cut splits goes with the removed bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, text_key, word_hashes, word_places, written
from .suffix_groups import ordered_columns


@dataclass(frozen=True)
class Unit:
    """The symbols of a text, the length of a repeat, the grams for anchors, and bytes a symbol."""

    name: str
    length: int
    gram: int
    width: int


BYTES, WORDS = Unit("bytes", 400, 64, 1), Unit("words", 51, 16, 8)
#: Different contexts a group, contexts that are ordered together, contexts that a task remembers.
GROUP, TOGETHER, KNOWN = 512, 4096, 100_000
_TABLE = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def symbols(raw: bytes, unit: Unit) -> bytes:
    """A text as a string of the unit, ``width`` bytes a symbol."""
    return raw if unit.width == 1 else word_hashes(raw).tobytes()


def _grams(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` values, put together from runs of powers of two."""
    n, out, at, span = len(h) - length + 1, None, 0, 1
    while True:
        if length & span:
            part = h[at : at + n]
            out = part if out is None else _mix(out * np.uint64(3) + part)
            at += span
        if span * 2 > length:
            return out
        h = _mix(h[:-span] * np.uint64(3) + h[span:])
        span *= 2


def anchors(string: bytes, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per context: gram hash, first window's start, number of windows, anchor's place after that start."""
    if len(string) < unit.length * unit.width:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(_TABLE[np.frombuffer(string, np.uint8)] if unit.width == 1 else np.frombuffer(string, np.uint64), unit.gram)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, span = unit.length - unit.gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    starts = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    at = (low[starts] & _LOW).astype(np.int64)
    return h[at].view(np.int64), starts, np.diff(np.append(starts, len(low))), at - starts


def _ident(*parts: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(b"\0".join(parts)))


def repeated_ranges(contexts: list[tuple[bytes, int, int]], unit: Unit = BYTES) -> list[list[tuple[int, int]]]:
    """For contexts (symbols, anchor's place, count) of whole groups: ranges covered by strings that occur twice or more."""
    row = np.repeat(np.arange(len(contexts)), [min(n, 2) for _, _, n in contexts])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    if len(row) < 2:
        return out
    first = min(-o for _, o, _ in contexts)
    low = np.array([-o - first for _, o, _ in contexts])
    high = low + np.array([len(c) // unit.width for c, _, _ in contexts])
    if unit.width == 1:
        values = [np.frombuffer(c, np.uint8) for c, _, _ in contexts]
        kind: type = np.uint8
    else:  # words are numbered as they come
        ids, names = pd.factorize(np.frombuffer(b"".join(c for c, _, _ in contexts), np.uint64))
        values = np.split(ids, np.cumsum(high - low)[:-1])
        kind = np.uint16 if len(names) < 1 << 16 else np.uint32
    grid = np.zeros((len(row), int(high.max())), kind)
    for k, i in enumerate(row.tolist()):
        grid[k, low[i] : high[i]] = values[i]
    hit = np.zeros(grid.shape, bool)
    for column, order, same in ordered_columns(grid, low[row], high[row]):
        far = np.flatnonzero(same >= unit.length)
        hit[order[far], column] = hit[order[far - 1], column] = True
    for k in np.flatnonzero(hit.any(1)).tolist():
        i = int(row[k])
        edges = np.flatnonzero(np.diff(hit[k].astype(np.int8), prepend=0, append=0)) - low[i]
        out[i] = merged([(int(a), int(b) - 1 + unit.length) for a, b in zip(edges[::2], edges[1::2], strict=True)])
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _lists(rows: list, kind: pa.DataType = pa.int64()) -> pa.ListArray:  # noqa: B008
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat, kind))


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """k1, k2 (the same for equal texts), the columns and the text of every row."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*text_key(F.col("text")), *more, body.alias("text"))


def _found_grams(unit: Unit):
    """(k1, k2, text) -> the anchors' grams of a text, each once, or twice if it has more anchors with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                g, n = np.unique(anchors(symbols(raw, unit), unit)[0], return_counts=True)
                rows.append(np.concatenate([g, g[n > 1]]))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), _lists(rows)], ["k1", "k2", "g"])

    return run


def _contexts(unit: Unit):
    """(k1, k2, text, copies, grams) -> a row per different context of a text that may be repeated, with its starts and how often it
    occurs in all copies. A task gives a context's symbols once, as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        w = unit.width
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for k1, k2, copies, raw, grams in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "copies")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("grams"), strict=True):
                text = symbols(raw, unit)
                found = anchors(text, unit)
                some = np.isin(found[0], grams.values.to_numpy())
                places: dict[tuple[int, int], tuple[int, int, bytes, list[int]]] = {}
                for g, start, n, off in zip(*(f[some].tolist() for f in found), strict=True):
                    ctx = text[w * start : w * (start + n + unit.length - 1)]
                    places.setdefault(_ident(struct.pack("<qq", g, off), ctx), (g, off, ctx, []))[3].append(start)
                for c, (g, off, ctx, starts) in places.items():
                    for col, v in zip(cols, (k1, k2, *c, g, off, len(starts) * copies, np.array(starts, np.int64), None if c in seen else ctx), strict=True):
                        col.append(v)
                    seen.add(c)
                if len(seen) > KNOWN:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), _lists(cols[7]), pa.array(cols[8], pa.binary())], ["k1", "k2", "c1", "c2", "g", "off", "n", "start", "ctx"])

    return run


def _split(step: int, unit: Unit):
    """Contexts of large groups -> their windows by bins of ``step`` anchor places, grouped by the symbols a bin shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["c1", "c2", "delta", "g", "off", "count", "d1", "d2", "ctx"]
        length, w = unit.length, unit.width
        for batch in batches:
            rows = []
            for g, c1, c2, off, count, ctx in zip(*(batch.column(c).to_pylist() for c in ("g", "c1", "c2", "off", "count", "ctx")), strict=True):
                low = off - (len(ctx) // w - length)  # the windows have the anchor low .. off symbols after their starts
                for k in range(low // step, off // step + 1):
                    least, most = k * step, min(k * step + step - 1, length - unit.gram)
                    core = ctx[w * (off - least) : w * (off - most + length)]
                    group = _ident(struct.pack("<qqq", g, k, step), core)[0]
                    hi, lo = min(off, most), max(low, least)
                    part = ctx[w * (off - hi) : w * (off - lo + length)]
                    rows.append((c1, c2, off - hi, group, hi, count, *_ident(struct.pack("<qq", group, hi), part), part))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)

    return run


def _solved(unit: Unit):
    """Contexts sorted by group -> their repeated ranges. Whole groups are ordered together, up to about ``TOGETHER`` contexts."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = repeated_ranges([h[2:] for h in held], unit) if held else []
        hit = [(h, r) for h, r in zip(held, found, strict=True) if r]
        if hit:
            ids = [pa.array([h[i] for h, _ in hit], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, *(_lists([np.array([x[i] for x in r]) for _, r in hit]) for i in (0, 1))], ["c1", "c2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        own: list[tuple] = []  # the group at hand: c1, c2, symbols, anchor's place, count
        last = None
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "c1", "c2", "ctx", "off", "count")), strict=True):
                if g != last:
                    if len(own) > 1 or own and own[0][4] > 1:
                        held += own
                    own, last = [], g
                    if len(held) >= TOGETHER:
                        yield from solve(held)
                        held = []
                own.append(tuple(row))
        yield from solve(held + (own if len(own) > 1 or own and own[0][4] > 1 else []))

    return run


def _ranges(docs: DataFrame, unit: Unit) -> DataFrame:
    """k1, k2, ranges: covered ranges (a, b) of symbols of every different text that has some."""
    small_batches(docs.sparkSession)
    early, scratch = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    label = lambda x: f"suffix-{unit.name}-{x}"
    found = _keyed(docs).mapInArrow(_found_grams(unit), "k1 long, k2 long, g array<long>")
    found = early.written(found.filter(F.size("g") > 0), label("anchors"))
    each = found.select("k1", "k2", F.explode("g").alias("g"))
    # written, so that the join's sides are plain shuffles, of which Spark can split a frequent gram's part
    twice = early.written(each.groupBy("g").count().filter("count > 1").select("g"), label("grams"))
    some = each.join(twice, "g", "left_semi").groupBy("k1", "k2").agg(F.collect_set("g").alias("grams"))
    texts = _keyed(docs).groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    body = texts.join(some, ["k1", "k2"]).select("k1", "k2", "copies", "text", "grams")
    ctx = early.written(body.mapInArrow(_contexts(unit), "k1 long, k2 long, c1 long, c2 long, g long, off long, n long, start array<long>, ctx binary"), label("contexts"))

    places_ = scratch.written(ctx.select("k1", "k2", "start", "c1", "c2"), label("places"))
    left = scratch.written(ctx.groupBy("g", "off", "c1", "c2").agg(F.sum("n").alias("count"), F.first("ctx", ignorenulls=True).alias("ctx")), label("groups"))
    early.done()
    ready, splits, step = None, [], 1 << ((unit.length - unit.gram).bit_length() - 1)
    while True:
        large = left.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > GROUP).select("g")
        large = scratch.written(large, label("large"))
        rest = left.join(large, "g", "left_anti")
        ready = rest if ready is None else ready.unionByName(rest)
        if not step or large.isEmpty():
            break
        split = left.join(large, "g").mapInArrow(_split(step, unit), "c1 long, c2 long, delta long, g long, off long, count long, d1 long, d2 long, ctx binary")
        split = scratch.written(split, label("split"))
        splits.append(split.select("c1", "c2", "delta", "d1", "d2"))
        left = split.groupBy("g", "off", F.col("d1").alias("c1"), F.col("d2").alias("c2")).agg(F.sum("count").alias("count"), F.first("ctx").alias("ctx"))
        left = scratch.written(left.select("g", "off", "c1", "c2", "count", "ctx"), label("groups"))
        step //= 2
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartition(n, "g").sortWithinPartitions("g").select("g", "c1", "c2", "off", "count", "ctx")
    solved = dealt.mapInArrow(_solved(unit), "c1 long, c2 long, lo array<long>, hi array<long>")
    # a context is shorter than two repeats, so those in it overlap and cover a single range
    solved = scratch.written(solved, label("solved")).select("c1", "c2", F.array_min("lo").alias("lo"), F.array_max("hi").alias("hi"))
    covered = solved
    for split in reversed(splits):
        parts = covered.select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "lo", "hi")
        whole = split.join(parts, ["d1", "d2"]).groupBy("c1", "c2").agg(F.min(F.col("delta") + F.col("lo")).alias("lo"), F.max(F.col("delta") + F.col("hi")).alias("hi"))
        covered = solved.unionByName(scratch.written(whole, label("whole")))
    own = F.transform("start", lambda s: F.struct((s + F.col("lo")).alias("a"), (s + F.col("hi")).alias("b")))
    spots = places_.join(covered, ["c1", "c2"]).select("k1", "k2", own.alias("r"))
    out = written(spots.groupBy("k1", "k2").agg(F.flatten(F.collect_list("r")).alias("ranges")), label("ranges"))
    scratch.done()
    return out


def _all_ranges(docs: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """k1, k2, parts: the ranges of each unit (its number, ranges) that a text has."""
    found = None
    for i, unit in reversed(list(enumerate(units))):
        own = _ranges(docs, unit).select("k1", "k2", F.array(F.struct(F.lit(i).alias("part"), "ranges")).alias("parts"))
        found = own if found is None else found.unionByName(own)
    if len(units) == 1:
        return found
    # written, as many documents may have one text
    return written(found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("parts")).alias("parts")), "suffix-parts")


def _with_parts(docs: DataFrame, units: tuple[Unit, ...], *columns: Column) -> DataFrame:
    """The columns, text and parts of every row."""
    none = F.array().cast("array<struct<part:int,ranges:array<struct<a:bigint,b:bigint>>>>")
    rows = _keyed(docs, *columns).join(_all_ranges(docs, units), ["k1", "k2"], "left")
    return rows.drop("k1", "k2").withColumn("parts", F.coalesce("parts", none))


def _kept(text: bytes, runs: list[tuple[int, int]], mark: Callable[[int], bytes] = lambda i: b"") -> tuple[bytes, int]:
    """What is left of a text, with ``mark(i)`` for the i-th removed run, and the number of these runs."""
    runs, out, at = merged(runs), [], 0
    for i, (a, b) in enumerate(runs):
        out += [text[at:a], mark(i)]
        at = b
    return b"".join([*out, text[at:]]), len(runs)


def spans(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``, by bytes."""
    return _spans(docs, unit).drop("left")


def _spans(docs: DataFrame, unit: Unit) -> DataFrame:
    """The same and ``left``: what is left of the text, with a word of its own at every cut."""
    body = _with_parts(docs, (unit,), F.col("doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = _in_bytes(text, parts[0]["ranges"], unit) if parts else []
                kept, n = _kept(text, runs)
                sha = hashlib.sha256(kept).hexdigest()
                own = xxhash.xxh3_64_hexdigest(text).encode()
                rows.append((len(text), len(text) - len(kept), n, sha, _kept(text, runs, lambda i, own=own: b" %s.%d " % (own, i))[0].decode("utf-8", "ignore")))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "left"])

    return body.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, left string")


def spans_and_passages(docs: DataFrame, unit: Unit = BYTES, passages: Unit = WORDS) -> DataFrame:
    """``spans``, and of the text that these leave n_passages and n_passage_words: the maximal runs of repeats of the other unit, which are only reported."""
    found = written(_spans(docs, unit), "suffix-spans")
    more = _ranges(found.select("doc_id", F.col("left").alias("text")), passages)
    keyed = found.withColumns({c: k for c, k in zip(("k1", "k2"), text_key(F.col("left")), strict=True)}).drop("left")
    out = keyed.join(more, ["k1", "k2"], "left")
    # sorted ranges, of which those that touch are one passage
    sorted_ = F.sort_array(F.coalesce("ranges", F.array().cast("array<struct<a:bigint,b:bigint>>")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("words"), F.lit(-1).cast("bigint").alias("end"))

    def step(s: Column, r: Column) -> Column:
        apart = r["a"] > s["end"]
        return F.struct((s["n"] + apart.cast("bigint")).alias("n"), (s["words"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("words"), F.greatest(s["end"], r["b"]).alias("end"))

    runs = F.aggregate(sorted_, start, step)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", runs["n"].alias("n_passages"), runs["words"].alias("n_passage_words"))


def _in_bytes(text: bytes, ranges: list[dict], unit: Unit) -> list[tuple[int, int]]:
    if not ranges or unit.width == 1:
        return [(r["a"], r["b"]) for r in ranges]
    first, end = word_places(text)
    return [(int(first[r["a"]]), int(end[r["b"] - 1])) for r in ranges]


def cleaned(docs: DataFrame, units: tuple[Unit, ...] = (BYTES, WORDS)) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts, and ``n_chars`` counted anew where it is a column.

    Removed is what lies in a repeat of any of the units. A passage of 51 words may have fewer bytes than 400, or be
    set with other white space; one of 400 bytes may have fewer words.
    """
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in names)).alias("row")
    body = _with_parts(docs, units, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = []
            for text, parts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                runs = [x for p in parts for x in _in_bytes(text, p["ranges"], units[p["part"]])]
                left.append(_kept(text, runs)[0].decode("utf-8", "ignore") if runs else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["row", "left"])

    out = body.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("left", T.StringType())]))
    text = F.coalesce("left", "row.text")
    new: Callable[[str], Column] = lambda c: text if c == "text" else F.char_length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"row.`{c}`")
    return out.select(*(new(c).alias(c) for c in names))
