"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds its distinct word shingles as 64-bit hashes. The universe has D slots. Permutation
``sigma`` places a shingle's slot; coordinate k of the signature is the least value of permutation ``pi``,
shifted circularly by k, over those places: two permutations give all coordinates. Bands of ``ROWS``
coordinates name buckets. With 26 bands of 5 a pair at similarity 0.85 shares no bucket once in 4 million, and
one at 0.80 (the pipeline's limit) three times in 100,000.

1. Documents with equal sets are one class; its node is (smallest doc_id, set hashes). Its text is that of one
   row, found by id and text key, so a frequent or null id costs no more than others.
2. In each bucket every node meets the bucket's leaders: one member by order, or by one of two hashes.
   These pairs, a few a node, are verified on the full sets and the links joined to components.
3. Buckets that still hold several components after that get an exact search of their members: every node
   outside the bucket's largest component is compared with all others by an inverted index of shingles. The
   bucket's members are cut into blocks of bounded size, and so are the nodes outside; a pair of such blocks is a
   group. Where few nodes are outside, as a rule, a bucket's members are dealt once. No bucket is capped.

Defined cases: null and empty texts, and texts without words, have the empty set and link with nothing; fewer
words than a shingle are one shingle; repeated rows are equal sets; null doc_ids count as largest; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_batches, text_key, word_hashes, written
from .components import components

WORDS, SLOT_BITS, BANDS, ROWS, PERCENT = 5, 22, 26, 5, 85
BLOCK_BYTES, BLOCK_ROWS = 2 << 20, 256
_BIG = (1 << 63) - 1
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    text = (text or b"").lower()
    h = word_hashes(text)
    if len(h) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(text.split()), seed=len(h))] if len(h) else [], np.uint64)
    acc = _mix(h[: len(h) - k + 1])
    for i in range(1, k):
        acc = _mix(acc * np.uint64(3) + h[i : len(h) - k + 1 + i])
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]


@lru_cache(maxsize=1)
def _permutations(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20230)
    sigma, pi = r.permutation(1 << bits).astype(np.int32), r.permutation(1 << bits).astype(np.int32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[-n:], pi]), n)


def signature(shingles: np.ndarray, n: int = BANDS * ROWS, bits: int = SLOT_BITS) -> np.ndarray:
    """All coordinates at once: at place p, row p of the window view holds pi at p - n .. p - 1, one value a shift."""
    sigma, shifted = _permutations(bits, n)
    places = sigma[(shingles >> np.uint64(64 - bits)).astype(np.int64)]
    out = np.full(n, 1 << bits, np.int32)
    for at in range(0, len(places), 2048):
        out = np.minimum(out, shifted[places[at : at + 2048]].min(0))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the text's key), n, f1, f2 (set size and two hashes of the set) and the names of its buckets."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, bands = [], [], [], []
            for text in batch.column(3).cast(pa.binary()).to_pylist():
                s = shingles(text)
                n.append(len(s))
                f1.append(s.sum(dtype=np.uint64))
                f2.append(_mix(s).sum(dtype=np.uint64))
                if len(s):
                    b = signature(s).astype(np.uint64).reshape(BANDS, ROWS)
                    acc = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
                    for i in range(ROWS):
                        acc = _mix(acc * np.uint64(3) + b[:, i])
                    bands.append(acc.view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = pa.array(np.cumsum([0, *map(len, bands)]), pa.int32())
            values = pa.array(np.concatenate(bands)) if bands else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), longs(f1), longs(f2), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "k1", "k2", "n", "f1", "f2", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), "text")
    return own.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, f1 long, f2 long, bands array<long>")


def _own_rows(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the rows that have a node's smallest doc_id and that very row's text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_BIG)).alias("d"), *text_key(F.col("text")), "text")
    return own.join(nodes.select("node", F.col("node.d").alias("d"), "k1", "k2"), ["d", "k1", "k2"]).select("node", "text")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the nodes (with k1, k2, the key of their smallest row's text)."""
    return _own_rows(docs, nodes).dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. Rows come sorted by v, whose set is kept between rows."""
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for v, a, b in zip(batch.column("v").to_pylist(), batch.column("a").cast(pa.binary()).to_pylist(), batch.column("b").cast(pa.binary()).to_pylist(), strict=True):
                if v != last:
                    last, other = v, shingles(b)
                mine = shingles(a)
                same = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * same >= percent * (len(mine) + len(other) - same))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, pairs.select("u", "v").schema)


def _cross_links(percent: int):
    """Nodes outside the largest component (``asks``) against a block of the bucket: links between different components, at least one for each two that are linked."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        comp = pd.factorize(pdf["comp"].map(repr))[0]
        sets = [shingles((t or "").encode()) for t in pdf["text"]]
        rows = np.flatnonzero(~asks)
        out = []
        if len(rows) and asks.any():
            n = np.array([len(sets[r]) for r in rows])
            who, values = np.repeat(np.arange(len(rows)), n), np.concatenate([sets[r] for r in rows])
            order = np.argsort(values, kind="stable")
            values, who, own = values[order], who[order], comp[rows]
            for x in np.flatnonzero(asks):
                lo, hi = np.searchsorted(values, sets[x]), np.searchsorted(values, sets[x], side="right")
                ends = np.cumsum(hi - lo)
                near = who[np.arange(ends[-1]) + np.repeat(lo - (ends - (hi - lo)), hi - lo)]
                same = np.bincount(near, minlength=len(rows))
                hit = np.flatnonzero((100 * same >= percent * (n + len(sets[x]) - same)) & (own != comp[x]))
                out += [(x, rows[y]) for y in hit[np.unique(own[hit], return_index=True)[1]]]
        x, y = (list(c) for c in zip(*out, strict=True)) if out else ([], [])
        cols = {}
        for side, at in (("u", x), ("v", y)):
            for c in ("d", "f1", "f2"):
                cols[f"{side}_{c}"] = pdf[c].to_numpy()[at].astype(np.int64) if at else np.zeros(0, np.int64)
        return pd.DataFrame(cols)

    return run


def _asked(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Open buckets' members (band, node, comp) -> band, i, j, node, comp, asks: each member in its block i, each node outside the largest component in its block j, so that all pairs of these meet."""
    sized = written(left.join(texts.select("node", F.octet_length("text").alias("bytes")), "node"), "minhash-sized")
    per = sized.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("n", "bytes", "comp")).alias("top")
    cut = per.groupBy("band").agg(largest, F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")
    n, size = F.col("n"), F.col("bytes")
    cut = cut.select("band", F.col("top.comp").alias("top"), blocks(n, size).alias("members"), blocks(n - F.col("top.n"), size - F.col("top.bytes")).alias("outside"))
    each = sized.join(written(cut, "minhash-blocks"), "band")
    place = lambda seed, m: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    members = each.select("band", place("member", "members").alias("i"), every("outside").alias("j"), "node", "comp", F.lit(False).alias("asks"))
    outside = each.filter(F.col("comp") != F.col("top"))
    return members.union(outside.select("band", every("members").alias("i"), place("outside", "outside").alias("j"), "node", "comp", F.lit(True).alias("asks")))


def _as_node(side: str):
    return F.struct(*(F.col(f"{side}_{c}").alias(c) for c in ("d", "f1", "f2")))


def duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``; also its text's key and its component's node."""
    feats = written(features(docs), "minhash-features")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(_BIG)).alias("d"), "k1", "k2")).alias("least")
    classes = feats.filter("n > 0").groupBy("n", "f1", "f2").agg(least, F.min("bands").alias("bands"))
    nodes = written(classes.select(F.struct("least.d", "f1", "f2").alias("node"), "least.k1", "least.k2", "n", "bands"), "minhash-nodes")

    # Bucket rows name nodes by one hash, to stay narrow; should two nodes share it, both are verified.
    rows = nodes.select(F.explode("bands").alias("band"), F.col("node.f1").alias("f1"), "n")
    kinds = F.array(*(F.struct(F.xxhash64(F.lit(s), "f1").alias("rank"), F.col("f1").alias("lead"), F.col("n").alias("ln")) for s in range(3)))
    chosen = F.element_at(kinds, (F.pmod("band", F.lit(3)) + 1).cast("int"))
    lead = rows.select("band", chosen.alias("l")).groupBy("band").agg(F.min("l").alias("l"), F.count("*").alias("m")).filter("m > 1")
    # Aggregates are written before they are joined by their own key: only between plain shuffles can Spark split a hot key's part.
    lead = written(lead.select("band", "l.lead", "l.ln", "m"), "minhash-leaders")
    met = written(rows.join(lead, "band"), "minhash-met")
    close = 100 * F.least("n", "ln") >= percent * F.greatest("n", "ln")
    named = nodes.select("node", F.col("node.f1").alias("f1"))
    pairs = met.filter((F.col("f1") != F.col("lead")) & close).select("f1", "lead").distinct()
    pairs = pairs.join(named, "f1").withColumnRenamed("node", "a").drop("f1")
    pairs = pairs.join(named.select(F.col("f1").alias("lead"), F.col("node").alias("b")), "lead")
    pairs = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "minhash-pairs")
    keyed = nodes.select("node", F.col("node.f1").alias("f1"), "k1", "k2")
    texts = written(_texts(docs, keyed.join(met.select("f1").distinct(), "f1", "left_semi")), "minhash-texts")
    links = written(_verified(pairs, texts, percent), "minhash-links")
    comps = written(components(links), "minhash-components")

    # Buckets of three or more nodes that aren't one component yet (of two nodes, the pair has been tested).
    own = nodes.select("node", F.col("node.f1").alias("f1")).join(comps, "node", "left")
    own = own.select("node", "f1", F.coalesce("component", "node").alias("comp"))
    in_bucket = met.filter("m > 2").select("band", "f1").join(own, "f1").select("band", "node", "comp")
    open_ = in_bucket.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("z")).filter(F.col("a") != F.col("z"))
    open_ = written(open_.select("band"), "minhash-open-buckets")
    left = written(in_bucket.join(open_, "band"), "minhash-open")
    if not left.isEmpty():
        full = _asked(left, texts).join(texts, "node").select("band", "i", "j", "node.d", "node.f1", "node.f2", F.concat_ws(":", "comp.d", "comp.f1", "comp.f2").alias("comp"), "asks", "text")
        more = full.groupBy("band", "i", "j").applyInPandas(_cross_links(percent), "u_d long, u_f1 long, u_f2 long, v_d long, v_f1 long, v_f2 long")
        more = written(more.select(_as_node("u").alias("u"), _as_node("v").alias("v")), "minhash-more")
        if not more.isEmpty():
            known = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
            comps = written(components(known.union(more)), "minhash-components")

    by_class = nodes.join(comps, "node", "left").select("n", "node.f1", "node.f2", F.coalesce("component", "node").alias("component"))
    out = feats.select("doc_id", "k1", "k2", "n", "f1", "f2").join(by_class, ["n", "f1", "f2"], "left")
    comp = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("component.d") != _BIG, F.col("component.d")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), "k1", "k2", "component")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component one row with its smallest id; all rows without words."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_BIG))
    found = duplicates(docs, percent).filter("kept and n_shingles > 0")
    keep = found.groupBy("component").agg(F.min(F.struct(key.alias("key"), "k1", "k2")).alias("t")).select("t.*", F.lit(True).alias("stays"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("words")
    joined = docs.select(key.alias("key"), *text_key(F.col("text")), row, words).join(written(keep, "minhash-keep"), ["key", "k1", "k2"], "left")
    once = Window.partitionBy("key", "k1", "k2").orderBy(F.xxhash64("row"))
    ranked = joined.filter("stays or not words").withColumn("place", F.row_number().over(once))
    return ranked.filter("place = 1 or not words").select("row.*")
