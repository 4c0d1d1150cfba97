"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Every document has a 36-bit hash of its id and size. For each source the mix takes whole copies of all its
documents and, for what is left of the target, those documents whose hash lies below a threshold. The
threshold comes from histograms: tokens summed by source and the hash's first 12 bits, then, inside the one
bucket that the budget ends in, by the next 12 and the last 12 bits. No documents are sorted. A larger budget
gives a higher threshold of the same hash, so the mixes of several budgets are nested.

Defined cases: null texts have size 0; the null source is a source of its own, last in the order; documents
with equal id and size share a hash and are taken together; an empty table, or one without words, gives
targets of 0. Targets depend on the table alone and the hash on no partitioning, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (3, 1, 2)
#: Share of all tokens that the mix takes, and the most copies of one document.
SHARE, MOST = 1.5, 2
BITS, LEVELS = 12, 3
#: A per-source table is broadcast up to this many sources (about 1 MB), joined by shuffle beyond it.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: str) -> Column:
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size and hash ``h`` of every document."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("h", _hash(seed))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: the share of all tokens divided by weight, no source above its cap.

    Sources are few next to documents, so one window over their table orders them: first by name for the
    weights, then by cap over weight, in which order the capped ones come first and the level of the rest
    follows from running sums.
    """
    src = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (rank + 1).cast("int")).cast("double"))
    src = src.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest)
    src = src.withColumn("capped", F.col("cap") <= level * F.col("w"))
    open_ = F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_)
    left = F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_), F.lit(0.0))
    return src.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(left / open_ * F.col("w")).alias("target"))


def _joined(left: DataFrame, right: DataFrame, small: bool, *more: str, how: str = "inner") -> DataFrame:
    """Join by source (null-safe) and further keys; the right side's keys are dropped."""
    right = right.withColumnsRenamed({c: f"{c}_key" for c in ("source", *more)})
    on = F.col("source").eqNullSafe(F.col("source_key"))
    for c in more:
        on = on & (F.col(c) == F.col(f"{c}_key"))
    return left.join(F.broadcast(right) if small else right, on, how).drop(*(f"{c}_key" for c in ("source", *more)))


def thresholds(sizes: DataFrame, goal: DataFrame, small: bool) -> DataFrame:
    """source, source_size, target, copies, threshold: documents with ``h < threshold`` get one more copy."""
    exact = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("copies", exact.cast("long"))
    goal = goal.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    at, inside = goal.select("source", "left", F.lit(0).cast("long").alias("prefix")), sizes.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        down = _joined(inside, at, small, "prefix").drop("left") if level > 1 else inside
        inside = down.withColumn("prefix", F.shiftright("h", shift))
        bins = inside.groupBy("source", "prefix").agg(F.sum("size").alias("u"))
        order = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("cum", F.sum("u").over(order))
        ends = _joined(bins, at.select("source", "left"), small)
        ends = ends.filter((F.col("cum") > F.col("left")) & (F.col("cum") - F.col("u") <= F.col("left")))
        at = written(ends.select("source", "prefix", (F.col("left") - (F.col("cum") - F.col("u"))).alias("left"), "u"), "mix-level")
    cut = at.select("source", (F.col("prefix") + F.when(2 * F.col("left") >= F.col("u"), 1).otherwise(0)).alias("threshold"))
    return _joined(goal, cut, small, how="left").select("source", "source_size", "target", "copies", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, h, source_size, target, n_copies, taken of every document."""
    sizes = written(sized(docs, seed), "mix-sizes")
    goal = written(targets(sizes, weights, share, most), "mix-targets")
    small = goal.count() <= BROADCAST_SOURCES
    cuts = written(thresholds(sizes, goal, small), "mix-cuts")
    out = _joined(sizes, cuts, small).withColumn("n_copies", F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    return out.withColumn("taken", F.col("n_copies") * F.col("size")).drop("copies", "threshold")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, each as often as the mix takes it.

    The cuts of the sources are applied to the documents themselves, so texts are not shuffled.
    """
    names = docs.columns
    seed = how.get("seed", "mix")
    sizes = written(sized(docs, seed), "mix-sizes")
    goal = written(targets(sizes, **{k: v for k, v in how.items() if k != "seed"}), "mix-targets")
    small = goal.count() <= BROADCAST_SOURCES
    cuts = written(thresholds(sizes, goal, small), "mix-cuts")
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    keyed = docs.select(row, "doc_id", "source", n_words(F.col("text")).alias("size")).withColumn("h", _hash(seed))
    out = _joined(keyed, cuts, small).withColumn("n", F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).select("row.*")
