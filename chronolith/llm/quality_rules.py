"""Quality rules as a bitmask ledger.

``ledger`` measures every document once and stores the measurements together with one bit per failed rule.
A policy is a named, versioned set of rules; ``apply_policy`` turns ledger rows into verdicts without another
look at the text, and ``ablate`` counts by bitwise aggregation what each rule of a policy changes.

Defined cases: a null text counts as empty and fails the rules that need words; repeated rows are judged
one by one; an empty table gives an empty ledger; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")
WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[list(range(ord("A"), ord("Z") + 1))] = True


#: Rule name -> whether measurements fail it; they may be columns or numbers. A rule's bit is its place here.
RULES: dict[str, Callable[[dict], Column | bool]] = {
    "few_words": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: 10 * m["n_dup_lines"] > 6 * m["n_lines"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 25 * m["n_words"],
    "capitals": lambda m: 10 * m["n_upper"] > 6 * m["word_chars"],
}


def rules() -> dict[str, Column]:
    """Rule name -> column that is true where a document fails it."""
    columns = {m: F.col(m) for m in MEASURES}
    return {name: failed(columns) for name, failed in RULES.items()}


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base_v1": ("few_words", "repeated_windows"),
    "web_v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "web_v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals"),
}
CURRENT = "web_v2"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in ``window``-word windows that occur twice or more; ``ids`` numbers the words.

    Pairs, then fours, then eights are renumbered by rank, so equal numbers mean equal word sequences.
    """
    n = len(ids)
    if n <= window:
        return 0
    ranks, span = ids, 1
    while span < window:
        keys = ranks[:-span] * (int(ranks.max()) + 1) + ranks[span:]
        _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span *= 2
    starts = np.flatnonzero(counts[ranks] > 1)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def measure(raw: bytes) -> tuple[int, ...]:
    words = raw.split()  # bytes split at exactly the six ASCII white-space characters
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    b = np.frombuffer(raw, np.uint8)
    chars = int(((b & 0xC0) != 0x80).sum() - _SPACE[b].sum())
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, int(_SYMBOL[b].sum()), len(lines), len(lines) - len(set(lines)), repeated_words(ids), int(_UPPER[b].sum())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' last column, a text, gives way to its measurements."""
    for batch in batches:
        rows = [measure(x or b"") for x in batch.columns[-1].cast(pa.binary()).to_pylist()]
        cols = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, cols)], [*batch.schema.names[:-1], *MEASURES])


def ledger(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """doc_id, every measurement, and ``fail_bits`` with bit i set where rule i fails.

    ``whole_rows`` also carries each document's columns along, as the struct ``row``.
    """
    small_batches(docs.sparkSession)
    kept = docs.select("doc_id", *([F.struct(*(F.col(f"`{c}`").alias(c) for c in docs.columns)).alias("row")] if whole_rows else []), "text")
    schema = T.StructType([*kept.schema.fields[:-1], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    bits = (F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, failed in enumerate(rules().values()))
    return kept.mapInArrow(_measured, schema).withColumn("fail_bits", reduce(Column.bitwiseOR, bits))


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Ledger plus ``base_failed`` and the policy's verdict ``kept``."""
    fails = lambda p: F.col("fail_bits").bitwiseAND(F.lit(mask(p))) != 0
    return led.withColumn("base_failed", fails("base_v1")).withColumn("kept", ~(fails("base_v1") | fails(policy)))


def ablate(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents failing it, and those kept if only this rule were dropped.

    One aggregation by the distinct failure masks (at most 2^rules of them) answers every ablation.
    """
    by_mask = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    each = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]))
    return (
        by_mask.select("bits", "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_saved_without"),
        )
    )


def accepted(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that the policy's verdict on the ledger keeps, with all their columns.

    The rows ride along with their measurements, so no join by id is needed and ids may repeat.
    """
    return apply_policy(ledger(docs, whole_rows=True), policy).filter("kept").select("row.*")


def verdict_bits(m: tuple[int, ...]) -> int:
    """The ledger's failure bits of one document's measurements."""
    measured = dict(zip(MEASURES, m, strict=True))
    return sum(1 << i for i, failed in enumerate(RULES.values()) if failed(measured))
