"""Folding streams of events into entity state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronolith.sources.storage import written

FIRST, PART = 1000, 10_000


def first_n(messages: DataFrame, stream: str = "stream_name", order: str = "global_position", n: int = FIRST) -> DataFrame:
    """Each stream's first n messages (planned with a group limit before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(order))
    return messages.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_writer(messages: DataFrame, fields: dict[str, tuple[Column, Column]], stream: str = "stream_name", order: str = "global_position") -> DataFrame:
    """State whose fields each keep the last value written: name -> (value, which messages write it).

    One aggregation that combines before the shuffle, so hot streams cost no more than others.
    """
    aggs = [F.max_by(value, F.when(writes, F.col(order))).alias(name) for name, (value, writes) in fields.items()]
    return messages.groupBy(stream).agg(*aggs, F.count("*").alias("n_messages"))


def by_array(messages: DataFrame, start: Column, step: Callable[[Column, Column], Column], cols: list[str], stream: str = "stream_name", order: str = "global_position", n: int | None = None, part: int = PART) -> DataFrame:
    """Any sequential fold over each stream (its first n messages, if given), as a column function over sorted arrays.

    An array holds at most ``part`` messages: a longer stream is folded part by part, each from the state before it.
    """
    whole = messages if n is None else first_n(messages, stream, order, n)
    place = F.row_number().over(Window.partitionBy(stream).orderBy(order))
    rows = F.sort_array(F.collect_list(F.struct(order, *cols)))
    cut = written(whole.select(stream, order, *cols, F.floor((place - 1) / part).alias("_part")), "fold-parts")
    parts = cut.agg(F.max("_part")).first()[0] or 0
    states = cut.filter("_part = 0").groupBy(stream).agg(F.aggregate(rows, start, step).alias("state"))
    for k in range(1, parts + 1):
        states = written(states, "fold-states")
        now = cut.filter(F.col("_part") == k).groupBy(F.col(stream).alias("_stream")).agg(rows.alias("_rows"))
        both = states.join(now, F.col(stream).eqNullSafe(F.col("_stream")), "left")
        states = both.select(stream, F.when(F.col("_rows").isNull(), F.col("state")).otherwise(F.aggregate("_rows", F.col("state"), step)).alias("state"))
    return states


def by_python(messages: DataFrame, fold: Callable[[Iterator[pd.DataFrame]], dict], schema: str, stream: str = "stream_name", order: str = "global_position", n: int | None = None) -> DataFrame:
    """A Python fold over each stream (its first n messages, if given), for what columns can't say.

    ``fold`` gets a stream's messages in order as frames of one Arrow batch at most, so no stream is held as a whole.
    """
    whole = messages if n is None else first_n(messages, stream, order, n)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((None if pd.isna(k) else k, pdf) for batch in batches for k, pdf in batch.groupby(stream, sort=False, dropna=False))
        held: list[dict] = []
        for key, group in groupby(pieces, key=lambda p: p[0]):
            held.append({stream: key} | fold(pdf for _, pdf in group))
            if len(held) >= 1000:
                yield _frame(held, names)
                held = []
        if held:
            yield _frame(held, names)

    return whole.repartition(stream).sortWithinPartitions(stream, order).mapInPandas(run, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names})


def with_defaults(entities: DataFrame, states: DataFrame, defaults: dict[str, Column], stream: str = "stream_name") -> DataFrame:
    """States of the given entities; those without messages get the default state."""
    joined = entities.select(stream).join(states, stream, "left")
    return joined.select(stream, *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()))
