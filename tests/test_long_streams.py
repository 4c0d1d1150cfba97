"""Folds of streams that are longer than 1,000 messages, and cut by every limit inside the operators."""

import random

import pytest
from pyspark.sql import functions as F

from chronolith.operators import fold
from chronolith.plans import queries


def best(frames):
    top, n = None, 0
    for pdf in frames:
        for k in pdf["k"]:
            if top is None or k > top:
                top, n = int(k), n + 1
    return {"best": top, "records": n}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(51)
    return [(i, r.choice(["hot"] * 30 + ["a", "b", None]), r.randrange(i + 1)) for i in range(4000)]


def want(rows):
    out = {}
    for _, s, k in rows:
        top, n = out.get(s, (None, 0))
        out[s] = (k, n + 1) if top is None or k > top else (top, n)
    return out


def test_whole_streams(spark, rows, monkeypatch):
    assert sum(s == "hot" for _, s, _ in rows) > 3000
    shuffled = sorted(rows, key=lambda x: x[2] * 7919 % 4001)
    m = spark.createDataFrame(shuffled, "global_position long, stream_name string, k long")
    got = lambda df: {x.stream_name: (x.best, x.records) for x in df.collect()}
    start = F.struct(F.lit(None).cast("long").alias("best"), F.lit(0).cast("long").alias("records"))

    def step(s, x):
        new = s["best"].isNull() | (x["k"] > s["best"])
        return F.struct(F.when(new, x["k"]).otherwise(s["best"]).alias("best"), (s["records"] + new.cast("long")).alias("records"))

    assert got(fold.by_array(m, start, step, ["k"], part=1500).select("stream_name", "state.*")) == want(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    assert got(fold.by_python(m, best, "stream_name string, best long, records long")) == want(rows)
    monkeypatch.setattr(queries, "_bodies", lambda spark, d: m)
    assert got(queries.QUERIES["fold_array"](spark, "")) == want(rows)
    assert got(queries.QUERIES["fold_python"](spark, "")) == want(rows)
