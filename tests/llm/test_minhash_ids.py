"""Many different texts under one doc_id, or none."""

import random

from pyspark.sql import functions as F

from chronolith.llm import minhash

from .test_operators import brute_groups, sentence


def test_a_hot_id_meets_each_text_once(spark):
    r = random.Random(41)
    rows = [(i, sentence(r, 40), "en", "a") for i in [7] * 60 + [None] * 60 + list(range(10, 30))]
    rows += [(i, t + " more", s, u) for i, t, s, u in rows[::5]] + [rows[0], rows[70]]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    f = minhash.features(docs)
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "k1", "k2")).alias("least")
    nodes = f.groupBy("n", "f1", "f2").agg(least).select(F.struct("least.d", "f1", "f2").alias("node"), "least.k1", "least.k2")
    assert minhash._own_rows(docs, nodes).count() == len(rows)
    assert minhash._texts(docs, nodes).count() == nodes.count()
    got = minhash.duplicates(docs).collect()
    want = sorted((str(i), *map(str, w)) for (i, *_), w in zip(rows, brute_groups(rows), strict=True))
    assert sorted((str(x.doc_id), str(x.n_shingles), str(x.component_id)) for x in got) == want
