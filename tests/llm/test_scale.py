"""What only shows when there are many lists or large buckets: recall of the probing, bounded memory, blocks."""

import random
import tracemalloc

import numpy as np
import pytest

from chronolith.llm import minhash, pq_dedup
from chronolith.llm.components import components

from .test_operators import brute_groups, brute_links, sentence


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pairs_at(g, n, dim, low=0.9, high=0.93):
    """n vectors without clusters, and one for each of them at a cosine between low and high."""
    x, e = unit(g.normal(size=(n, dim))), g.normal(size=(n, dim))
    e = unit(e - (e * x).sum(1, keepdims=True) * x)
    cos = g.uniform(low, high, (n, 1))
    return np.concatenate([x, x * cos + e * np.sqrt(1 - cos**2)])


def test_recall_with_many_more_lists_than_probes(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 4)
    monkeypatch.setattr(pq_dedup, "SAMPLE", 1000)  # most vectors aren't among those that fit the index
    v = pairs_at(np.random.default_rng(71), 2000, 32).astype(np.float32)
    index = pq_dedup.Index(v[:1000], len(v))
    assert index.k**2 >= 10 * index.probes()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    found = {x.vec_id: x.n_links for x in pq_dedup.duplicates(df).collect()}
    x = unit(v.astype(np.float64))
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = np.array([found[i] for i in range(len(v))])
    assert (got <= want).all() and want.sum() > 3900
    assert got.sum() >= 0.9 * want.sum()


def test_links_over_several_blocks_and_lists(spark, monkeypatch):
    monkeypatch.setattr(pq_dedup, "PER_LIST", 10)
    monkeypatch.setattr(pq_dedup, "BLOCK", 30)
    monkeypatch.setattr(pq_dedup, "_CELLS", 64)
    g = np.random.default_rng(72)
    centre = g.normal(size=(4, 6))
    rows = [(i, (centre[i % 4] + g.normal(size=6) * 0.2).tolist()) for i in range(240)]
    rows += [(500, [1e300, 1e300, 0.0, 0.0, 0.0, 0.0]), (501, [1e-300, 1e-300, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in pq_dedup.duplicates(df, probes=10**6).collect())
    big = [(i, [x / 1e300 if abs(x) > 1e200 else x * 1e300 if 0 < abs(x) < 1e-200 else x for x in v]) for i, v in rows]
    assert got == brute_links(big)


def test_the_index_of_very_many_vectors_is_small():
    sample = unit(np.random.default_rng(73).normal(size=(8000, 64)))
    tracemalloc.start()
    index = pq_dedup.Index(sample, 1_000_000_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.k > 1500 and most < 200 << 20
    lists = index.lists(sample[:100], index.probes())
    assert lists.shape == (100, index.probes())
    x = sample[:100].astype(np.float32)
    near = [(c * c).sum(1) - 2 * h @ c.T for c, h in zip(index.coarse, (x[:, :32], x[:, 32:]), strict=True)]
    for r in range(0, 100, 10):
        d = (near[0][r][:, None] + near[1][r][None]).ravel()
        assert np.allclose(np.sort(d)[: index.probes()], d[lists[r]], atol=1e-5)


@pytest.mark.parametrize("rows", [3, 10_000])
def test_buckets_cut_into_blocks(spark, monkeypatch, rows):
    """Copies that drift away from their first text, so that buckets stay open, in blocks of few rows."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", rows)
    r = random.Random(74)
    docs = []
    for g in range(6):
        words = sentence(r, 120).split()
        for i in range(25):
            docs.append((1000 * g + i, " ".join(words), "en", "a"))
            words[r.randrange(len(words))] = f"new{g}{i}"
            if i % 6 == 5:
                words = [*words[40:], *sentence(r, 40).split()]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x.component_id for x in minhash.duplicates(df).collect()}
    assert got == {i: w[1] for (i, *_), w in zip(docs, brute_groups(docs), strict=True)}


def test_components_of_a_hub_and_chains(spark):
    r = random.Random(75)
    links = [(1000, i) for i in range(300)] + [(i, i + 1) for i in range(2000, 2040)] + [(5000, 5001), (5001, 5000), (5002, 5002)]
    r.shuffle(links)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == dict.fromkeys([*range(300), 1000], 0) | dict.fromkeys(range(2000, 2041), 2000) | dict.fromkeys((5000, 5001), 5000)
