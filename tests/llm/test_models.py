"""The learned and the packed results against plain loops."""

import collections
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from chronolith.llm import language_id, mil_classifier, mixing, packing

from .test_operators import sentence, table

# --- attention over passages


def loop_score(p, bag):
    """One document, one passage and one number at a time."""
    codes, weights = [], []
    for x in bag:
        h = [math.tanh(sum(w * v for w, v in zip(row, x, strict=True)) + b) for row, b in zip(p["W"], p["b"], strict=True)]
        e = 0.0
        for v, u, w in zip(p["V"], p["U"], p["w"], strict=True):
            gate = 1 / (1 + math.exp(-sum(a * c for a, c in zip(u, h, strict=True))))
            e += w * math.tanh(sum(a * c for a, c in zip(v, h, strict=True))) * gate
        codes.append(h)
        weights.append(math.exp(e))
    z = [sum(w * h[k] for w, h in zip(weights, codes, strict=True)) / sum(weights) for k in range(len(codes[0]))]
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, p["c"], strict=True)) + p["d"][0])))


def bags_of(g, n):
    return [g.normal(size=(g.integers(1, 6), mil_classifier.N_FEATURES)) for _ in range(n)]


def flat(bags):
    n = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)


def test_forward_pass_equals_a_loop():
    g = np.random.default_rng(91)
    model, bags = mil_classifier.Model(seed=3), bags_of(g, 12)
    got = model._forward(*flat(bags))[-1]
    assert np.allclose(got, [loop_score(model.p, b) for b in bags], atol=1e-12)


def test_gradient_equals_differences():
    g = np.random.default_rng(92)
    model, bags = mil_classifier.Model(seed=4), bags_of(g, 8)
    y, weight = g.integers(0, 2, 8).astype(float), g.uniform(0.1, 1, 8)
    x, first, bag = flat(bags)

    def loss():
        out = model._forward(x, first, bag)[-1]
        return -(weight * (y * np.log(out) + (1 - y) * np.log(1 - out))).sum()

    for name, grad in model.gradient(x, first, bag, y, weight).items():
        for _ in range(12):
            at = tuple(g.integers(0, n) for n in model.p[name].shape)
            kept, diff = model.p[name][at], []
            for step in (1e-5, -1e-5):
                model.p[name][at] = kept + step
                diff.append(loss())
            model.p[name][at] = kept
            assert (diff[0] - diff[1]) / 2e-5 == pytest.approx(grad[at], rel=1e-4, abs=1e-8), name


def test_fitting_sees_a_bounded_number_of_passages(spark):
    assert len(mil_classifier._spread(np.zeros((10_000, 2)))) == mil_classifier.MOST_PASSAGES
    r = random.Random(93)
    rows = [(7, sentence(r, 30) + " ###" * (i % 2), "en", "a") for i in range(40)] + [(i, sentence(r, 30) + " ### $$$" * 9 * (i % 2), "en", "a") for i in range(10, 40)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in (7, *range(10, 40))], "doc_id long, quality int, toxic int")
    a, b = (mil_classifier.train(table(spark, x), labels) for x in (rows, rows[::-1]))
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)  # of one id's texts, always the same one


# --- language profiles


def loop_vector(text, d):
    """A text's vector by the definition, letter by letter."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    while "\0\0" in letters:
        letters = letters.replace("\0\0", "\0")
    letters = "\0" + letters.strip("\0") + "\0" if letters.strip("\0") else ""
    own = lambda c: np.random.default_rng([977, 0 if c == "\0" else ord(c)]).integers(0, 2, d) * 2 - 1
    total = np.zeros(d)
    for i in range(len(letters) - 2):
        total += np.array([own(letters[i])[(k - 2) % d] * own(letters[i + 1])[(k - 1) % d] * own(letters[i + 2])[k] for k in range(d)])
    return total


def test_profiles_equal_a_loop(spark):
    d = 64
    space = language_id.Space(d)
    for text in ("Aha, so!", "ein  Wort\n12 zwei", "x", "ÄÖ ß", "a-b-c"):
        assert np.array_equal(space.vector(text), loop_vector(text, d))
    r = random.Random(94)
    words = {"xx": ["nicht", "acht", "durch"], "yy": ["que", "ocho", "cielo"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(8)), k, "a") for i in range(40) for k in [("xx", "yy")[i % 2]]]
    docs = table(spark, rows)
    unit = lambda v: v / np.linalg.norm(v)
    from pyspark.sql import functions as F

    model = language_id.prototypes(docs, F.lit(True), dimensions=d)
    want = {k: unit(sum(unit(loop_vector(t, d)) for _, t, lang, _ in rows if lang == k)) for k in words}
    assert all(np.allclose(model[k], want[k], atol=1e-5) for k in words)
    for x in language_id.identify(docs, model, d).collect():
        cos = {k: float(unit(loop_vector(rows[x.doc_id][1], d)) @ want[k]) for k in words}
        best = max(cos, key=cos.get)
        assert x.lang_pred == best and x.score == pytest.approx(cos[best], abs=1e-5)


# --- packing and mixing


def test_tiers_and_step_groups(spark):
    r = random.Random(95)
    rows = [(i, sentence(r, r.choice([5, 40, 90, 200, 400, 900, 2500])), "en", "a") for i in range(400)]
    got = packing.pack(table(spark, rows).repartition(2), step_tokens=1 << 14).collect()
    seqs, steps = collections.defaultdict(list), collections.defaultdict(dict)
    for x in got:
        seqs[x.sequence_id].append(x)
        steps[x.step_group][x.sequence_id] = x.sequence_length
    for xs in seqs.values():
        xs.sort(key=lambda x: x.offset)
        assert sum(x.length for x in xs) == xs[0].sequence_length and len({(x.sequence_length, x.step_group) for x in xs}) == 1
    lengths = collections.Counter(x[0].sequence_length for x in seqs.values())
    assert set(lengths) >= set(packing.TIERS)  # every tier has windows
    assert sum(n for k, n in lengths.items() if k not in packing.TIERS) < 40  # the rest of a task, cut at powers of two
    pieces = collections.Counter(x.doc_id for x in got)
    short = {x.doc_id for x in got if x.doc_tokens <= 256}
    assert sum(pieces[i] == 1 for i in short) > 0.5 * len(short)  # most short documents stay whole
    assert pieces.total() < 3 * len(rows)
    full = collections.Counter()
    for own in steps.values():
        assert len(set(own.values())) == 1  # one length a step
        tokens = sum(own.values())
        assert tokens <= 1 << 14
        full[tokens == 1 << 14] += 1
    lengths_by_task = {(k >> 32, next(iter(own.values()))) for k, own in steps.items()}
    assert full[False] <= len(lengths_by_task)  # at most the last step of each length in a task is short


def test_pipeline_mixing_and_packing_equal_loops(spark):
    from tokenizers import Tokenizer

    r = random.Random(96)
    rows = [(i, sentence(r, r.randrange(1, 120)), "en", ("a", "b", None)[i % 5 % 3], 0) for i in range(150)]
    docs = spark.createDataFrame([(*x[:4], len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix(spark, docs, "").collect()
    copies = collections.Counter(x.doc_id for x in out)
    size = {i: len(t.split()) for i, t, *_ in rows}
    want = {x.doc_id: x.taken // x["size"] for x in mixing.mixed(docs).collect()}
    assert {i: copies[i] for i in size} == want
    for s in ("a", "b", None):  # within a source, copies fall with the hash
        own = sorted((x.h, x.n_copies) for x in mixing.mixed(docs).filter(mixing.F.col("source").eqNullSafe(s)).collect())
        n = [k for _, k in own]
        assert n == sorted(n, reverse=True) and max(n) - min(n) <= 1
    assert all((x.text, x.lang, x.source) == rows[x.doc_id][1:4] for x in out)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    mixed = spark.createDataFrame(out, docs.schema)
    tokens = collections.Counter()
    for x in corpus_pipeline.pack(spark, mixed, "").collect():
        tokens[x.doc_id] += x.length
    assert tokens == collections.Counter({i: n * (1 + len(tok.encode(rows[i][1], add_special_tokens=False).ids)) for i, n in copies.items() if n})
