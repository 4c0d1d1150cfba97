"""The pipeline's stages on a small corpus, each against what its own input asks for."""

import collections
import random

import corpus_pipeline
from chronolith.llm import quality_rules
from chronolith.llm.common import written

from .test_operators import brute_groups, brute_spans, sentence


def test_stages(spark):
    r = random.Random(12)
    shared = sentence(r, 90)
    rows = []
    for i in range(80):
        text = sentence(r, r.randrange(30, 120))
        if i % 6 == 0:
            text += " " + shared
        rows.append((i, text))
        if i % 9 == 0:
            rows.append((200 + i, text + " more"))
    rows += [(400, "### " * 50), (401, None), (402, "too short")]
    docs = spark.createDataFrame([(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names, now = [n for n, _ in corpus_pipeline.STAGES], docs
    assert names == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""), "test")
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
    kept = {i for i, t in rows if not quality_rules.verdict_bits(quality_rules.measure((t or "").encode()))}
    assert {x.doc_id for x in seen["quality_rules"]} == kept
    first = [(x.doc_id, x.text, x.lang, x.source) for x in seen["quality_rules"]]
    assert {x.doc_id for x in seen["minhash_near_dedup"]} == {w[1] for w in brute_groups(first)}
    second = [(x.doc_id, x.text) for x in seen["minhash_near_dedup"]]
    spans = brute_spans([t.encode() for _, t in second])
    left = {x.doc_id: x.text for x in seen["suffix_array_dedup"]}
    assert len(left) == len(second)
    assert all(len(left[i].encode()) == n - gone for (i, _), (n, gone, _, _) in zip(second, spans, strict=True))
    copies = collections.Counter(x.doc_id for x in seen["mixing"])
    assert set(copies) <= set(left) and max(copies.values()) <= 2
    assert {x.doc_id for x in seen["packing"]} == set(copies)


def test_near_copies_from_80_percent(spark):
    r = random.Random(21)
    rows = []
    for g in range(12):  # two changed words of 100 leave 86 of 106 shingles: 0.811
        words = sentence(r, 100).split()
        rows.append((10 * g, " ".join(words), "en", "a"))
        for at in (20, 70):
            words[at] = f"new{g}"
        rows.append((10 * g + 1, " ".join(words), "en", "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {w[1] for w in brute_groups(rows, 80)}
    assert len(want) == 12 and len({w[1] for w in brute_groups(rows, 85)}) == 24
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
