"""Copies, texts of one repeated word, and groups that are split: rows of places grow with different texts, not with copies times parts."""

import collections
import hashlib
import random

import pytest

from chronolith.llm import common, suffix_dedup


def brute_force(texts, length):
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("group", [2, 512])
def test_copies_are_one_text(spark, monkeypatch, group):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    hot, line = some(700), "Erberte " * 90
    near = [hot[:p] + some(3) + hot[p + 3 :] for p in range(20, 680, 44)]
    texts = [hot] * 40 + near + [line] * 40 + [some(9) + line + some(9) for _ in range(5)] + [None, "", "", some(500), hot[:399], hot[:400], line + hot]
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # ids and whole rows repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = collections.Counter()
    write = common.Scratch.written

    def counted(self, df, label):
        out = write(self, df, label)
        if "k1" in out.columns and "c1" in out.columns:
            made[label] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(common.Scratch, "written", counted)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.spans(docs).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_force([(t or "").encode() for _, t in rows], 400), strict=True))
    # a row for a text and a context in it, however often they occur and however the context's group is split
    bound = sum(len({tuple(c) for c in contexts(t)}) for t in {t for t in texts if t})
    assert made["suffix-bytes-contexts"] <= bound and made["suffix-bytes-places"] <= bound


def contexts(text):
    raw = text.encode()
    for g, start, n, off in zip(*suffix_dedup.anchors(raw), strict=True):
        yield g, off, raw[start : start + n + 399]


def test_words_of_copies(spark, monkeypatch):
    r = random.Random(9)
    shared = " ".join("".join(r.choice("abcd") for _ in range(3)) for _ in range(60))
    texts = [shared] * 6 + [f"x{i} {shared} y{i}" for i in range(9)] + ["a b " * 60] * 3 + [f"{i} " + "a b " * 60 for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.text.split() for x in suffix_dedup.cleaned(docs, (suffix_dedup.WORDS,)).collect()}
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert got == {x.doc_id: x.text.split() for x in suffix_dedup.cleaned(docs, (suffix_dedup.WORDS,)).collect()}
    assert [got[i] for i in range(6)] == [[]] * 6 and got[6] == ["x0", "y0"] and got[15] == [] and got[18] == ["0"]
    assert {x.doc_id: x.text.split() for x in suffix_dedup.cleaned(docs).collect()} == got
