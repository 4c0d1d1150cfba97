"""Repeated passages of over 50 words but under 400 bytes, against brute force."""

import collections
import random
import re

from chronolith.llm import suffix_dedup

LETTERS = "abcdefghij"


def brute_cleaned(texts, words=51, length=400):
    found = [list(re.finditer(rb"[^ \t-\r]+", t)) for t in texts]
    n = collections.Counter(tuple(w.group() for w in f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    m = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t, f in zip(texts, found, strict=True):
        gone = [False] * len(t)
        runs = [(f[i].start(), f[i + words - 1].end()) for i in range(len(f) - words + 1) if n[tuple(w.group() for w in f[i : i + words])] > 1]
        for a, b in runs + [(i, i + length) for i in range(len(t) - length + 1) if m[t[i : i + length]] > 1]:
            gone[a:b] = [True] * (b - a)
        out.append(bytes(c for c, x in zip(t, gone, strict=True) if not x))
    return out


def test_short_passages_equal_brute_force(spark):
    r = random.Random(31)
    some = lambda n: [r.choice(LETTERS) + r.choice(LETTERS) * r.randrange(3) + r.choice(LETTERS) for _ in range(n)]
    shared = [some(n) for n in (50, 51, 52, 60, 75, 130)]
    rows = [(0, None), (1, ""), (2, " ".join(some(40))), (3, "a " * 90), (4, " ".join(shared[1])), (5, " ".join(shared[1] + ["x"] + shared[1]))]
    for i in range(90):
        p = shared[i % 6]
        blank = r.choice([" ", "\n", "  "])  # the same words, set otherwise
        rows.append((10 + i, " ".join(some(r.randrange(30))) + " " + blank.join(p) + f" é{i} " + " ".join(some(r.randrange(30)))))
    rows += [rows[20], (None, rows[21][1])]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = suffix_dedup.cleaned(docs).collect()
    want = brute_cleaned([(t or "").encode() for _, t in rows])
    assert sorted((str(x.doc_id), x.text or "") for x in got) == sorted((str(i), t.decode("utf-8", "ignore")) for (i, _), t in zip(rows, want, strict=True))
    assert all(x.n_chars == len(x.text) for x in got if x.text is not None)
    # a passage of 51 words goes, one of 50 stays
    left = {x.doc_id: x.text for x in got}
    assert len(" ".join(shared[1])) < 400 and left[4] == "" and left[5] == " x "
    assert all(w in left[16].split() for w in shared[0])
    assert suffix_dedup.cleaned(docs.limit(0)).count() == 0
