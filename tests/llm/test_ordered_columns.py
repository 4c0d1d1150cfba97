"""The suffix order of aligned strings, and that the repeats come from it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import queries, suffix_dedup
from chronolith.llm.suffix_groups import ordered_columns, sort_suffixes

from .test_operators import brute_spans, sentence, table


def aligned(r, letters, n):
    strings = [[r.randrange(letters) for _ in range(r.randrange(1, 9))] for _ in range(n)]
    low = [r.randrange(5) for _ in strings]
    grid = np.zeros((n, max(a + len(s) for a, s in zip(low, strings, strict=True))), np.uint8)
    for k, (a, s) in enumerate(zip(low, strings, strict=True)):
        grid[k, a : a + len(s)] = s
    return strings, np.array(low), grid


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_order_of_aligned_strings(letters):
    r = random.Random(letters)
    for _ in range(200):
        strings, low, grid = aligned(r, letters, r.randrange(1, 12))
        got = list(ordered_columns(grid, low, low + np.array(list(map(len, strings)))))
        for c, order, same in got:
            suffix = {k: s[c - low[k] :] for k, s in enumerate(strings) if low[k] <= c < low[k] + len(s)}
            assert sorted(order.tolist()) == sorted(suffix)
            rows = [suffix[k] for k in order.tolist()]
            assert rows == sorted(rows) and same[0] == 0
            for a, b, n in zip(rows, rows[1:], same[1:].tolist(), strict=False):
                assert a[:n] == b[:n] and (len(a) == n or len(b) == n or a[n] != b[n])
        # one text of (column, symbol) and a mark after each string has the same order
        text, spot = [], []
        for k, s in enumerate(strings):
            text += [(int(low[k]) + j + 1) * letters + x + len(strings) for j, x in enumerate(s)] + [len(strings) - 1 - k]
            spot += [(k, int(low[k]) + j) for j in range(len(s))] + [None]
        whole = [spot[i] for i in sort_suffixes(text) if spot[i]]
        for c, order, _ in got:
            mine = [strings[k][c - low[k] :] for k, at in whole if at == c]
            assert mine == [strings[k][c - low[k] :] for k in order.tolist()]


def test_without_the_order_little_is_found(monkeypatch):
    r = random.Random(61)
    base = [r.randbytes(735) for _ in range(40)]
    contexts = [(b, 336, 1) for b in base] + [(b[:700] + r.randbytes(35), 336, 1) for b in base] + [(r.randbytes(735), 336, 2) for _ in range(40)]
    r.shuffle(contexts)
    found = suffix_dedup.repeated_ranges(contexts)
    assert sum(b - a for x in found for a, b in x) == 40 * (2 * 700 + 735)

    def as_they_come(grid, low, high):  # the suffixes in no order, with what neighbours share
        for c in range(grid.shape[1]):
            rows = np.random.default_rng(61).permutation(len(low))  # one order for all columns
            rows = rows[(low[rows] <= c) & (c < high[rows])]
            same = [0]
            for a, b in zip(rows, rows[1:], strict=False):
                n = min(high[a], high[b]) - c
                d = np.flatnonzero(grid[a, c : c + n] != grid[b, c : c + n])
                same.append(int(d[0]) if len(d) else n)
            yield c, rows, np.array(same)

    monkeypatch.setattr(suffix_dedup, "ordered_columns", as_they_come)
    lost = suffix_dedup.repeated_ranges(contexts)
    windows = lambda x: sum(b - a - 399 for y in x for a, b in y)
    assert windows(lost) < windows(found) / 3


@pytest.mark.parametrize(("group", "length"), [(512, 150), (3, 150)])
def test_spans_at_any_length(spark, monkeypatch, group, length):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(62)
    shared = [sentence(r, n) for n in (24, 30, 66, 90)]
    rows = []
    for i in range(50):
        parts = [sentence(r, r.randrange(1, 30))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            parts += [s[r.randrange(len(s) // 4) : len(s) - r.randrange(30)], sentence(r, r.randrange(4))]
        rows.append((i, "".join(parts), "en", "a"))
    rows += [(60, "xy" * 400, "en", "a"), (61, None, "en", "a"), (None, rows[3][1], None, None)]
    unit = suffix_dedup.Unit("bytes", length, 64, 1)
    got = suffix_dedup.spans(table(spark, rows), unit).collect()
    want = brute_spans([(t or "").encode() for _, t, _, _ in rows], length)
    assert sorted((str(x.doc_id), x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((str(i), *w[1:]) for (i, *_), w in zip(rows, want, strict=True))


def test_large_groups_of_words(spark, monkeypatch):
    """One passage in many versions: its gram's group is split down to single windows."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    r = random.Random(63)
    shared = [r.choice("abcdefgh") + r.choice("ijklmn") for _ in range(80)]
    texts = []
    for i in range(30):
        p = list(shared)
        p[r.randrange(80)] = f"new{i}"
        texts.append(" ".join([f"head{i}", *p, f"tail{i}"]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.text for x in suffix_dedup.cleaned(docs, (suffix_dedup.WORDS,)).collect()}
    windows = {}
    for i, t in enumerate(texts):
        w = t.split()
        for at in range(len(w) - 50):
            windows.setdefault(tuple(w[at : at + 51]), []).append((i, at))
    for i, t in enumerate(texts):
        w = t.split()
        gone = {j for hits in windows.values() if len(hits) > 1 for k, at in hits if k == i for j in range(at, at + 51)}
        assert got[i].split() == [x for j, x in enumerate(w) if j not in gone]


def test_columns_with_dots_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a " * 300, 2, 3, "x"), (2, "b " * 30, 2, 3, "y")], "doc_id long, text string, `a.b` int, row int, `left` string")
    out = suffix_dedup.cleaned(docs)
    assert out.columns == docs.columns
    assert sorted((x[0], x[2], x[4]) for x in out.collect()) == [(1, 2, "x"), (2, 2, "y")]
    assert out.filter(F.col("`a.b`") == 2).count() == 2


def test_short_passages_are_reported_and_not_removed(spark, tmp_path):
    r = random.Random(64)
    words = lambda n: " ".join(r.choice("abcdefgh") + r.choice("ijklmn") * r.randrange(3) + r.choice("opq") for _ in range(n))
    p, q = words(55), words(60)
    assert max(len(p), len(q)) < 400
    texts = {1: f"{words(9)} {p} one", 2: f"{words(5)} {p} two {q}", 3: q.replace(" ", "\n"), 4: words(300), 5: None, 6: words(20)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op6_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: (x.n_passages, x.n_passage_words) for i, x in got.items()} == {1: (1, 55), 2: (2, 115), 3: (1, 60), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    assert all(x.n_removed == 0 and x.n_bytes == len(texts[i] or "") for i, x in got.items())
