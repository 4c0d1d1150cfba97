"""Each operator against a brute-force version, and the cases that its docstring defines."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import chat_format, language_id, mil_classifier, minhash, mixing, packing, pq_dedup, quality_rules, suffix_dedup, warc
from chronolith.llm.common import WORD

WORDS = [f"{a}{b}{c}" for a in ("al", "be", "co", "du") for b in ("ran", "mis", "tol") for c in ("a", "en", "os", "ique")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, n int, node string, row string, key int, band string, u int, window int"


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """documents (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    full = [(i, t, lang, s, len(t or ""), 1, "x", 2, "y", "z", 3, "b", 4, 5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(3)
    base = sentence(r, 120)
    long = "\n".join(sentence(r, 9) for _ in range(2500))
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "one two", "en", "b"), (5, "One TWO", "en", "b"), (6, base, "en", "a"), (7, base, "fr", "a"), (7, base, "fr", "a"),
        (8, base.replace(base.split()[60], "changed", 1), "en", None), (9, long, "en", "c"), (10, long + " end", "en", "c"), (11, "é" * 450 + "ü" * 30, "de", "c"), (12, "x" + "é" * 450, "de", "c"),
        (None, sentence(r, 40), "en", "a"), (None, None, None, None), (13, "### $$$ %%% " * 30, "en", "a"), (14, "a" * 2000, "en", "a"),
    ]


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return table(spark, odd_rows)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


# --- quality rules


def brute_repeats(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = collections.Counter(windows)
    return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)})


def test_repeated_windows_equal_brute_force():
    r = random.Random(1)
    for letters in (1, 2, 3, 12):
        for _ in range(150):
            words = [str(r.randrange(letters)).encode() for _ in range(r.randrange(60))]
            assert quality_rules.measure(b" ".join(words))[5] == brute_repeats(words)


def test_quality_ledger(spark, odd, odd_rows, empty):
    led = quality_rules.apply_policy(quality_rules.ledger(odd)).collect()
    assert len(led) == len(odd_rows)
    assert sorted(x.doc_id for x in led if x.doc_id is not None and x.n_words == 0) == [1, 2, 3]
    assert all(not x.kept for x in led if x.base_failed)
    names = list(quality_rules.rules())
    for x in led:  # the bits of the row-wise verdict are those of the columns
        assert x.fail_bits == quality_rules.verdict_bits(tuple(x[m] for m in quality_rules.MEASURES)), names
    kept = quality_rules.accepted(odd)
    assert kept.columns == odd.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(x.doc_id) for x in led if x.kept)
    assert quality_rules.ledger(empty).count() == 0 and quality_rules.accepted(empty).count() == 0


def test_ablation_counts(spark, odd):
    led = quality_rules.ledger(odd)
    bits = [x.fail_bits & quality_rules.mask("web_v2") for x in led.collect()]
    names = list(quality_rules.rules())
    for x in quality_rules.ablate(led, "web_v2").collect():
        bit = 1 << names.index(x.rule)
        assert (x.n_failed, x.n_saved_without) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))


# --- chat formatting


def test_chat_round_trip(spark):
    r = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(r.randrange(1, 25)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            text = r.choice([None, "", "<|end|>", "<\\|turn|>x<\\\\|", "é" * r.randrange(50), sentence(r, r.randrange(1, 900))])
            rows.append((c, t, role, text, "extra"))
    rows += [(99, 0, "assistant", "dup", "e"), (99, 0, "assistant", "dup", "e"), (None, None, None, None, None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    formatted = chat_format.formatted(conv).cache()
    got = {x.conv_id: x for x in chat_format.read_back(formatted).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, role, x in turns if role == "assistant")
        sha = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    w = formatted.collect()
    later = [x for x in w if x.window > 0 and x.conv_id is not None and x.conv_id % 3 == 0 and x.conv_id != 99]
    assert later
    system = {c: turns[0][2] for c, turns in by.items() if turns[0][1] == "system" and len(turns[0][2].encode()) < 900}
    assert all(x.text.startswith("<|turn|>system<|text|>") for x in later if x.conv_id in system)
    assert chat_format.read_back(chat_format.formatted(conv.limit(0))).count() == 0


def test_windows_respect_the_budget(spark):
    conv = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], "w" * (37 * t % 1500)) for t in range(300)], "conv_id long, turn long, role string, text string")
    tokens = chat_format.windows(conv).withColumn("tok", chat_format.n_tokens(F.col("text"))).groupBy("window").agg(F.sum("tok").alias("n")).collect()
    assert len(tokens) > 20 and max(x.n for x in tokens) <= chat_format.BUDGET


# --- mixing


def test_mixing(spark, odd, odd_rows, empty):
    r = random.Random(5)
    rows = odd_rows + [(100 + i, sentence(r, r.randrange(1, 60)), "en", "abc"[min(2, i % 7)]) for i in range(900)]
    docs = table(spark, rows)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for x in got:
        size[x.source] += x.size
    names = sorted((s for s in size if s is not None)) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, {}
    while True:  # share out again and again until none is above its cap
        left = 1.5 * sum(size.values()) - sum(fixed.values())
        target = {s: left * w[s] / sum(w[t] for t in size if t not in fixed) for s in size if s not in fixed}
        over = {s: 2 * size[s] for s in target if target[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    target |= fixed
    taken = collections.Counter()
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size == size[x.source]
        assert x.target == pytest.approx(target[x.source])
        taken[x.source] += x.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= max(x.size for x in got if x.source == s) / 2 + 1
    again = {(x.doc_id, x.size): x.taken for x in mixing.mixed(docs.repartition(3)).collect()}
    assert again == {(x.doc_id, x.size): x.taken for x in got}
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(x.n_copies for x in got)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert {x.taken for x in mixing.mixed(docs.filter("text is null")).collect()} == {0}


# --- classifier


def test_classifier_learns_and_defined_cases(spark, odd, empty):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = sentence(r, r.randrange(20, 200))
        rows.append((i, " ".join(x + "###" for x in text.split()) if bad else text, "en", "a"))
        labels.append((i, 0 if bad else 1, 0))
    docs, lab = table(spark, rows), spark.createDataFrame(labels + labels[:5] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = mil_classifier.classify(docs, mil_classifier.train(docs, lab)).collect()
    held = [x for x in got if x.held_out]
    assert held and {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([x.predicted == (x.doc_id % 4 != 0) for x in held]) > 0.97
    model = mil_classifier.train(docs, lab)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in mil_classifier.classify(odd, model).collect())
    assert mil_classifier.classify(empty, model).count() == 0
    assert mil_classifier.train(docs, lab.limit(0)).score([np.zeros((1, mil_classifier.N_FEATURES))]).tolist() == [1.0]


# --- embeddings


def brute_links(rows, cosine=0.9):
    unit = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[k] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    near = {k: [j for j in unit if j != k and len(unit[j]) == len(unit[k]) and unit[k] @ unit[j] >= cosine] for k in unit}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((i, len(near.get(k, [])), c, i == c))
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pq_dedup, "BLOCK", block)
    monkeypatch.setattr(pq_dedup, "PER_LIST", 40)
    g = np.random.default_rng(4)
    rows = []
    for i in range(250):
        v = g.normal(size=16)
        rows.append((i, v.tolist()))
        if i % 5 == 0:
            rows += [(1000 + 3 * i + j, (v * 3 + g.normal(size=16) * 0.25 * j).tolist()) for j in range(3)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0, None] + [0.0] * 14), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1.0, 2.0])]
    rows += [(1, rows[1][1])]
    df = spark.createDataFrame([(i, None if v is None else v, 0) for i, v in rows], "vec_id long, embedding array<double>, n int")
    got = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in pq_dedup.duplicates(df).collect())
    assert got == brute_links(rows)
    assert pq_dedup.duplicates(df.limit(0)).count() == 0


# --- suffix deduplication


def brute_spans(texts, length=400):
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        kept = bytes(b for b, x in zip(t, gone, strict=True) if not x)
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1000, 2])
def test_suffix_equals_brute_force(spark, odd_rows, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(8)
    shared = [sentence(r, n) for n in (55, 70, 120, 62)]
    rows = [x for x in odd_rows if x[0] not in (9, 10)]
    for i in range(60):
        parts = [sentence(r, r.randrange(1, 40))]
        for _ in range(r.randrange(3)):
            s = r.choice(shared)
            cut = r.randrange(len(s) // 3)
            parts += [s[cut : len(s) - r.randrange(60)], sentence(r, r.randrange(3))]
        rows.append((200 + i, "".join(parts), "en", "a"))
    rows.append((300, "ab" * 700, "en", "a"))
    got = suffix_dedup.spans(table(spark, rows)).collect()
    want = brute_spans([(t or "").encode() for _, t, _, _ in rows])
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted((str(i), *w) for (i, *_), w in zip(rows, want, strict=True))


def test_suffix_cleaned(spark, odd, odd_rows, empty):
    out = suffix_dedup.cleaned(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert len(got) == len(odd_rows)
    assert {x.text for x in got if x.doc_id == 7} == {""} or all(len(x.text) < 400 for x in got if x.doc_id == 7)
    assert all(x.n_chars == len(x.text) for x in got if x.text is not None and x.doc_id in (6, 7, 12))
    assert suffix_dedup.spans(empty).count() == 0


# --- packing


def test_packing(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(9)
    rows = odd_rows + [(100 + i, sentence(r, r.randrange(1, 300)), "en", "a") for i in range(300)] + [(999, "a <|endoftext|> b", "en", "a")]
    got = packing.pack(table(spark, rows)).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for x in got:
        pieces[x.doc_id].append(x)
        seqs[x.sequence_id].append(x)
    texts = collections.defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append([*tok.encode(t or "", add_special_tokens=False).ids, packing.CLOSING_ID])
    for i, docs in texts.items():
        assert sum(x.length for x in pieces[i]) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for x in sorted(pieces[i], key=lambda x: x.start):
                assert x.start == at and x.doc_tokens == len(docs[0])
                assert x.ids_crc32 == zlib.crc32(np.array(docs[0][at : at + x.length], "<u4").tobytes())
                at += x.length
    for xs in seqs.values():
        at = 0
        for x in sorted(xs, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(empty).count() == 0


# --- language


def test_language(spark, odd, empty):
    r = random.Random(10)
    words = {"xx": ["schlaf", "acht", "nicht", "zwisch", "durch"], "yy": ["que", "llama", "ocho", "cielo", "queso"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randrange(5, 40))), k, "a") for i in range(300) for k in [("xx", "yy")[i % 2]]]
    rows += [(500, None, "xx", "a"), (501, "123 !!", "xx", "a"), (502, "nicht durch", None, "a"), (503, "", "yy", "a")]
    got = {x.doc_id: x for x in language_id.predict(table(spark, rows)).collect()}
    held = [got[i] for i in range(300) if got[i].held_out]
    assert {x.doc_id for x in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([x.lang_pred == ("xx", "yy")[x.doc_id % 2] for x in held]) > 0.98
    assert [got[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "xx", "und"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language_id.predict(odd).count() == odd.count() and language_id.predict(empty).count() == 0
    assert {x.lang_pred for x in language_id.identify(odd, {}).collect()} == {"und"}


# --- WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(5, "http://a/ä?x=%41", "<p>é</p>", 1), (3, None, "<p>é</p>", 1), (3, "http://b", "<p>é</p>", 1), (9, "u\nv", None, 1), (2, "u", "", 1), (7, "u", "y" * 300_000, 1), (None, "u", "solo", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc.round_trip(pages).collect()
    b32 = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(5, "<p>é</p>", "revisit", 3), (3, "<p>é</p>", "response", None), (3, "<p>é</p>", "response", None), (9, "", "revisit", 2), (2, "", "response", None), (7, "y" * 300_000, "response", None), (None, "solo", "response", None)]
    assert sorted(map(str, ((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got))) == sorted(map(str, ((i, len(t.encode()), b32(t), k, f) for i, t, k, f in want)))
    at = f"file://{tmp_path}/w"
    warc.pages_to_warc(pages, at)
    back = warc.read_warc(spark, at, payload=False)
    some = back.filter("record_type = 'response' and page_id in ('5', '7')")
    assert [(x.page_id, x.payload) for x in some.collect()] == [("7", None)]
    assert {x.target_uri for x in back.filter("page_id = '5'").collect()} == {"http://a/ä?x=%41"}
    assert {x.target_uri for x in back.filter("page_id = '9'").collect()} == {"u\nv"}
    assert bytes(warc.read_warc(spark, at).filter("page_id = '7'").first().payload) == b"y" * 300_000
    assert warc.round_trip(pages.limit(0)).count() == 0


# --- MinHash


def brute_sets(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_groups(rows, percent=85):
    sets = [brute_sets(t) for _, t, _, _ in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, *_ in rows]
    near = collections.defaultdict(list)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                near[a].append(b)
                near[b].append(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        c = min(ids[x] for x in seen)
        out.append((len(sets[a]), None if c == (1 << 63) - 1 else c))
    return out


@pytest.mark.parametrize("block", [8 << 20, 3000])
def test_minhash_equals_brute_force(spark, odd_rows, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    r = random.Random(11)
    rows = list(odd_rows)
    for g in range(12):  # chains of copies that drift away from their first text
        words = sentence(r, r.randrange(30, 200)).split()
        for i in range(10):
            rows.append((1000 * g + 100 + i, " ".join(words), "en", "a"))
            words[r.randrange(len(words))] = f"new{g}{i}"
    r.shuffle(rows)
    docs = table(spark, rows)
    got = minhash.duplicates(docs).collect()
    want = sorted((str(i), *map(str, w)) for (i, *_), w in zip(rows, brute_groups(rows), strict=True))
    assert sorted((str(x.doc_id), str(x.n_shingles), str(x.component_id)) for x in got) == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)
    stays = minhash.without_duplicates(docs)
    assert stays.columns == docs.columns
    left = stays.collect()
    words = [x for x in left if x.text and x.text.split()]
    groups = {w[1] for (i, t, _, _), w in zip(rows, brute_groups(rows), strict=True) if w[0]}
    assert sorted(str(x.doc_id) for x in words) == sorted(map(str, groups))
    assert len(left) - len(words) == sum(not (t or "").split() for _, t, _, _ in rows)


def test_minhash_empty(empty):
    assert minhash.duplicates(empty).count() == 0 and minhash.without_duplicates(empty).count() == 0


def test_circulant_signature_estimates_similarity():
    g = np.random.default_rng(1)
    base = g.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.unique(base[:3000]), np.unique(base[500:3500])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 2500 / 3500) < 0.15


def test_word_pattern_is_ascii_space_only():
    import re

    assert re.findall(WORD, "a b c\x0bd") == ["a b", "c", "d"]
