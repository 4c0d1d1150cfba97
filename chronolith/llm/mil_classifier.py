"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is described by measured shares (symbols,
capitals, repeats and so on) and encoded by a tanh layer; gated attention, ``w . (tanh(V h) * sigmoid(U h))``
put through a softmax over the document's passages, weighs the codes, and the weighted code is scored. Encoder,
attention and score are learned together from document labels alone.

The model is fitted with numpy on at most ``SAMPLE`` labelled documents, those with the smallest hashes, and of a
longer one on ``MOST_PASSAGES`` passages at even distances; these bounds hold for fitting alone. A model has a few
thousand numbers and is sent to the tasks that score every passage of all documents. Scores are mapped so that the
cut which served best in training lies at ``CUT``.

Defined cases: null and empty texts, and texts without words, are one empty passage; repeated rows are scored
one by one; a document with several labels counts with the smallest, one with several texts is learned from the
text with the smallest hash; without labelled rows, or with labels of
one kind only, every score is that kind's share (1 without labels); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, small_batches

PASSAGE, SAMPLE, FOLDS, HELD_OUT, CUT = 64, 3000, 5, 0, 0.3
HIDDEN, ATTENTION, EPOCHS, RATE = 24, 12, 250, 0.03
MOST_PASSAGES = 512


def _lut(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_SPACE = _lut(bytes([0x20, *range(0x09, 0x0E)])).astype(bool)
#: Byte classes whose counts are divided by a passage's words.
_CLASSES = [
    _lut(b"#*$%&<>@^~\\"), _lut(b"|"), _lut(b"!?"), _lut(b",;:"), _lut(b"."), _lut(b"/_=+{}[]()\"'-"),
    _lut(bytes(range(ord("A"), ord("Z") + 1))), _lut(bytes(range(ord("a"), ord("z") + 1))), _lut(b"0123456789"), _lut(bytes(range(0xC2, 0xF5))), _lut(b"\n"),
]
N_FEATURES = len(_CLASSES) + 7


def _doubled(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, ranks, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return ranks, counts[ranks] > 1


def encode(raw: bytes) -> np.ndarray:
    """A row of features for each passage."""
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros((1, N_FEATURES), np.float32)
    b = np.frombuffer(raw, np.uint8)
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    at = np.arange(0, n, PASSAGE)
    size = np.diff(np.append(at, n)).astype(float)
    cuts = starts[at]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    passage = np.arange(n) // PASSAGE
    distinct = np.bincount(np.unique(passage * (len(known) + 1) + ids) // (len(known) + 1), minlength=len(at))
    same = np.append(ids[1:] == ids[:-1], False)
    twice2, twice4 = np.zeros(n, bool), np.zeros(n, bool)
    if n > 2:
        ranks, twice2[: n - 1] = _doubled(ids[:-1] * len(known) + ids[1:])
        if n > 4:
            _, twice4[: n - 3] = _doubled(ranks[:-2] * n + ranks[2:])
    add = lambda x: np.add.reduceat(x, at, dtype=np.float64) / size
    chars = np.diff(np.append(cuts, len(b)))
    cols = [np.add.reduceat(lut[b], cuts, dtype=np.int64) / size for lut in _CLASSES]
    cols += [chars / size / 8, distinct / size, add(same), add(twice2), add(twice4), size / PASSAGE, np.full(len(at), np.log1p(n) / 8)]
    return np.stack(cols, 1).astype(np.float32)


def _squashed(x: np.ndarray) -> np.ndarray:
    return np.log1p(4 * x)


def _spread(bag: np.ndarray) -> np.ndarray:
    """At most ``MOST_PASSAGES`` rows, at even distances."""
    return bag if len(bag) <= MOST_PASSAGES else bag[np.linspace(0, len(bag) - 1, MOST_PASSAGES).astype(np.int64)]


class Model:
    """Weights of the network, the features' scale and the map of raw scores to scores."""

    def __init__(self, seed: int = 5, constant: float | None = None):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[-1]), s)
        self.p = {"W": g(HIDDEN, N_FEATURES), "b": np.zeros(HIDDEN), "V": g(ATTENTION, HIDDEN), "U": g(ATTENTION, HIDDEN), "w": g(ATTENTION), "c": g(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale, self.cut, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.5, constant

    def _forward(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["W"].T + p["b"])
        t, s = np.tanh(h @ p["V"].T), 1 / (1 + np.exp(-(h @ p["U"].T)))
        e = (t * s) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, s, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradient(self, x: np.ndarray, first: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted cross-entropy, by every weight."""
        h, t, s, a, z, out = self._forward(x, first, bag)
        p, do = self.p, (out - y) * weight
        g = {"c": z.T @ do, "d": np.array([do.sum()])}
        dz = do[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        g["w"] = (t * s).T @ de
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = dt.T @ h, ds.T @ h
        dh = (a[:, None] * dz[bag] + dt @ p["V"] + ds @ p["U"]) * (1 - h * h)
        g["W"], g["b"] = dh.T @ x, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> Model:
        x = _squashed(np.concatenate(bags).astype(np.float64))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        n = np.array([len(v) for v in bags])
        first, bag = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) / len(y)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            p, g = self.p, self.gradient(x, first, bag, y, weight)
            for k in p:
                grad = g[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        raw = self._forward(x, first, bag)[-1]
        tried = np.linspace(0.02, 0.98, 97)
        right = [((raw >= c) == (y == 1)).mean() for c in tried]
        self.cut = float(np.mean(tried[np.array(right) >= max(right) - 1e-12]))
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """0 to 1; ``cut`` goes to CUT, either side linearly."""
        if self.constant is not None or not bags:
            return np.full(len(bags), self.constant if self.constant is not None else 1.0)
        n = np.array([len(v) for v in bags])
        first, bag = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(n)), n)
        raw = self._forward((_squashed(np.concatenate(bags).astype(np.float64)) - self.mean) / self.scale, first, bag)[-1]
        return np.where(raw < self.cut, raw / self.cut * CUT, CUT + (raw - self.cut) / (1 - self.cut) * (1 - CUT))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out; only its features reach the driver."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id"))
    chosen = known.orderBy("draw", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_spread(encode(x or b"")).ravel().tolist() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(bags, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "quality", "text").mapInArrow(features, f"doc_id {kind}, y int, x array<float>")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("x", F.xxhash64("x")).alias("x")).toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    ids, bags = rows["doc_id"].to_pylist(), [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float32).reshape(-1, N_FEATURES) for v in rows["x"]]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], bags[i].tobytes()))
    return Model().fit([bags[i] for i in order], y[order])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    small_batches(docs.sparkSession, 500)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score([encode(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
