"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone. A trigram's vector is the
product of its letters' vectors, each shifted by its place; a text's vector is the sum of its trigrams'; a
language's prototype is the sum of its training texts' unit vectors. A text gets the language whose prototype
has the largest cosine with it, and that cosine as score.

Training reads at most about ``per_language`` documents of each language, those with the smallest hashes, and
sums fixed-point numbers, so it is the same whatever the partitioning.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as do all texts where nothing
was learned; ties go to the first language by name; repeated rows are judged one by one; rows with a null
language or a null text teach nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, small_batches

DIMENSIONS, PER_LANGUAGE, FOLDS, HELD_OUT = 1024, 1500, 4, 2
_POINT, _CACHE = 1 << 24, 60_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams, as three code points in one number, and their counts.

    Letters are lower-cased; each run of other characters, and either end, is one blank (0).
    """
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cps = np.concatenate([[0], np.where(_letters()[cps], cps, 0), [0]])
    cps = cps[np.concatenate([[True], (cps[1:] != 0) | (cps[:-1] != 0)])]
    if len(cps) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique((cps[:-2] << 42) | (cps[1:-1] << 21) | cps[2:], return_counts=True)


class Space:
    """Letter and trigram vectors; trigram rows are kept for reuse up to a bounded number."""

    def __init__(self, dimensions: int):
        self.d, self.letter, self.row = dimensions, {}, {}
        self.rows = np.empty((1024, dimensions), np.float32)

    def _of(self, cp: int) -> np.ndarray:
        if cp not in self.letter:
            if len(self.letter) > _CACHE:
                self.letter.clear()
            self.letter[cp] = np.random.default_rng([977, cp]).integers(0, 2, self.d).astype(np.float32) * 2 - 1
        return self.letter[cp]

    def _place(self, key: int) -> int:
        i = self.row[key] = len(self.row)
        if i >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
        self.rows[i] = np.roll(self._of(a), 2) * np.roll(self._of(b), 1) * self._of(c)
        return i

    def vector(self, text: str) -> np.ndarray | None:
        """The text's vector, or None where it has no letter."""
        keys, counts = trigrams(text)
        if not len(keys):
            return None
        if len(self.row) + min(len(keys), _CACHE) > 2 * _CACHE:
            self.row.clear()
        total = np.zeros(self.d, np.float32)
        for at in range(0, len(keys), _CACHE):  # very long texts of many alphabets: a bounded piece at a time
            part = keys[at : at + _CACHE].tolist()
            if len(self.row) + len(part) > 2 * _CACHE:
                self.row.clear()
            rows = [self.row[k] if k in self.row else self._place(k) for k in part]
            total += counts[at : at + _CACHE].astype(np.float32) @ self.rows[rows]
        return total


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.linalg.norm(v)), 1e-9)


def prototypes(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of each language, from the rows where ``learn`` holds."""
    small_batches(docs.sparkSession)
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return {}
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (v := space.vector(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(_unit(v) * _POINT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = sample.mapInArrow(bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():  # languages x dimensions
        out.setdefault(r["lang"], np.zeros(dimensions))[r["i"]] = r["x"]
    return {k: _unit(out[k]).astype(np.float32) for k in sorted(out)}


def identify(docs: DataFrame, model: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names, matrix = list(model), np.array(list(model.values()), np.float32).reshape(-1, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(1).to_pylist():
                v = space.vector(text) if text and names else None
                cos = matrix @ _unit(v) if v is not None else np.zeros(0)
                pred.append(names[int(cos.argmax())] if len(cos) else "und")
                score.append(float(np.clip(cos.max(), 0, 1)) if len(cos) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def predict(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, then judge every row."""
    return identify(docs, prototypes(docs, fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
