"""Near-duplicate embeddings by product quantisation.

A bounded sample of the vectors fits a coarse quantiser and, on residuals, a codebook for each subspace. The coarse
quantiser has ``k`` centroids for either half of a vector, and each pair of them is an inverted list: k grows with
the square root of the number of vectors, so lists stay at about ``PER_LIST`` vectors however many there are, and a
sample of bounded size is enough to fit them. Every vector is put in its nearest list with the codes of its residual
and the length of what the codes miss. As a query it visits its nearest lists, ``probes`` of them: at least
``PROBES``, and half the square root of their number where that is more, which keeps recall up as lists get finer.
There asymmetric distances come from tables (query residual against codewords); a vector goes on if its distance
less its code error can be within the threshold, so the codes lose nothing, and is then compared by exact cosine in
double precision.

Equal vectors are one class. A list's members and its visitors are cut into blocks of bounded size, and each pair of
blocks is a group, to which vectors travel in the precision of the table. A pair found from both sides counts on one
side only. A block returns counts and a spanning forest of its links, not its pairs, so output stays in proportion
to the vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths never link; repeated rows are vectors of their own (cosine 1); null vec_ids count as largest;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_key, written
from .components import components

COSINE, PROBES = 0.9, 16
#: Vectors that fit the index, and bytes of them at most; vectors a list; centroids a half at most.
SAMPLE, SAMPLE_BYTES, PER_LIST, MOST_CENTROIDS = 65_536, 64 << 20, 400, 4096
SUBSPACES, CODEWORDS, BLOCK = 8, 64, 2048
_BIG = (1 << 63) - 1
_CELLS, _PAIRS = 1 << 22, 1 << 15  # numbers in one block of distances (16 MB), pairs compared at once


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c for each row of x, in slices; ties by index."""
    step, half = max(1, _CELLS // max(1, len(c))), (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    r = np.random.default_rng(1)
    c = x[np.sort(r.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        order = np.argsort(at, kind="stable")
        own, first, n = np.unique(at[order], return_index=True, return_counts=True)
        c[own] = np.add.reduceat(x[order], first, axis=0) / n[:, None].astype(x.dtype)
    return c


class Index:
    """Centroids of either half and residual codebooks; a few MB at most, sent to the tasks."""

    def __init__(self, sample: np.ndarray, n: int):
        sample = sample.astype(np.float32)
        dim = sample.shape[1]
        self.k = int(np.clip(round((n / PER_LIST) ** 0.5), 1, min(MOST_CENTROIDS, len(sample))))
        self.half = dim // 2
        self.coarse = [_kmeans(np.ascontiguousarray(x), self.k) for x in (sample[:, : self.half], sample[:, self.half :])]
        rest = sample - self.centroids(self.lists(sample, 1)[:, 0])
        self.cuts = np.array_split(np.arange(dim), min(SUBSPACES, dim))
        self.books = [_kmeans(np.ascontiguousarray(rest[:, c]), CODEWORDS) for c in self.cuts]

    def probes(self) -> int:
        return min(self.k * self.k, max(PROBES, round(self.k / 2)))

    def centroids(self, lists: np.ndarray) -> np.ndarray:
        return np.concatenate([self.coarse[0][lists // self.k], self.coarse[1][lists % self.k]], 1)

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, nearest first: of the i-th and j-th nearest centroids only i * j <= probes can be among them."""
        x = x.astype(np.float32)
        i, j = np.divmod(np.arange(min(self.k, probes) ** 2), min(self.k, probes))
        i, j = i[(i + 1) * (j + 1) <= probes], j[(i + 1) * (j + 1) <= probes]
        out, step = [], max(1, _CELLS // max(len(i), self.k))
        for at in range(0, len(x), step):
            own = x[at : at + step]
            near = [(c * c).sum(1) - 2 * (h @ c.T) for c, h in zip(self.coarse, (own[:, : self.half], own[:, self.half :]), strict=True)]
            order = [np.argsort(d, 1, kind="stable")[:, :probes] for d in near]
            near = [np.take_along_axis(d, o, 1) for d, o in zip(near, order, strict=True)]
            best = np.argsort(near[0][:, i] + near[1][:, j], 1, kind="stable")[:, :probes]
            out.append(np.take_along_axis(order[0][:, i] * self.k + order[1][:, j], best, 1))
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)

    def codes(self, x: np.ndarray, list_: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to a list, and the length of what they miss."""
        rest = x - self.centroids(np.array([list_]))
        codes = np.stack([_nearest(rest[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - back) ** 2).sum(1))

    def tables(self, q: np.ndarray, list_: int) -> list[np.ndarray]:
        """Per subspace: squared distances of the queries' residuals to the codewords."""
        rest = q - self.centroids(np.array([list_]))
        return [((rest[:, c][:, None, :] - b[None]) ** 2).sum(2).astype(np.float32) for c, b in zip(self.cuts, self.books, strict=True)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])  # very large and small ones have a length as well
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _joined(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[int]:
    """Join the trees of u[i] and v[i] in ``root`` (every row points at its tree's root); which i joined two trees."""
    used: list[int] = []
    while True:
        a, b = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return used
        _, one = np.unique(b[apart], return_index=True)  # each upper root joins one lower tree in a round
        one = apart[one]
        used += one.tolist()
        root[b[one]] = a[one]
        while (root[root] != root).any():
            root[:] = root[root]


def _search(index: Index, cosine: float):
    """One block of one list, with the queries that visit the list -> counts of links by vector, and forest links."""
    reach = float(np.sqrt(2 - 2 * cosine))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        list_ = int(pdf["list"].iloc[0])
        member = pdf["member"].to_numpy(bool)
        x_row, q_row = np.flatnonzero(member), np.flatnonzero(~member)
        links, root, pairs = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), []
        if len(x_row) and len(q_row):
            v = pdf["v"].to_numpy()
            xs = _unit(np.stack(v[x_row]))
            codes, miss = index.codes(xs, list_)
            bound = ((reach + miss + 1e-5) ** 2).astype(np.float32)
            probes, own, n = np.stack(pdf["probes"].to_numpy()[x_row]), pdf["own"].to_numpy(), pdf["n"].to_numpy(np.int64)
            rank = pdf.groupby(["d", "k1", "k2"], sort=True).ngroup().to_numpy()  # of the vector, as member and as query
            for at in range(0, len(q_row), 256):
                rows = q_row[at : at + 256]
                qs = _unit(np.stack(v[rows]))
                near = np.zeros((len(qs), len(xs)), np.float32)
                for i, t in enumerate(index.tables(qs, list_)):
                    near += t[:, codes[:, i]]
                a, b = np.nonzero(near <= bound)
                ok = np.concatenate([np.einsum("ij,ij->i", qs[a[i : i + _PAIRS]], xs[b[i : i + _PAIRS]]) >= cosine for i in range(0, len(a), _PAIRS)] or [np.zeros(0, bool)])
                a, b = a[ok], b[ok]
                u, w = rows[a], x_row[b]
                # found from the other side as well: the smaller vector's query counts
                twice = (rank[u] > rank[w]) & (probes[b] == own[u][:, None]).any(1)
                once = (rank[u] != rank[w]) & ~twice
                u, w = u[once], w[once]
                np.add.at(links, u, n[w])
                np.add.at(links, w, n[u])
                pairs += [(int(u[i]), int(w[i])) for i in _joined(root, u, w)]
        cols, some = ["d", "k1", "k2"], np.flatnonzero(links)
        one = pdf.iloc[some][cols].assign(links=links[some], d2=None, e1=None, e2=None)
        two = pdf.iloc[[u for u, _ in pairs]][cols].reset_index(drop=True).assign(links=0)
        two[["d2", "e1", "e2"]] = pdf.iloc[[w for _, w in pairs]][cols].to_numpy(np.int64)
        return pd.concat([f for f in (one, two) if len(f)] or [one]).astype(dict.fromkeys(["d2", "e1", "e2"], "Int64") | {"links": "int64"})

    return lambda pdf: run(pdf.reset_index(drop=True))


def usable(v: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def _linked(nodes: DataFrame, dim: int, n: int, cosine: float, probes: int | None) -> DataFrame:
    """d, k1, k2, links, d2, e1, e2 for the classes of one length."""
    mine = nodes.filter(F.size("v") == dim)
    kind = nodes.schema["v"].dataType.simpleString()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    draw = F.pmod("k1", F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = mine.filter(draw < min(1.0, 1.1 * most / n)).orderBy("k1", "k2").limit(most).select("v").toArrow()
    if not drawn.num_rows:
        drawn = mine.orderBy("k1", "k2").limit(1).select("v").toArrow()
    index = Index(_unit(_matrix(drawn["v"], dim)), n)
    visited = min(probes, index.k**2) if probes else index.probes()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = index.lists(_unit(_matrix(batch.column("v"), dim)), visited).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * at.shape[1], pa.int32()), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "probes"])

    placed = written(mine.mapInArrow(assign, f"d long, k1 long, k2 long, n long, v {kind}, probes array<int>"), "pq-placed")
    placed = placed.withColumn("own", F.col("probes")[0])
    blocks = placed.groupBy(F.col("own").alias("list")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    visits = placed.withColumn("list", F.explode("probes"))
    rounds = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("rounds"))
    cuts = written(blocks.join(rounds, "list"), "pq-cuts")
    members = placed.withColumn("list", F.col("own")).join(cuts, "list").withColumn("block", F.pmod("k2", F.col("blocks")).cast("int"))
    members = members.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    visits = visits.join(cuts, "list").withColumn("round", F.pmod("k1", F.col("rounds")).cast("int"))
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["list", "block", "round", "d", "k1", "k2", "n", "v", "own"]
    both = members.select(*cols, "probes", F.lit(True).alias("member")).union(visits.select(*cols, F.lit(None).cast("array<int>").alias("probes"), F.lit(False).alias("member")))
    return both.groupBy("list", "block", "round").applyInPandas(_search(index, cosine), "d long, k1 long, k2 long, links long, d2 long, e1 long, e2 long")


def duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``; ``probes``: lists that a vector visits, if not as many as their number asks for."""
    small_batches(vectors.sparkSession, 2000)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v"))).select("*", *text_key(F.col("v").cast("array<double>")))
    d = F.coalesce(F.min("vec_id"), F.lit(_BIG)).alias("d")
    nodes = written(rows.filter("ok").groupBy("k1", "k2").agg(d, F.count("*").alias("n"), F.first("v").alias("v")).select("d", "k1", "k2", "n", "v"), "pq-classes")
    found = None
    for r in nodes.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():  # lengths of vectors, as a rule one
        part = _linked(nodes, r["dim"], r["count"], cosine, probes)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "pq-links")
    node = lambda *c: F.struct(*(F.col(x).alias(y) for x, y in zip(c, ("d", "k1", "k2"), strict=True)))
    links = found.filter(F.col("d2").isNotNull()).select(node("d", "k1", "k2").alias("u"), node("d2", "e1", "e2").alias("v"))
    comps = components(links).select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("component.d").alias("c"))
    counts = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    classes = nodes.select("k1", "k2", "d", "n").join(counts, ["k1", "k2"], "left").join(comps, ["k1", "k2"], "left")
    classes = classes.select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "d").alias("c"), F.lit(True).alias("ok"))
    out = rows.select("vec_id", "k1", "k2", "ok").join(classes, ["k1", "k2", "ok"], "left")
    comp = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.nullif("c", F.lit(_BIG)))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), F.col("vec_id").eqNullSafe(comp).alias("kept"))
