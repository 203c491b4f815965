"""Problem 1: the most similar vectors for every vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize
from . import blocks
from .kmtree import Tree, unit_rows

RECALL = 0.99
LEAF_ROWS = 4096
SLACK = 3


class TreeRouter:
    """Routes by best-bin-first traversal; the gap of a leaf is how far its priority is below the first one's."""

    WIDEST = 0.6

    def __init__(self, tree: Tree):
        self.tree, self.n_cells = tree, tree.n_leaves

    def route(self, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = []
        for s in range(0, len(unit), 2048):
            q, leaf, pri = self.tree.visit(unit[s : s + 2048], margin)
            first = np.empty(len(unit[s : s + 2048]), np.float32)
            first[q[::-1]] = pri[::-1]
            seen = np.zeros(len(first), bool)
            gap = np.maximum(first[q] - pri, 1e-9)
            _, at = np.unique(q, return_index=True)
            gap[at] = 0
            seen[q] = True
            out.append((q + s, leaf, gap))
        return tuple(np.concatenate(x) for x in zip(*out))

    def assign(self, unit: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tree.assign(unit[s : s + 2048]) for s in range(0, len(unit), 2048)])

    def gaps(self, unit: np.ndarray) -> np.ndarray:
        q, leaf, gap = self.route(unit, self.WIDEST)
        out = np.full((len(unit), self.n_cells), self.WIDEST, np.float32)
        out[q, leaf] = gap
        return out


def leaf_size(rows: int) -> int:
    """Rows of a leaf: with its square root the number of leaves grows as slowly as their size, so neither the visits
    (what is shuffled) nor the comparisons of a visit (what is computed) run away."""
    return max(LEAF_ROWS, int(12 * rows**0.5))


def best_of_block(k: int, min_cosine: float):
    """The ``k`` best members of each query within a block, in double precision, ties to the smaller id."""

    def kernel(g: int, qid: np.ndarray, q: np.ndarray, mid: np.ndarray, m: np.ndarray) -> pd.DataFrame:
        out = []
        if len(qid) and len(mid):
            mu = unit_rows(m)
            long = np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64))
            m64 = lambda c: m[c].astype(np.float64) / long[c][:, None]
            step = max(64, (1 << 22) // max(1, len(mid)))
            for s in range(0, len(qid), step):
                ids, raw = qid[s : s + step], q[s : s + step]
                q64 = raw.astype(np.float64)
                q64 /= np.sqrt(np.einsum("ij,ij->i", q64, q64))[:, None]
                score = q64.astype(np.float32) @ mu.T
                take = min(k + 1 + SLACK, len(mid))
                r, c = np.nonzero(score >= min_cosine - 1e-5)
                if len(r) > 64 * len(ids):  # dense: choose the best of each row first
                    part = np.argpartition(-score, take - 1, axis=1)[:, :take]
                    r, c = np.repeat(np.arange(len(ids)), take), part.ravel()
                    keep = score[r, c] >= min_cosine - 1e-5
                    r, c = r[keep], c[keep]
                v = score[r, c]
                order = np.lexsort((-v, r))
                r, c, v = r[order], c[order], v[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                last = (rank == take - 1) & (take < len(mid))
                full = np.zeros(len(ids), bool)
                if last.any():  # more rows than looked at may tie with the k-th within float32's error
                    kth = np.full(len(ids), -2.0, np.float32)
                    kth[r[rank == k]] = v[rank == k]
                    full[r[last]] = v[last] >= kth[r[last]] - 4e-6
                keep = (rank < take) & ~full[r]
                r, c = r[keep], c[keep]
                cos = np.einsum("ij,ij->i", q64[r], m64(c))
                for i in np.flatnonzero(full):
                    exact = m64(slice(None)) @ q64[i]
                    near = np.flatnonzero(exact >= min_cosine - 1e-9)
                    near = near[np.lexsort((mid[near], -np.round(exact[near], 9)))][: k + 1]
                    r, c, cos = np.concatenate([r, np.full(len(near), i)]), np.concatenate([c, near]), np.concatenate([cos, exact[near]])
                cos = np.round(cos, 9)
                ok = (cos >= min_cosine) & (ids[r] != mid[c])
                r, c, cos = r[ok], c[ok], cos[ok]
                order = np.lexsort((mid[c], -cos, r))
                r, c, cos = r[order], c[order], cos[order]
                best = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((ids[r[best]], mid[c[best]], cos[best]))
        a, b, cos = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"id": a.astype(np.int64), "other": b.astype(np.int64), "cosine": cos.astype(np.float64)})

    return kernel


def best_of_task(k: int):
    """The ``k`` best of each query among what ``best_of_block`` has found in several blocks."""

    def fold(found: pd.DataFrame) -> pd.DataFrame:
        a, b, cos = (found[c].to_numpy() for c in ("id", "other", "cosine"))
        order = np.lexsort((b, -cos, a))
        a, b, cos = a[order], b[order], cos[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pd.DataFrame({"id": a[best], "other": b[best], "cosine": cos[best], "rank": (np.arange(len(a)) - np.searchsorted(a, a) + 1)[best].astype(np.int32)})

    return fold


def most_similar(cache: DataFrame, k: int = 5, min_cosine: float = 0.75, recall: float = RECALL, leaf_rows: int | None = None, sample_rows: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): the ``k`` vectors of the same model version most similar to each vector.

    Only vectors with a cosine of at least ``min_cosine`` count, rounded to 9 decimals, ties to the smaller id. The index
    is a hierarchical k-means tree fitted on about ``sample_rows`` vectors of a model version (by default 40,000, or 16 for each leaf, at
    most 131,072); every valid vector is indexed and every one is a query. How far a query widens its visits is calibrated: the gap within
    which ``recall`` of the true neighbours of up to 400 probe queries, found by brute force over all rows, lie.

    Null, short, non-finite and all-zero vectors have no neighbours. Of copies of one direction only the six
    with the smallest ids take part in the search; that is enough for every list, as ties go to smaller ids, and the
    remaining copies get the list of the sixth. An empty cache gives an empty result.
    """
    vectors = blocks.prepared(cache.select("model_version", "cache_id", "vector", "dim"))
    groups = blocks.groups_of(vectors)
    empty = vectors.sparkSession.createDataFrame([], "id long, other long, cosine double, rank int")
    if not len(groups):
        return empty
    keys = ["model_version", "dim", "copy_key"]
    hot = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1)
    searched, rest = vectors, None
    if hot.limit(1).count():
        hot = materialize(hot)
        ranked = vectors.join(hot, keys, "left_semi").select("id", *keys)
        first = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= k + 1)
        first = materialize(first)
        rest = ranked.join(first, "id", "left_anti").join(first.where(F.col("r") == k + 1).select(*keys, F.col("id").alias("lead")), keys)
        rest = materialize(rest.select("id", "lead"))
        searched = materialize(vectors.join(rest, "id", "left_anti"))
        discard(vectors)
    groups = blocks.groups_of(searched)
    leaves = [leaf_rows or leaf_size(int(g.rows)) for g in groups.itertuples()]
    wanted = [sample_rows or blocks.sample_size(2 * int(g.rows) // n) for n, g in zip(leaves, groups.itertuples())]
    routers = [TreeRouter(Tree.fit(unit_rows(s), int(g.rows), n)) for s, g, n in zip(blocks.sample_of(searched, groups, wanted), groups.itertuples(), leaves)]
    margins = _calibrate(searched, groups, routers, k, min_cosine, recall)
    top = blocks.meet(searched, routers, groups, margins, best_of_block(k, min_cosine), "id long, other long, cosine double, rank int", best_of_task(k))
    if rest is not None:
        top = materialize(top)
        top = top.unionByName(rest.join(top.withColumnRenamed("id", "lead"), "lead").select("id", "other", "cosine", "rank"))
    return top


def _calibrate(vectors: DataFrame, groups: pd.DataFrame, routers: list, k: int, min_cosine: float, recall: float) -> list[float]:
    probes = blocks.probes_of(vectors, groups)
    best = best_of_block(k, min_cosine)

    def kernel(g, pid, praw, pgap, ids, raw, home):
        found = best(g, pid, praw, ids, raw)
        at, row = {p: i for i, p in enumerate(pid)}, {m: i for i, m in enumerate(ids)}
        found["gap"] = [float(pgap[at[a], home[row[b]]]) for a, b in zip(found["id"], found["other"])]
        found["g"] = np.int32(g)
        return found

    truth = blocks.scan_probes(vectors, groups, routers, probes, kernel, "id long, other long, cosine double, gap double, g int")
    truth = truth.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))).where(F.col("rank") <= k).select("g", "gap").toPandas()
    margins = []
    for g in range(len(groups)):
        gap = truth.loc[truth["g"] == g, "gap"].to_numpy()
        margins.append(float(np.quantile(gap, recall, method="higher")) + 1e-6 if len(gap) else 0.05)
    return margins


def similar_pairs(cache: DataFrame, k: int = 5, min_cosine: float = 0.75) -> DataFrame:
    """(cache_a, cache_b), cache_a < cache_b: each pair of which one is among the ``k`` most similar of the other."""
    near = most_similar(cache, k, min_cosine)
    return near.select(F.least("id", "other").alias("cache_a"), F.greatest("id", "other").alias("cache_b")).distinct()
