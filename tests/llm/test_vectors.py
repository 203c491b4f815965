from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from feedloom.llm import blocks, clusters, neighbours
from feedloom.llm.kmtree import Tree, unit_rows
from feedloom.llm.mixture import Mixture

SCHEMA = "cache_id long, model_version string, text_hash string, vector array<float>, dim int, id string, cell int"


def cache_of(spark, vectors, model="m"):
    rows = [(i, model, f"h{i}", None if v is None else [float(x) for x in v], 8, "clash", 9) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors, k=5, least=0.75):
    good = {i: np.asarray(v, np.float32).astype(float) for i, v in enumerate(vectors) if v is not None and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.stack([good[i] / np.sqrt((good[i] ** 2).sum()) for i in ids]) if ids else np.zeros((0, 8))
    s = np.round(x @ x.T, 9)
    pairs, link = set(), set()
    for a, i in enumerate(ids):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))
        pairs |= {(min(i, ids[b]), max(i, ids[b])) for b in order[:k] if s[a, b] >= least}
        link |= {(i, ids[b]) for b in order if s[a, b] >= least}
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in link:
            label[a] = label[b] = min(label[a], label[b])
    size = pd.Series(label).value_counts() if label else {}
    return pairs, {(c, i) for i, c in label.items() if size[c] >= 5}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    out = [list(c + rng.normal(scale=0.25, size=8)) for c in centres for _ in range(12)] + [list(rng.normal(size=8) * 3) for _ in range(30)]
    out += [None, [0.0] * 8, [float("nan")] + [1.0] * 7, [1.0] * 3, [float("inf")] + [1.0] * 7]
    out += [out[0]] * 9 + [[2 * x for x in out[3]]]  # copies, more than a list is long, and a longer copy
    return out


def test_pairs_match_brute_force(spark, vectors):
    got = {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(cache_of(spark, vectors)).collect()}
    assert got == brute(vectors)[0]


def test_small_leaves_reach_the_recall(spark, vectors):
    cache = cache_of(spark, vectors)
    near = neighbours.most_similar(cache, recall=0.98, leaf_rows=20).select("id", "other").distinct().collect()
    got = {(min(a, b), max(a, b)) for a, b in near}
    want = brute(vectors)[0]
    assert len(got & want) / len(want) >= 0.9


def test_sliced_blocks_lose_nothing(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 11)
    cache = cache_of(spark, vectors)
    pairs, members = brute(vectors)
    assert {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(cache).collect()} == pairs
    assert {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()} == members


def test_visits_are_not_shuffled(spark, vectors, monkeypatch):
    """A vector is written once, whatever it visits, and the shuffle files of the write are gone."""
    ready = blocks.prepared(cache_of(spark, vectors))
    groups = blocks.groups_of(ready)
    sample = unit_rows(blocks.sample_of(ready, groups, [1000])[0])
    router = neighbours.TreeRouter(Tree.fit(sample, len(sample), 10))
    names = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = names()
    met = blocks.meet(ready, [router], groups, [10.0], neighbours.best_of_block(5, -1.0), "id long, other long, cosine double, rank int", neighbours.best_of_task(5))
    assert router.n_cells > 5 and not names() - before
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 5 * len(sample)


@pytest.mark.parametrize("half", [True, False])
def test_packed_vectors_come_back(half):
    x = np.random.default_rng(4).normal(size=(6, 8)).astype(np.float16 if half else np.float32).astype(np.float32)
    y = np.vstack([x, np.float32([[1e-30] * 8, [1e30] * 8, [0.5] * 8])])
    assert len(blocks.packed(x)[0].as_py()) == (16 if half else 32)
    assert (blocks.matrix(blocks.packed(x), 8) == x).all() and (blocks.matrix(blocks.packed(y), 8) == y).all()


def test_small_clusters_beside_a_hot_one_are_whole(spark, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 1)
    monkeypatch.setattr(blocks, "LEAST_PART", 100, raising=False)
    rng = np.random.default_rng(8)
    at = lambda n, spread: rng.normal(size=32) + spread * rng.normal(size=(n, 32))
    # the hot cluster has nearly all links; those of the small ones count for little in a share of all links
    x = np.concatenate([at(1500, 0.3), *(at(6, 0.55) for _ in range(150)), rng.normal(size=(300, 32))]).astype(np.float32)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    label = clusters.merge(np.arange(len(x)), *np.nonzero(unit @ unit.T >= 0.75))
    size = np.bincount(label, minlength=len(x))
    want = {(int(c), i) for i, c in enumerate(label) if size[c] >= 5}
    cache = spark.createDataFrame([(i, "m", row.tolist(), 32) for i, row in enumerate(x)], "cache_id long, model_version string, vector array<float>, dim int")
    assert len({c for c, _ in want}) > 20
    assert {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()} == want


def test_clusters_match_brute_force_and_report(spark, vectors):
    cache = cache_of(spark, vectors)
    want = brute(vectors)[1]
    assert {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()} == want
    report = clusters.cluster_report(cache).collect()
    assert {(r.cluster_key, r.size) for r in report} == {(k, sum(c == k for c, _ in want)) for k, _ in want}
    assert all(len(r.typical_ids) == 5 and all((r.cluster_key, i) in want for i in r.typical_ids) for r in report)


def test_models_are_kept_apart(spark, vectors):
    some = vectors[:20]
    both = cache_of(spark, some, "a").unionByName(cache_of(spark, some, "b").selectExpr("cache_id + 1000 as cache_id", "model_version", "text_hash", "vector", "dim", "id", "cell"))
    got = {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(both).collect()}
    one = brute(some)[0]
    assert got == one | {(a + 1000, b + 1000) for a, b in one}


@pytest.mark.parametrize("rows", [[], [None, None], [[0.0] * 8], [[1.0] + [0.0] * 7]])
def test_nothing_to_compare(spark, rows):
    cache = cache_of(spark, rows)
    assert neighbours.similar_pairs(cache).count() == 0
    assert clusters.similarity_clusters(cache).count() == 0
    assert clusters.cluster_report(cache).count() == 0
    assert clusters.mixture_clusters(cache).count() == (1 if rows and rows[0] and any(rows[0]) else 0)


def test_hot_cluster_of_near_and_exact_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=8)
    hot = [list(base + rng.normal(scale=0.01, size=8)) for _ in range(300)] + [list(base)] * 100
    some = hot + [list(rng.normal(size=8) * 2) for _ in range(40)]
    cache = cache_of(spark, some)
    want = brute(some)
    assert {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()} == want[1]
    assert {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(cache).collect()} == want[0]
    report = {r.cluster_key: r.size for r in clusters.cluster_report(cache).collect()}
    assert report == {k: sum(c == k for c, _ in want[1]) for k, _ in want[1]}


def test_tree_visits_every_leaf_and_best_first():
    rng = np.random.default_rng(3)
    x = unit_rows(rng.normal(size=(500, 8)).astype(np.float32))
    tree = Tree.fit(x, 500, 25)
    q, leaf, pri = tree.visit(x[:50], margin=10.0)
    for i in range(50):
        assert sorted(leaf[q == i]) == list(range(tree.n_leaves))
        assert (np.diff(pri[q == i]) <= 1e-6).all()


def test_mixture_prefers_the_true_number_of_parts():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, (200, 6)) for c in np.eye(6)[:3]]).astype(np.float32)
    assert Mixture.fit(x, [1, 3, 12], dims=3).n_cells == 3


def test_mixture_clusters_cover_all_vectors(spark, vectors, monkeypatch):
    monkeypatch.setattr(clusters, "CELL_ROWS", 8)
    found = clusters.mixture_clusters(cache_of(spark, vectors)).collect()
    assert sum(r.size for r in found) == len(vectors) - 5 and len(found) > 3  # five are not valid
    assert all(len(set(r.typical_ids)) == min(5, r.size) for r in found)


def test_many_cells_against_brute_force(spark, data):
    """11,000 vectors: a tree of several leaves and a mixture of several components."""
    cache = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/embedding_cache.parquet").where("model_version = 'quill-embed-v2'")
    frame = cache.toPandas().sort_values("cache_id")
    good = [v is not None and len(v) == d and bool(np.isfinite(v).all()) and bool(np.any(v)) for v, d in zip(frame.vector, frame.dim)]
    ids, x = frame.cache_id[good].to_numpy(), np.stack(frame.vector[good].to_list()).astype(np.float32)
    label = np.arange(len(ids))
    for r, c in clusters.exact_links(x, x, 0.75):
        label = clusters.merge(label, r, c)
    size = np.bincount(label, minlength=len(ids))
    want = {(int(ids[k]), int(i)) for k, i in zip(label, ids) if size[k] >= 5}
    got = {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()}
    assert len(ids) > 2 * clusters.CELL_ROWS and len(got & want) >= 0.999 * max(len(got), len(want))
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]
    pairs = set()
    for a in range(0, len(ids), 1000):
        s = np.round(u[a : a + 1000] @ u.T, 9)
        for i in range(len(s)):
            s[i, a + i] = -2
            near = np.flatnonzero(s[i] >= 0.75)
            near = near[np.lexsort((ids[near], -s[i, near]))][:5]
            pairs |= {(min(ids[a + i], ids[j]), max(ids[a + i], ids[j])) for j in near}
    found = {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(cache).collect()}
    assert len(found & pairs) >= 0.97 * max(len(found), len(pairs))


def test_recall_on_the_tables(spark, data):
    cache = spark.read.parquet(f"{data}/embedding_cache.parquet")
    frame = cache.toPandas()
    want = set()
    for _, g in frame.groupby("model_version"):
        good = [(i, np.asarray(v, float)) for i, v, d in zip(g.cache_id, g.vector, g.dim) if v is not None and len(v) == d and np.isfinite(v).all() and np.any(v)]
        x = np.stack([v / np.sqrt((v**2).sum()) for _, v in good])
        s, ids = np.round(x @ x.T, 9), [i for i, _ in good]
        for a in range(len(ids)):
            order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:5]
            want |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if s[a, b] >= 0.75}
    got = {(r.cache_a, r.cache_b) for r in neighbours.similar_pairs(cache).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_links_that_no_probe_shows_are_found(spark, monkeypatch):
    """Few pairs are linked across cells, most of them by vectors that are no probes: every pair is compared."""
    monkeypatch.setattr(clusters, "CELL_ROWS", 40)
    monkeypatch.setattr(blocks, "LEAST_PART", 50, raising=False)
    monkeypatch.setattr(clusters, "PROBES", 20, raising=False)
    rng = np.random.default_rng(12)
    walk = np.cumsum(rng.normal(size=(900, 24)) * 0.35, axis=0) + rng.normal(size=24)  # a long chain, linked from step to step
    x = np.concatenate([walk, *(rng.normal(size=24) + 0.5 * rng.normal(size=(6, 24)) for _ in range(120))]).astype(np.float32)
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1))[:, None]
    label = clusters.merge(np.arange(len(x)), *np.nonzero(unit @ unit.T >= 0.75))
    size = np.bincount(label, minlength=len(x))
    want = {(int(c), i) for i, c in enumerate(label) if size[c] >= 5}
    cache = spark.createDataFrame([(i, "m", row.tolist(), 24) for i, row in enumerate(x)], "cache_id long, model_version string, vector array<float>, dim int")
    assert len({c for c, _ in want}) > 20
    assert {(r.cluster_key, r.cache_id) for r in clusters.similarity_clusters(cache).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_every_two_blocks_meet_once(n):
    met = [frozenset((i, j)) for i in range(n) for j in blocks.half_circle(i, n)]
    assert len(met) == len(set(met)) == n * (n - 1) // 2


def test_mixture_is_fitted_on_all_vectors(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(blocks, "MOST_SAMPLE", 100)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in np.eye(8)[:3]]).astype(np.float32)
    cache = spark.createDataFrame([(i, "m", row.tolist(), 8) for i, row in enumerate(x)], "cache_id long, model_version string, vector array<float>, dim int")
    ready = blocks.prepared(cache)
    model = clusters._models(ready, blocks.groups_of(ready))[0]
    unit = unit_rows(x).astype(np.float64)
    assert np.allclose(model.mean, unit.mean(0), atol=1e-6) and np.allclose(model.scale, unit.std(0), atol=1e-6)
