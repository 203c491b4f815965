"""Clusters of embedded reviews: assembly, typical members, ranking, fallback, density labels, silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance

NOISE = -1


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct keys not in the cache; rows with a null key cannot be embedded and are left out."""
    known = wanted.select(*keys).dropna().distinct()
    return known.join(cache.select(*keys).dropna(), keys, "left_anti")


def embed_with_cache(texts: DataFrame, cache: DataFrame, model_version: str, embed=None) -> tuple[DataFrame, DataFrame]:
    """(vectors, fresh): a vector for each distinct ``text_hash`` of ``texts`` (text_hash, text), and the rows to append to the cache.

    Only hashes that the cache (model_version, text_hash, vector) lacks under this model are embedded, each once, by ``embed(texts, key, text)``;
    the built-in one hashes tokens. Rows with a null hash get no vector.
    """
    known = cache.where((F.col("model_version") == model_version) & F.col("vector").isNotNull()).groupBy("text_hash").agg(F.min_by("vector", "created_at").alias("vector"))
    distinct = texts.where("text_hash is not null").groupBy("text_hash").agg(F.min("text").alias("text"))
    misses = distinct.join(known, "text_hash", "left_anti")
    new = (embed or hashed_embedding)(misses, "text_hash", "text").select("text_hash", F.col("vector").cast("array<float>").alias("vector"))
    fresh = new.select(F.lit(model_version).alias("model_version"), "text_hash", "vector", F.current_timestamp().alias("created_at"))
    old = known.join(distinct, "text_hash", "left_semi").select("text_hash", F.col("vector").cast("array<float>").alias("vector"))
    return old.unionByName(new), fresh


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Cache and fresh rows, the latest by ``at`` of each key; ``fresh`` wins at the same time."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    rest = [c for c in cache.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, "_new")).alias("_row"))
    return last.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in cache.columns])


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid, size): mean vectors by partial sums of whole vectors, without exploding them."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return rows.where(F.col(label) != NOISE).groupBy(label).agg(vector_to_array(mean).alias("centroid"), F.count(F.lit(1)).alias("size"))


def nearest_to_centroid(rows: DataFrame, key: str, label: str, vector: str, n: int = 5) -> DataFrame:
    """(label, rank, key, distance) of the ``n`` members of each cluster nearest to its centroid, ties by key."""
    far = rows.where(F.col(label) != NOISE).join(centroids(rows, label, vector), label).withColumn("distance", cosine_distance(F.col(vector), F.col("centroid")))
    near = far.select(label, key, F.round("distance", 9).alias("distance"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("distance", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= n)


def rating_histogram(members: DataFrame, label: list[str], rating: str) -> DataFrame:
    """(label, rating, n), null ratings left out."""
    return members.where(F.col(rating).isNotNull()).groupBy(*label, rating).agg(F.count(F.lit(1)).alias("n"))


def noise_ratio(rows: DataFrame, label: str, limit: float = 0.8) -> DataFrame:
    """(n, n_noise, ratio, fallback): whether too much is noise or nothing is clustered."""
    noise = F.count_if(F.col(label) == NOISE)
    ratio = noise / F.greatest(F.count(F.lit(1)), F.lit(1))
    return rows.agg(F.count(F.lit(1)).alias("n"), noise.alias("n_noise"), ratio.alias("ratio"), ((ratio > limit) | (F.count_if(F.col(label) != NOISE) == 0)).alias("fallback"))


def rating_buckets(reviews: DataFrame, least: int, key: str = "seq", rating: str = "rating", at: str = "posted_at", n: int = 5) -> DataFrame:
    """(bucket, rank, key, size): the ``n`` latest of the ratings 1-2, 3 and 4-5, for buckets of ``least`` rows or more."""
    r = F.col(rating)
    bucket = F.when(r <= 2, 0).when(r == 3, 1).when(r >= 4, 2)
    rows = reviews.select(F.col(key), F.col(at), bucket.alias("bucket")).where("bucket is not null")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc(at), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n).join(sizes, "bucket").select("bucket", "rank", key, "size")


def score(size: Column, average: Column, weight: float = 0.4) -> Column:
    """Large and badly rated clusters first; a missing average counts as the best rating."""
    return size * (1 + F.lit(weight) * (5 - F.coalesce(average, F.lit(5.0))))


def top_clusters(clusters: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """The ``k`` best clusters, of each group ``by`` if given; ties to the smaller cluster_id."""
    scored = clusters.withColumn("score", score(F.col("size"), F.col("avg_rating")))
    if not by:
        return scored.orderBy(F.desc("score"), "cluster_id").limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "cluster_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def assembled(members: DataFrame, by: list[str], key: str, rating: str) -> DataFrame:
    """(by, size, avg_rating) of each cluster. Members stay rows; nest them only where a cluster is known to be small."""
    return members.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.avg(rating).alias("avg_rating"), F.min(key).alias("first_member"))


def reduced(rows: DataFrame, vector: str, k: int = 15) -> DataFrame:
    """``rows`` with ``reduced``: the first ``k`` principal components, or the vector itself where there is nothing to reduce."""
    head = rows.select(F.size(vector).alias("d")).first()
    if head is None or head["d"] <= k or rows.limit(k + 1).count() <= k:
        return rows.withColumn("reduced", F.col(vector).cast("array<double>"))
    as_vector = rows.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(as_vector)
    return model.transform(as_vector).withColumn("reduced", vector_to_array("_p")).drop("_v", "_p")


def density_labels(rows: DataFrame, by: list[str], key: str, vector: str, most_rows: int = 4000) -> DataFrame:
    """(by, key, label): density clusters of each group by the hierarchy of mutual reachability, noise -1.

    A group is one analysis run, whose size is bounded by ingestion; a group above ``most_rows`` is refused with an
    error rather than cut. Clusters have at least max(5, n // 20) members. Groups smaller than that are all noise.
    """
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in by], f"{key} {types[key]}", "label int"])

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > most_rows:
            raise ValueError(f"a group has {len(frame)} rows, more than {most_rows}")
        frame = frame.sort_values(key)
        x = np.stack(frame[vector].to_numpy()).astype(float)
        return frame[[*by, key]].assign(label=hierarchy_labels(x, max(5, len(x) // 20)).astype("int32"))

    return rows.select(*by, key, vector).groupBy(*by).applyInPandas(label, schema)


def hierarchy_labels(x: np.ndarray, least: int) -> np.ndarray:
    """Labels by excess of mass in the condensed tree of the minimum spanning tree of mutual reachability."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, NOISE)
    square = (x * x).sum(1)
    dist = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0))
    core = np.sort(dist, 1)[:, min(least, n - 1)]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], link[closer] = reach[at][closer], at
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    # single-linkage merges; node ids from n on
    top = np.arange(2 * n - 1)
    size, kids, height = np.ones(2 * n - 1, int), {}, np.zeros(2 * n - 1)

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for k, (w, a, b) in enumerate(sorted(edges)):
        a, b = root(a), root(b)
        kids[n + k], size[n + k], height[n + k] = (a, b), size[a] + size[b], w
        top[a] = top[b] = n + k

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v]
        return out

    # condense: a cluster ends where both sides hold enough points
    clusters: list[dict] = []
    todo = [(2 * n - 2, None, 0.0)]
    while todo:
        node, parent, birth = todo.pop()
        me, mass, now = len(clusters), 0.0, node
        clusters.append({"parent": parent, "children": [], "node": node})
        if parent is not None:
            clusters[parent]["children"].append(me)
        while True:
            if now < n:
                break
            lam = 1 / max(height[now], 1e-12)
            a, b = kids[now]
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                mass += (lam - birth) * size[now]
                todo += [(a, me, lam), (b, me, lam)]
                break
            mass += (lam - birth) * sum(size[c] for c in (a, b) if c not in big)
            if not big:
                break
            now = big[0]
        clusters[me]["mass"] = mass
    chosen = [False] * len(clusters)
    value = [0.0] * len(clusters)
    for i in range(len(clusters) - 1, -1, -1):
        below = sum(value[c] for c in clusters[i]["children"])
        if clusters[i]["parent"] is not None and (not clusters[i]["children"] or clusters[i]["mass"] >= below):
            chosen[i], value[i] = True, clusters[i]["mass"]
        else:
            value[i] = below
    out, number = np.full(n, NOISE), 0
    todo = [0]
    while todo:
        i = todo.pop(0)
        if chosen[i]:
            out[leaves(clusters[i]["node"])] = number
            number += 1
        else:
            todo += clusters[i]["children"]
    return out


def silhouette(rows: DataFrame, key: str, label: str, vector: str, sample: int = 200) -> DataFrame:
    """(n, silhouette) over at most ``sample`` rows, the first in the order of the md5 of the key; noise is a label.

    The sample is the feature here: its pairs are compared in one task. Null with fewer than two labels.
    """
    some = rows.select(key, label, vector).orderBy(F.md5(F.col(key).cast("string")), key).limit(sample)

    def judge(frames):
        parts = list(frames)
        frame = pd.concat(parts) if parts else pd.DataFrame({label: [], vector: []})
        labels = frame[label].to_numpy()
        kinds = np.unique(labels)
        if len(kinds) < 2:
            yield pd.DataFrame({"n": [len(frame)], "silhouette": [None]})
            return
        x = np.stack(frame[vector].to_numpy()).astype(float)
        d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0))
        own = np.stack([d[:, labels == k].sum(1) for k in kinds], 1)
        count = np.array([(labels == k).sum() for k in kinds])
        mine = np.searchsorted(kinds, labels)
        a = own[np.arange(len(x)), mine] / np.maximum(count[mine] - 1, 1)
        other = own / count
        other[np.arange(len(x)), mine] = np.inf
        b = other.min(1)
        s = np.where(count[mine] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
        yield pd.DataFrame({"n": [len(x)], "silhouette": [float(s.mean())]})

    return some.coalesce(1).mapInPandas(judge, "n long, silhouette double")


def hashed_embedding(texts: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(key, vector): unit vectors of hashed token counts, the built-in embedder; no model and no second pass."""
    from pyspark.ml.feature import HashingTF, Normalizer

    from ..functions.text import tokens

    counted = HashingTF(numFeatures=dims, inputCol="_t", outputCol="_c").transform(texts.select(key, F.coalesce(tokens(F.lower(F.col(text))), F.array().cast("array<string>")).alias("_t")))
    return Normalizer(inputCol="_c", outputCol="_n").transform(counted).select(key, vector_to_array("_n", "float32").alias("vector"))
