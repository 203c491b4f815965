"""Routed block comparison of vectors: shared by the neighbour search and the clustering.

A *router* (k-means tree or Gaussian mixture) is fitted and broadcast; its size is bounded by its number of cells. Every vector has one
home cell. In the neighbour search it visits, as a query, further cells within a calibrated gap; in the clustering it meets all others. The vectors are written once to the shared folder, by home cell, in files of at most ``BLOCK_MEMBERS``
rows; a task takes at most ``BLOCK_QUERIES`` rows of a cell and reads the files of the cells they visit, one at a time. So a
vector is on disk twice, however many cells it visits: visits cost reading, not space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kmtree import unit_rows

BLOCK_MEMBERS = 8192
BLOCK_QUERIES = 32768
LEAST_PART, PARTS = 1024, 24  # rows of a block at least, and blocks of a group, where every pair is compared
FOLD_ROWS = 500_000  # of frames in a task, from which on they are drawn together
SAMPLE_ROWS = 40_000
MOST_SAMPLE = 131_072  # bound of a grown sample
CELL_POINTS = 16  # of the sample, for each cell
PROBES = 400


def valid_vectors(cache: DataFrame) -> DataFrame:
    """(mv int, model_version, id, dim, vec binary, copy_key): the valid vectors of the cache.

    Valid: not null, ``dim`` elements, no null, NaN or infinite element, not all zero. ``vec`` holds the
    elements as they are, in two bytes each where all of a vector are half-precision numbers, else in four; ``copy_key`` is a hash of the direction rounded to 7 decimals, so vectors
    that share it have a cosine of 1 to 9 decimals.
    """
    src = cache.select(
        "model_version", F.col("cache_id").cast("long").alias("id"), F.col("dim").cast("int").alias("dim"), "vector"
    ).where(F.col("vector").isNotNull() & F.col("id").isNotNull() & (F.size("vector") == F.col("dim")) & (F.col("dim") > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)  # a null element becomes NaN
            start = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = flat[start[rows][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                rows, x = rows[good], np.ascontiguousarray(x[good])
                if not len(rows):
                    continue
                u = x.astype(np.float64)
                u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
                q = np.round(u * 1e7).astype(np.int64) + 0
                weight = np.random.default_rng(11).integers(-(1 << 62), 1 << 62, dim, dtype=np.int64) | 1
                with np.errstate(over="ignore"):
                    key = (q * weight).sum(1)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("model_version").take(take),
                        batch.column("id").take(take),
                        batch.column("dim").take(take),
                        packed(x),
                        pa.array(key),
                    ],
                    names=["model_version", "id", "dim", "vec", "copy_key"],
                )

    return src.mapInArrow(pack, "model_version string, id long, dim int, vec binary, copy_key long")


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a float32 matrix as bytes, of half precision where that loses nothing."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    whole, short = x.tobytes(), half.tobytes()
    wide, narrow = 4 * x.shape[1], 2 * x.shape[1]
    return pa.array([short[i * narrow : (i + 1) * narrow] if same else whole[i * wide : (i + 1) * wide] for i, same in enumerate((half == x).all(1))], pa.binary())


def matrix(column: pa.Array | pa.ChunkedArray | pd.Series | list, dim: int) -> np.ndarray:
    """The float32 matrix of which ``packed`` has made the column."""
    values = column.to_pylist() if hasattr(column, "to_pylist") else list(column)
    data = b"".join(values)
    for kind in (np.float16, np.float32):
        if len(data) == np.dtype(kind).itemsize * dim * len(values):
            return np.frombuffer(data, kind).reshape(-1, dim).astype(np.float32)
    return np.stack([np.frombuffer(v, np.float16 if len(v) == 2 * dim else np.float32).astype(np.float32) for v in values])


def groups_of(vectors: DataFrame) -> pd.DataFrame:
    """One row per (model_version, dim) with its number of rows; their number doesn't grow with the data."""
    return vectors.groupBy("model_version", "dim").agg(F.count(F.lit(1)).alias("rows")).toPandas().sort_values(["model_version", "dim"], ignore_index=True)


def sample_size(cells: int, points: int = CELL_POINTS) -> int:
    """Rows a router of ``cells`` cells is fitted on: ``points`` for each cell, within bounds."""
    return min(MOST_SAMPLE, max(SAMPLE_ROWS, points * cells))


def _drawn(vectors: DataFrame, groups: pd.DataFrame, wanted: list[int], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, raw vectors) of about ``wanted`` rows of each group, chosen by a 63-bit hash of the id in one scan; never more than twice as many."""
    keep = F.lit(False)
    share = [min(1.0, w / max(1, int(g.rows))) for w, g in zip(wanted, groups.itertuples())]
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)
    for part, g in zip(share, groups.itertuples()):
        mine = F.col("model_version").eqNullSafe(F.lit(g.model_version)) & (F.col("dim") == int(g.dim))
        keep = keep | (mine & (draw < int(part * (1 << 63))) if part < 1 else mine)
    got = vectors.where(keep).select("model_version", "dim", "id", "vec").limit(2 * sum(wanted) + 1000).toPandas()
    index = index_of(groups)
    code = np.array([index[m, int(d)] for m, d in zip(got["model_version"], got["dim"])], np.int64)
    out = []
    for i, g in enumerate(groups.itertuples()):
        part = got[code == i].sort_values("id", kind="stable").iloc[: 2 * wanted[i] + 1000]
        out.append((part["id"].to_numpy(), matrix(part["vec"], int(g.dim))))
    return out


def sample_of(vectors: DataFrame, groups: pd.DataFrame, wanted: list[int]) -> list[np.ndarray]:
    """About ``wanted`` raw vectors of each group, or all; the same at every run."""
    return [raw for _, raw in _drawn(vectors, groups, wanted, 1)]


def probes_of(vectors: DataFrame, groups: pd.DataFrame, most: int = PROBES) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, raw vectors) of the held-out probe queries of each group, another hash than the sample's."""
    return _drawn(vectors, groups, [most] * len(groups), 5)


def index_of(groups: pd.DataFrame) -> dict[tuple[str | None, int], int]:
    return {(m, int(d)): i for i, (m, d) in enumerate(zip(groups.model_version, groups.dim))}


def by_group(batch: pa.RecordBatch, index: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group number, ids, raw vectors, unit vectors) of the parts of a batch."""
    for g, rows, raw in _parts(batch, index):
        yield g, batch.column("id").to_numpy(zero_copy_only=False)[rows], raw, unit_rows(raw)


def _parts(batch: pa.RecordBatch, index: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(group number, rows, raw vectors) of the parts of a batch."""
    dims = batch.column("dim").to_pylist()
    code = np.array([index[k] for k in zip(batch.column("model_version").to_pylist(), dims)], np.int64)
    for g in np.unique(code):
        rows = np.flatnonzero(code == g)
        yield int(g), rows, matrix(batch.column("vec").take(pa.array(rows)), dims[rows[0]])


def _block(uri: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, raw vectors) of a file of the shared folder."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        table = pq.ParquetFile(file).read(["id", "vec"])
    return table.column("id").to_numpy(), matrix(table.column("vec"), dim)


def _by_cell(vectors: DataFrame, shared, groups: pd.DataFrame) -> tuple[dict[tuple[int, int], list[str]], DataFrame]:
    """The files, by (group number, home cell), to which the vectors are written, and the table they make up; ``shared`` broadcasts (routers, ...)."""
    index = index_of(groups)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, raw in _parts(batch, index):
                cell, take = shared.value[0][g].assign(unit_rows(raw)).astype(np.int32), pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), g, np.int32)), pa.array(cell), batch.column("id").take(take), batch.column("vec").take(take)], names=["g", "cell", "id", "vec"])

    # a rebalanced cell of many rows is split among tasks, and small ones share one
    placed = vectors.select("model_version", "dim", "id", "vec").mapInArrow(place, "g int, cell int, id long, vec binary").hint("rebalance", "g", "cell")
    files: dict[tuple[int, int], list[str]] = {}
    for uri in sorted((written := materialize(placed, ["g", "cell"], BLOCK_MEMBERS)).inputFiles()):
        g, cell = (int(part.split("=")[1]) for part in uri.split("/")[-3:-1])
        files.setdefault((g, cell), []).append(uri)
    return files, written


def meet(vectors: DataFrame, routers: list, groups: pd.DataFrame, margins: list[float], kernel: Callable, schema: str, fold: Callable) -> DataFrame:
    """``kernel(g, query ids, query vectors, member ids, member vectors)`` on the blocks; its frames have ``schema``.

    Every (query, member) pair of which the query visits the member's home cell meets once, and all visits of a
    query are in one task, so ``fold`` can already draw the frames of a task together to what is needed of them.
    """
    spark = vectors.sparkSession
    dims = [int(d) for d in groups.dim]
    shared = spark.sparkContext.broadcast((routers, margins))
    files, _ = _by_cell(vectors, shared, groups)
    step = max(1, BLOCK_QUERIES // BLOCK_MEMBERS)
    tasks = [(g, some[i : i + step]) for (g, _), some in files.items() for i in range(0, len(some), step)]
    listed = spark.sparkContext.broadcast((files, tasks))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (routers, margins), (files, tasks) = shared.value, listed.value
        for batch in batches:
            for n in batch.column(0).to_pylist():
                g, own = tasks[n]
                ids, raw = (np.concatenate(x) for x in zip(*(_block(uri, dims[g]) for uri in own)))
                q, cell, _ = routers[g].route(unit_rows(raw), margins[g])
                order = np.argsort(cell, kind="stable")
                q, cell = q[order], cell[order]
                start = np.flatnonzero(np.diff(cell, prepend=-1))
                found, rows = [], 0
                for s, e in zip(start, [*start[1:], len(cell)]):
                    qid, query = ids[q[s:e]], raw[q[s:e]]
                    for uri in files.get((g, int(cell[s])), ()):
                        found.append(kernel(g, qid, query, *_block(uri, dims[g])))
                        rows += len(found[-1])
                        if rows > FOLD_ROWS:
                            found, rows = [fold(pd.concat(found))], 0
                yield pa.RecordBatch.from_pandas(fold(pd.concat(found)), preserve_index=False)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(work, schema)


def meet_all(vectors: DataFrame, routers: list, groups: pd.DataFrame, kernel: Callable, schema: str, fold: Callable) -> DataFrame:
    """``kernel`` as in ``meet``, on every pair of vectors of a group: each meets at least once, as query and member or the other way round.

    The vectors of neighbouring home cells make up blocks of at most about ``BLOCK_QUERIES`` rows, and of a share of the group that
    keeps all cores busy. A task takes a block and reads one after the other, itself first, half of the others in a circle.
    """
    spark = vectors.sparkSession
    dims = [int(d) for d in groups.dim]
    files, written = _by_cell(vectors, spark.sparkContext.broadcast((routers, None)), groups)
    rows = {(r.g, r.cell): r["count"] / len(files[r.g, r.cell]) for r in written.groupBy("g", "cell").count().collect()}
    parts: dict[int, list[list[str]]] = {}
    for g, n in enumerate(groups["rows"]):
        most, held = min(BLOCK_QUERIES, max(LEAST_PART, n // PARTS)), 0.0
        for key in sorted(k for k in files if k[0] == g):
            for uri in files[key]:
                if g not in parts or held + rows[key] > most:
                    parts.setdefault(g, []).append([])
                    held = 0.0
                parts[g][-1].append(uri)
                held += rows[key]
    tasks = [(g, i) for g, some in parts.items() for i in range(len(some))]
    listed = spark.sparkContext.broadcast((parts, tasks))

    def whole(some: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(x) for x in zip(*(_block(uri, dim) for uri in some)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, tasks = listed.value
        for batch in batches:
            for n in batch.column(0).to_pylist():
                g, i = tasks[n]
                some, own = parts[g], whole(parts[g][i], dims[g])
                found, seen = [kernel(g, *own, *own)], 0
                for other in half_circle(i, len(some)):
                    found.append(kernel(g, *own, *whole(some[other], dims[g])))
                    seen += len(found[-1])
                    if seen > FOLD_ROWS:
                        found, seen = [fold(pd.concat(found))], 0
                yield pa.RecordBatch.from_pandas(fold(pd.concat(found)), preserve_index=False)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(work, schema)


def half_circle(i: int, n: int) -> list[int]:
    """The others that number ``i`` of ``n`` in a circle meets, so that every two meet once."""
    return [(i + step) % n for step in range(1, n // 2 + 1) if 2 * step < n or i < n // 2]


def scan_probes(vectors: DataFrame, groups: pd.DataFrame, routers: list, probes: list, kernel: Callable, schema: str) -> DataFrame:
    """``kernel(g, probe ids, probe vectors, probe gaps, ids, vectors, home cells)`` on every batch of all vectors."""
    spark = vectors.sparkSession
    index = index_of(groups)
    gaps = [r.gaps(unit_rows(p[1])) if len(p[0]) else np.zeros((0, 1), np.float32) for r, p in zip(routers, probes)]
    shared = spark.sparkContext.broadcast((routers, probes, gaps))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routers, probes, gaps = shared.value
        for batch in batches:
            for g, ids, raw, unit in by_group(batch, index):
                if len(probes[g][0]):
                    frame = kernel(g, probes[g][0], probes[g][1], gaps[g], ids, raw, routers[g].assign(unit))
                    if len(frame):
                        yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return vectors.mapInArrow(scan, schema)


def prepared(cache: DataFrame) -> DataFrame:
    """The valid vectors, written once: sampling, calibration and comparison read them again."""
    return materialize(valid_vectors(cache))
