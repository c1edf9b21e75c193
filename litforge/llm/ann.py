"""Nearest neighbours by inner product over shifted Hilbert curves.

Each of CURVES curves projects the vectors on a random orthonormal frame, shifts
them, and orders them along a Hilbert curve.  A curve's keys are cut at their
quantiles into BLOCKS blocks; a row is a candidate in its own block and a query
in that block and its two neighbours.  Every task ranks its candidates for its
queries exactly, in double precision, and the lists of all curves are merged.

The index covers all rows.  Blocks that outgrow a task are split by id, and the
queries go to every part, so a common vector costs more tasks, not a longer one.
Vectors without any structure need wide windows: see the README for the recall
measured against all pairs.

Cases: vectors that are null, empty, zero, of another length than the first
valid one, or hold null or non-finite components take no part; rows without an
id neither; ties go to the smaller id; equal vectors are distinct candidates;
with fewer candidates than wanted all are given; an empty table gives no rows; rows
that repeat an id all take part, each pair of ids counts once with its best score,
and no row finds its own id; columns other than the id and the vector are dropped,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litforge.session import materialize, table

#: Production parameters.
NEIGHBOURS = 20
CURVES = 16
#: Blocks of a curve for ROWS rows; that share of rows to the power GROWTH gives them for more.
BLOCKS = 32
ROWS = 10_000
GROWTH = 0.25
PROJECTED = 6
BITS = 8
#: A block has so many rows at least, on average, and a part of one so many at most; a merging task has so many queries.
MIN_ROWS = 64
TASK_ROWS = 20_000
TASK_QUERIES = 2_000
SEED = 20240501

_PACKED = pa.schema([("part", pa.int64()), ("role", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = np.dtype([("query", "<i8"), ("vec", "<i8"), ("score", "<f8")])


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point of a grid of ``bits`` bits an axis along the Hilbert curve.

    Bit planes from the highest down undo the curve's reflections and swaps of
    axes; a Gray code then orders the cells of each plane.
    """
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    for plane in range(bits - 1, 0, -1):
        bit, below = np.int64(1) << plane, (np.int64(1) << plane) - 1
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for plane in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> plane) & 1 == 1, (np.int64(1) << plane) - 1, 0)
    key = np.zeros_like(x[0])
    for plane in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> plane) & 1)
    return key


def frames(width: int, curves: int = CURVES, projected: int = PROJECTED, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal frames side by side, and a shift in (0, 1) for each axis."""
    rng = np.random.default_rng(seed)
    projected = min(projected, width)
    q = [np.linalg.qr(rng.standard_normal((width, projected)))[0] for _ in range(curves)]
    return np.concatenate(q, axis=1), rng.random(curves * projected)


def _once(r: np.ndarray) -> np.ndarray:
    """The best row of each pair, by query, then best first."""
    r = r[np.lexsort((-r["score"], r["vec"], r["query"]))]
    new = np.ones(len(r), bool)
    new[1:] = (r["query"][1:] != r["query"][:-1]) | (r["vec"][1:] != r["vec"][:-1])
    r = r[new]
    return r[np.lexsort((r["vec"], -r["score"], r["query"]))]


def _vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy()
    return ids, batch.column(1).flatten().to_numpy().astype(np.float64).reshape(len(ids), width)


def _keys(x: np.ndarray, frame: np.ndarray, shift: np.ndarray, low: np.ndarray, span: np.ndarray, curves: int) -> list[np.ndarray]:
    top = (1 << BITS) - 1
    # A shift by up to half the range moves every cell border of the curve.
    place = ((x @ frame - low) / span + shift / 2) / 1.5
    grid = np.clip(place * (top + 1), 0, top).astype(np.int64)
    return [hilbert_keys(part) for part in np.split(grid, curves, axis=1)]


def valid_vectors(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("embedding"))


def _best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` best candidates of each query; products of equal vectors are equal to the last bit."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    # An id may stand there several times, and only its best row counts.
    most = count * int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else count
    out = []
    for at in range(0, len(queries), 256):
        rough = queries[at : at + 256] @ x.T
        for i, row in enumerate(rough):
            own = int(query_ids[at + i])
            row[ids == own] = -np.inf
            if len(row) > most:
                least = np.partition(row, len(row) - most)[len(row) - most]
                chosen = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
            else:
                chosen = np.arange(len(row))
            chosen = chosen[row[chosen] > -np.inf]
            score = (x[chosen] * queries[at + i]).sum(axis=1)
            best = np.lexsort((ids[chosen], -score))
            if len(best) > count:  # of an id that stands there again the best one counts
                best = best[np.sort(np.unique(ids[chosen][best], return_index=True)[1])][:count]
            r = np.empty(len(best), FOUND)
            r["query"], r["vec"], r["score"] = own, ids[chosen][best], score[best]
            out.append(r)
    return np.concatenate(out) if out else np.empty(0, FOUND)


def nearest(vectors: DataFrame, every: int = 20, count: int = NEIGHBOURS, curves: int = CURVES, blocks: int = BLOCKS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid_vectors(vectors)
    one = rows.orderBy("vec_id").limit(1).select(F.size("embedding")).first()
    if one is None:
        return empty
    width = one[0]
    rows = rows.filter(F.size("embedding") == width)
    # Single precision travels as such; all sums are in double precision.
    kind = np.dtype("<f4") if "array<float>" in dict(vectors.dtypes)["embedding"] else np.dtype("<f8")
    frame, shift = frames(width, curves)

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = _vectors(batch, width)[1] @ frame
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(y.shape[1])), pa.array(y.min(axis=0)), pa.array(y.max(axis=0)), pa.array(np.full(y.shape[1], len(y)))], names=["axis", "low", "high", "n"])

    sizes = rows.mapInArrow(extent, "axis long, low double, high double, n long").groupBy("axis").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("axis").collect()
    low = np.array([r.low for r in sizes])
    span = np.maximum(np.array([r.high for r in sizes]) - low, 1e-12)
    total = sizes[0].n
    blocks = max(1, min(round(blocks * max(1.0, total / ROWS) ** GROWTH), total // MIN_ROWS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(_vectors(batch, width)[1], frame, shift, low, span, curves)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(curves), len(batch))), pa.array(np.concatenate(keys))], names=["curve", "key"])

    shares = [i / blocks for i in range(1, blocks)] or [0.5]
    cuts = rows.mapInArrow(keyed, "curve long, key long").groupBy("curve").agg(F.percentile_approx("key", shares, 10_000).alias("cuts")).collect()
    borders = {r.curve: np.array(r.cuts[: blocks - 1], np.int64) for r in cuts}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(curves * blocks, np.int64)
        for batch in batches:
            for c, key in enumerate(_keys(_vectors(batch, width)[1], frame, shift, low, span, curves)):
                n += np.bincount(np.searchsorted(borders[c], key, side="right") + c * blocks, minlength=curves * blocks)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(curves * blocks)), pa.array(n)], names=["block", "n"])

    # A row per block: equal keys can't be cut apart, so blocks differ in size.
    sizes = np.zeros(curves * blocks, np.int64)
    for r in rows.mapInArrow(counted, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        sizes[r.block] = r.n
    parts = np.maximum(1, -(-sizes // TASK_ROWS))
    base = np.concatenate(([0], np.cumsum(parts)[:-1]))
    merges = max(64, total // every // TASK_QUERIES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, x = _vectors(batch, width)
            asks = np.flatnonzero(ids % every == 0)
            split = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            where, role, index = [], [], []
            for c, key in enumerate(_keys(x, frame, shift, low, span, curves)):
                block = np.searchsorted(borders[c], key, side="right") + c * blocks
                where.append(base[block] + split % parts[block])
                role.append(np.zeros(len(ids), np.int32))
                index.append(np.arange(len(ids)))
                for step in (-1, 0, 1):
                    near = block[asks] + step
                    inside = asks[near // blocks == c]
                    near = near[near // blocks == c]
                    times = parts[near]
                    ends = np.cumsum(times)
                    where.append(np.repeat(base[near], times) + np.arange(times.sum()) - np.repeat(ends - times, times))
                    role.append(np.ones(int(times.sum()), np.int32))
                    index.append(np.repeat(inside, times))
            where, role, index = np.concatenate(where), np.concatenate(role), np.concatenate(index)
            order = np.lexsort((role, where))
            where, role, index = where[order], role[order], index[order]
            bounds = np.concatenate(([0], np.flatnonzero((np.diff(where) != 0) | (np.diff(role) != 0)) + 1, [len(where)]))
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(where[bounds[:-1]]), pa.array(role[bounds[:-1]]), pa.array([ids[index[a:b]].tobytes() for a, b in spans], pa.binary()), pa.array([x[index[a:b]].astype(kind).tobytes() for a, b in spans], pa.binary())], schema=_PACKED)

    def rank(t: pa.Table) -> pa.Table:
        role = t.column("role").to_numpy()
        side = []
        for r in (0, 1):
            part = t.filter(pa.array(role == r))
            side.append(np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int64))
            side.append(np.frombuffer(b"".join(part.column("vectors").to_pylist()), kind).astype(np.float64).reshape(-1, width))
        found = _best(*side, count) if len(side[0]) and len(side[2]) else np.empty(0, FOUND)
        found = found[np.argsort(found["query"] // every % merges, kind="stable")]
        part = found["query"] // every % merges
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, int)
        return pa.table({"part": pa.array(part[bounds[:-1]]), "data": pa.array([found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())})

    ranked = rows.mapInArrow(deal, "part long, role int, ids binary, vectors binary").groupBy("part").applyInArrow(rank, "part long, data binary")

    def merge(t: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(t.column("data").to_pylist()), FOUND)
        r = _once(r)
        first = np.flatnonzero(np.concatenate(([True], r["query"][1:] != r["query"][:-1])))
        place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) + 1
        r, place = r[place <= count], place[place <= count]
        return pa.table({"query_id": pa.array(r["query"].copy()), "rank": pa.array(place.astype(np.int32)), "vec_id": pa.array(r["vec"].copy()), "score": pa.array(r["score"].copy())})

    return materialize(ranked, "ann-ranked").groupBy("part").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op5_nearest": op5_nearest}
ORACLE_SQL: dict[str, str] = {}
