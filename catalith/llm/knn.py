"""The k most similar vectors for every query vector, by collision-counting hashing.

Vectors are scaled to length one and projected onto ``m`` single directions.  Directions (leading principal ones) and
the representatives of cells are fitted on a bounded sample of at most ``SAMPLE`` rows; every row is indexed.  A point
belongs to the cell of the representative nearest to it, and inside a cell each projection keeps its own sorted array.
Then, for a query:

* in its own cell (or the nearest ones that together hold ``HOME`` times k vectors) a window opens around its projection in every array, and a vector that falls into enough windows
  (``THRESHOLD`` of the ``m``) is verified by its exact cosine; virtual rehashing widens all windows together, without
  building anything new, until the k-th verified vector lies within the radius the windows stand for;
* the distance of that k-th vector is the radius the query still needs: in the ``PROBES`` cells that are next nearest
  its windows are opened once, as wide as that, and what collides and is as near is verified.

The half-width for a radius R is ``WIDTH * R / sqrt(dim)``: the projected difference of two vectors at distance R has
a deviation of about R / sqrt(dim) on each direction.  Cells keep their size as the points grow: where the sample
carries fewer than are needed, its cells are regions, each split on the executors into cells of about ``CELL`` points,
fitted on a sample of the region.  A vector is placed by region and then by cell, a query looks for its nearest cells
in the ``NEAR_REGIONS`` nearest regions.  So what a query costs is the points of the cells it reaches, a smaller share
the more there are.  What comes to the driver is a representative and the number of points and queries of each cell.

Cells larger than two blocks (copies of one vector, or very many points) are split by a hash, and so are the queries of
a cell: one task handles one block of points and one of queries, whatever repeats.  Each gives at most k points a
query; a point found in several blocks keeps its best similarity before the best k are taken.  A query that finds
fewer than k points there is compared with all.

Cases: vectors that are null, all zero, of another length or not finite neither ask nor answer.  A point with several
vectors counts by its best one.  Equal similarities go to the smaller id.  Fewer than k usable points give fewer rows,
no usable point or query an empty table.  A repeated query id is answered once, by the best of its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.runtime import cut

SAMPLE = 20_000  # rows the directions are fitted on, at most
CELL, LEAST_SAMPLED = 512, 16  # points in a cell, and vectors of the sample for a representative, about
PROBES, TURNS = 8, 6  # cells a query is looked for in beside its own; turns in which representatives settle
NEAR_REGIONS, HOME = 36, 4  # regions whose cells a query is compared with; vectors it needs around it at first, times k
POINT_BLOCK, QUERY_BLOCK = 2_048, 8_192  # vectors in a block, about
DIRECTIONS = 24
THRESHOLD = 0.875  # share of the windows a vector has to fall into
WIDTH = 2.0
FIRST_RADIUS, WIDEN = 0.8, 1.3


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of the usable entries of an array<float> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0)
    return at[good], (x[good] / norm[good, None]).astype(np.float32)


def _unit_rows(df: DataFrame, dim: int) -> DataFrame:
    """(id string, vec binary) of the usable vectors of (id, vec array<float>)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _usable(b.column(1), dim)
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in x], pa.binary())], ["id", "vec"])

    return df.mapInArrow(pack, f"id {df.dtypes[0][1]}, vec binary")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """The packed vectors of a column as one matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _nearest(x: np.ndarray, representatives: np.ndarray) -> np.ndarray:
    parts = [(x[k : k + 4096] @ representatives.T).argmax(axis=1) for k in range(0, len(x), 4096)]
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32)


def _most(values: np.ndarray, n: int) -> np.ndarray:
    """The places of the n greatest values, these first; of equal ones the first."""
    best = np.sort(np.argpartition(-values, n - 1)[:n]) if n < len(values) else np.arange(len(values))
    return best[np.argsort(-values[best], kind="stable")]


class Index(NamedTuple):
    """Directions of the sorted arrays, and the representatives of the cells; of regions too, where the cells are many."""

    centre: np.ndarray
    directions: np.ndarray
    representatives: np.ndarray
    regions: np.ndarray | None = None
    starts: np.ndarray | None = None  # the first cell of each region, and the end

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre) @ self.directions

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        if self.regions is None:
            return _nearest(x, self.representatives)
        region = _nearest(x, self.regions)
        order, out = np.argsort(region, kind="stable"), np.zeros(len(x), np.int32)
        for at in np.split(order, np.flatnonzero(np.diff(region[order])) + 1) if len(x) else []:
            first, end = self.starts[region[at[0]]], self.starts[region[at[0]] + 1]
            out[at] = first + (x[at] @ self.representatives[first:end].T).argmax(axis=1)
        return out

    def near_cells(self, x: np.ndarray, held: np.ndarray, needed: int) -> Iterator[np.ndarray]:
        """The cells that hold points nearest to each vector, the nearest first: NEAR_REGIONS of them, or all where those hold fewer than needed."""
        known = np.flatnonzero(held)  # of the others no point is nearest
        of_known = self.representatives[known]
        by_region = None if self.regions is None else x @ self.regions.T
        for n, q in enumerate(x):
            if by_region is None:
                cells, similar = known, of_known @ q
            else:
                cells = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in _most(by_region[n], NEAR_REGIONS)])
                cells = cells[held[cells] > 0]
                similar = self.representatives[cells] @ q
            order = cells[_most(similar, NEAR_REGIONS)]
            yield order if held[order].sum() >= needed else known[np.argsort(-(of_known @ q), kind="stable")]


def _settled(x: np.ndarray, cells: int) -> np.ndarray:
    """Representatives of the vectors in so many cells."""
    x = x[np.lexsort(x.T[:4])]  # in an order of its own, whatever order they came in
    out = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(TURNS):
        sums = np.zeros_like(out)
        np.add.at(sums, _nearest(x, out), x)
        norm = np.linalg.norm(sums, axis=1)
        out[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return out


def fit_index(units: DataFrame, dim: int, rows: int, m: int = DIRECTIONS) -> Index:
    """Directions and representatives from a sample of at most SAMPLE unit vectors, taken by a hash of the id."""
    every = max(1, rows // SAMPLE)
    taken = units.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("vec").limit(SAMPLE).toArrow()
    x = _matrix(taken.column("vec"), dim)
    m = min(m, dim)
    if not len(x):
        return Index(np.zeros(dim, np.float32), np.eye(dim, m, dtype=np.float32), np.eye(1, dim, dtype=np.float32))
    centre = x.mean(axis=0, dtype=np.float64)
    _, v = np.linalg.eigh((x - centre).T @ (x - centre))
    cells = max(1, min(rows // CELL, len(x) // LEAST_SAMPLED))
    return Index(centre.astype(np.float32), np.ascontiguousarray(v[:, ::-1][:, :m]).astype(np.float32), _settled(x, cells))


def split_regions(units: DataFrame, dim: int, index: Index) -> Index:
    """The index with its cells as regions, each split into cells of about CELL points on a sample of it of at most SAMPLE vectors, about."""
    every, regions = max(1, CELL // LEAST_SAMPLED), index.representatives

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(_matrix(b.column("vec"), dim)))], [*b.schema.names, "cell"])

    sampled = cut(units.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).mapInArrow(place, "id string, vec binary, cell int"))
    held = {c: n * every for c, n in _counts(sampled).items()}
    further = _of_cell([max(1, math.ceil(held.get(c, 0) / every / SAMPLE)) for c in range(len(regions))])

    def split(a: pa.Table) -> pa.Table:
        region, x = a.column("cell")[0].as_py(), _matrix(a.column("vec"), dim)
        cells = min(math.ceil(held[region] / CELL), len(x) // LEAST_SAMPLED)
        found = _settled(x, cells) if cells > 1 else regions[[region]]
        return pa.table({"region": pa.array([region] * len(found), pa.int32()), "vec": pa.array([v.tobytes() for v in found], pa.binary())})

    taken = sampled.filter(F.pmod(F.xxhash64("vec", "id"), further) == 0).select("cell", "vec")
    found = taken.groupBy("cell").applyInArrow(split, "region int, vec binary").toArrow()
    of, x = np.asarray(found.column("region"), np.int64), _matrix(found.column("vec"), dim)
    missed = np.setdiff1d(np.arange(len(regions)), of)  # regions without a sample stay whole
    of, x = np.concatenate([of, missed]), np.concatenate([x, regions[missed]])
    order = np.lexsort((*x.T[:4], of))
    starts = np.searchsorted(of[order], np.arange(len(regions) + 1))
    return index._replace(representatives=np.ascontiguousarray(x[order]), regions=regions, starts=starts)


def block_neighbours(
    points: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, index: Index, radii: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, similarities) of the k best points of one block for each query, by collision counting.

    With ``radii`` only points as near as that count; without, windows widen until k points are sure, or the block ends.
    """
    n, dim = points.shape
    m = index.directions.shape[1]
    need = math.ceil(THRESHOLD * m)
    projected = index.projected(points).T
    order = np.argsort(projected, axis=1, kind="stable")
    arrays = np.take_along_axis(projected, order, axis=1)  # one sorted array a direction
    asked = index.projected(queries)
    exact, doubled = queries.astype(np.float64), points.astype(np.float64)
    known, number = np.unique(ids, return_inverse=True)
    alone = len(known) == n  # one vector a point

    def colliding(q: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """The points that fall into enough of the windows around each of some queries."""
        half = WIDTH * radius / math.sqrt(dim)
        low = np.stack([a.searchsorted(x - half) for a, x in zip(arrays, asked[q].T)], axis=1)
        high = np.stack([a.searchsorted(x + half, "right") for a, x in zip(arrays, asked[q].T)], axis=1)
        empty = (high <= low).sum(axis=1) > m - need
        return [
            np.zeros(0, np.int64) if none else np.flatnonzero(np.bincount(np.concatenate([o[x:y] for o, x, y in zip(order, a, b)]), minlength=n) >= need)
            for a, b, none in zip(low, high, empty)
        ]

    def ranked(found: np.ndarray, query: np.ndarray, reach: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k best points by exact similarity, each by its best vector, of those within reach."""
        similar = np.round(doubled[found] @ query, 12)
        inside = 2 - 2 * similar <= reach
        found, similar = found[inside], similar[inside]
        best = np.lexsort((number[found], -similar))
        if not alone:
            _, first = np.unique(number[found[best]], return_index=True)
            best = best[np.sort(first)]
        best = best[:k]
        return ids[found[best]], similar[best]

    every = np.arange(len(queries))
    if radii is not None:
        for q, found in zip(every, colliding(every, radii)):
            found = found if radii[q] < 2 else np.arange(n)
            yield ranked(found, exact[q], radii[q] ** 2 + 1e-6)
        return
    results: list = [None] * len(queries)
    radius, left = np.full(len(queries), FIRST_RADIUS), every
    while len(left):
        whole = radius[left] >= 2
        for q, found in zip(left[whole], [np.arange(n)] * int(whole.sum())):
            results[q] = ranked(found, exact[q])
        left = left[~whole]
        again = []
        for q, found in zip(left, colliding(left, radius[left]) if len(left) else []):
            near = ranked(found, exact[q]) if len(found) >= k else ((), ())
            reach = math.sqrt(max(0.0, 2 - 2 * near[1][-1])) if len(near[0]) == k else math.inf  # no point of the k best is farther away
            if reach <= radius[q]:
                results[q] = near
            else:
                radius[q] = min(reach + 1e-6, 2.0) if reach < 2 else radius[q] * WIDEN
                again.append(q)
        left = np.array(again, np.int64)
    yield from results


def _of_cell(figures: list[int]) -> Column:
    """The figure of the cell of a row; one literal, however many cells."""
    return F.get(F.split(F.lit(",".join(map(str, figures))), ",").cast("array<int>"), F.col("cell"))


def _blocks(held: dict[int, int], cells: int, size: int) -> Column:
    """The number of blocks of a row's cell."""
    return _of_cell([max(1, math.ceil(held.get(c, 0) / size)) for c in range(cells)])


def _counts(placed: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row a cell


def _met(points: DataFrame, routed: DataFrame, held: dict[int, int], index: Index, dim: int, k: int) -> DataFrame:
    """(query_id, id, similarity) of the k best of each block of points for the queries (id, vec, cell, radius) routed to its cell."""
    cells = len(index.representatives)
    point_blocks, query_blocks = _blocks(held, cells, 2 * POINT_BLOCK), _blocks(_counts(routed), cells, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    block = lambda n: F.pmod(F.xxhash64("id", "vec"), n).cast("int")
    left = points.select("id", "vec", "cell", block(point_blocks).alias("pb"), every(query_blocks).alias("qb"))
    right = routed.select("id", "vec", "radius", "cell", block(query_blocks).alias("qb"), every(point_blocks).alias("pb"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            radii = None if b.column("radius").null_count else b.column("radius").to_numpy()
            found = block_neighbours(_matrix(a.column("vec"), dim), np.asarray(a.column("id").to_pylist(), object), _matrix(b.column("vec"), dim), k, index, radii)
            for q, (near, similar) in zip(b.column("id").to_pylist(), found):
                for column, values in zip(out, ([q] * len(near), near, similar)):
                    column.extend(values)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.string()), "similarity": pa.array(out[2], pa.float64())})

    return left.groupBy("cell", "pb", "qb").cogroup(right.groupBy("cell", "pb", "qb")).applyInArrow(search, "query_id bigint, id string, similarity double")


def most_similar(points: DataFrame, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """(query_id, id, similarity): the k most similar points of each query.

    ``points``: (id string, vec array<float>), several rows for a point of several vectors; ``queries``: (query_id
    bigint, vec array<float>).
    """
    units = _unit_rows(points.select(F.col("id").cast("string").alias("id"), "vec"), dim)
    rows = points.filter(F.col("vec").isNotNull()).count()
    index = fit_index(units, dim, rows)
    if rows // CELL > len(index.representatives):
        index = split_regions(units, dim, index)
    wanted = _unit_rows(queries.select(F.col("query_id").cast("bigint").alias("id"), "vec"), dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(_matrix(b.column("vec"), dim)))], [*b.schema.names, "cell"])

    placed = units.mapInArrow(place, "id string, vec binary, cell int")
    held = _counts(placed)
    if not held:
        return points.sparkSession.createDataFrame([], "query_id bigint, id string, similarity double")
    number = np.array([held.get(c, 0) for c in range(len(index.representatives))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                chosen = []
                radii = b.column("radius").to_numpy(zero_copy_only=False)
                for radius, order in zip(radii, index.near_cells(_matrix(b.column("vec"), dim), number, HOME * k)):
                    home = 1 + int(np.searchsorted(np.cumsum(number[order]), HOME * k))
                    if np.isnan(radius):  # in its own cell, then in others
                        chosen.append(order[:home])
                    else:
                        chosen.append(order[home : PROBES + 1] if radius < 2 else np.setdiff1d(np.flatnonzero(number), order[:home]))
                q = np.repeat(np.arange(b.num_rows), [len(c) for c in chosen])
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(q)).columns, pa.array(np.concatenate(chosen).astype(np.int32))], [*b.schema.names, "cell"])

    routed = "id bigint, vec binary, radius double, cell int"
    home = cut(_met(placed, wanted.withColumn("radius", F.lit(None).cast("double")).mapInArrow(route, routed), held, index, dim, k))
    near = home.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    enough = near.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("similarity"), False), F.lit(k - 1)).alias("last"))  # at most k from each block of the cell
    radius = F.sqrt(F.greatest(2 - 2 * F.col("last"), F.lit(0.0)))
    reach = wanted.join(enough.withColumnRenamed("query_id", "id"), "id", "left").select("id", "vec", F.when(F.col("last").isNull(), F.lit(2.0)).otherwise(radius).alias("radius"))
    near = near.unionByName(_met(placed, reach.mapInArrow(route, routed), held, index, dim, k))
    near = near.groupBy("query_id", "id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def request_neighbours(points: DataFrame, requests: DataFrame, k: int = 10, text_dim: int = 96, image_dim: int = 64) -> DataFrame:
    """(request_id, vector_field, id, similarity) for both embeddings of the search requests."""
    found = []
    for name, dim, vectors in (
        ("text_embedding", text_dim, points.select("id", F.col("text_vector").alias("vec"))),
        ("image_embedding", image_dim, points.select("id", F.explode("image_vector").alias("vec"))),
    ):
        asked = requests.select(F.col("request_id").alias("query_id"), F.col(name).alias("vec"))
        found.append(most_similar(vectors, asked, dim, k).select(F.col("query_id").alias("request_id"), F.lit(name).alias("vector_field"), "id", "similarity"))
    return found[0].unionByName(found[1])
