"""Semantic search by an index: an inverted file of cells with quantised residuals, over every vector.

The model is fitted on a bounded sample: ``cells`` directions by spherical k-means, and for each ``WIDTH`` numbers of what
is left of a vector beside its cell's direction a book of ``WORDS`` code words. How many cells a search looks into is
fitted as well: as many as hold ``TARGET`` of the nearest rows of some rows of the sample, so that vectors without any
clusters get most of the cells, and clustered ones a few. A row of the index has its cell, the angle
to the cell's direction, a byte for each part, and the vector itself; rows lie in order of their cells, so a search that
looks into a few cells reads little else of the files.

:func:`search` looks into the cells nearest to a query, takes ``CANDIDATES`` times as many rows as are asked for by what
their codes say, and ranks these by their vectors. With ``exact`` it then uses the last of these as a bound:
the angle between query and vector is at least the difference of their angles to a cell's direction, so cells and rows that
cannot be nearer are left out, and every other vector is compared. That gives what a comparison with all vectors gives.

Cases
    A vector without a direction (null, all 0, of another length than most of the sample) is in no cell: it is never found,
    but in exact mode, where all queries of a table with fewer directed vectors than ``limit``, and queries without a
    direction, are compared with everything, as :func:`faultline.operators.knowledge.semantic_search` does. Rows that share
    a vec_id are rows of their own, queries that share a query_id queries of their own. Equal vectors tie, by vec_id. An
    empty table finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.operators.knowledge import LIMIT, Best, semantic_search, slices, unit_rows
from faultline.sources.scratch import stored

#: Rows that the model is fitted on, and cells that it has, at most; the root of the number of rows if that is less.
SAMPLE, MOST_CELLS = 32_768, 1024
#: Numbers of a vector that share a byte, and code words of a byte.
WIDTH, WORDS = 4, 256
ROUNDS = 12
#: Share of the nearest rows of a sampled row that the cells which a search looks into are to hold, and rows that are tried.
TARGET, TRIED = 0.985, 512
#: Rows that are ranked by their vectors, for each that is asked for.
CANDIDATES = 25
#: Queries that are looked for at once; a task holds a table of code words and the candidates of each.
QUERY_BLOCK = 500
#: What bounds of cosines may be off by, in floating point.
SLACK = 1e-9


@dataclass(frozen=True)
class Model:
    """Directions of the cells, the code words of each part of a residual, and the cells that a search looks into."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]


@dataclass(frozen=True)
class Index:
    """The stored rows (row, cell, vec_id, angle, codes, embedding), their model, and the number and widest angle of each cell's."""

    rows: DataFrame
    model: Model
    counts: np.ndarray
    widest: np.ndarray


def k_means(x: np.ndarray, k: int, unit: bool = False) -> np.ndarray:
    """``k`` centres of the rows of ``x`` (fewer rows: the rows); unit ones by largest product, others by least distance."""
    rng = np.random.default_rng(11)
    k = min(k, len(x))
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS if k < len(x) else 0):
        own = nearest_centre(x, centres)
        sums = np.stack([np.bincount(own, weights=column, minlength=k) for column in x.T], axis=1)
        n = np.bincount(own, minlength=k)
        lost = np.flatnonzero(n == 0)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if len(lost):  # a centre that nothing is near to starts again from some row
            centres[lost] = x[rng.integers(0, len(x), len(lost))]
        if unit:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = np.where(length > 0, centres / np.where(length > 0, length, 1), x[rng.integers(0, len(x), k)])
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, a block of rows at a time."""
    half = (centres * centres).sum(axis=1) / 2
    block = max(1, (1 << 22) // len(centres))
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(x[i : i + block] @ centres.T - half, axis=1) for i in range(0, len(x), block)]])


def _parts(x: np.ndarray, padded: int) -> np.ndarray:
    """Rows cut into parts of WIDTH, with zeros at the end: parts x rows x WIDTH."""
    out = np.zeros((len(x), padded))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), -1, WIDTH).transpose(1, 0, 2)


def fitted_probes(x: np.ndarray, centroids: np.ndarray) -> int:
    """The number of nearest cells that hold TARGET of the LIMIT nearest rows of the first rows of ``x``."""
    own = nearest_centre(x, centroids)
    tried = x[:TRIED]
    order = np.argsort(-(tried @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
    places = []
    for i, row in enumerate(tried):
        scores = x @ row
        scores[i] = -np.inf  # itself
        places.append(place[i][own[np.argsort(-scores, kind="stable")[: min(LIMIT, len(x) - 1)]]])
    places = np.sort(np.concatenate(places))
    return int(places[min(len(places) - 1, math.ceil(TARGET * len(places)))]) + 1 if len(places) else 1


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Model | None:
    """The model of ``vectors`` (vec_id, embedding) from about ``sample`` of them, chosen by hash; None if there is no direction among them."""
    n = vectors.count()
    cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(n))))
    share = min(1.0, 1.1 * sample / max(n, 1))
    # The hash picks about a sample before anything is put in order.
    picked = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    column = picked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    lengths = pc.list_value_length(column).drop_null().to_numpy()
    size = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    matrix, ok = unit_rows(column, size)
    x = matrix[ok]
    if not len(x):
        return None
    centroids = k_means(x, cells, unit=True)
    rest = x - centroids[nearest_centre(x, centroids)]
    books = np.zeros((-(-size // WIDTH), WORDS, WIDTH))
    for j, part in enumerate(_parts(rest, len(books) * WIDTH)):
        found = k_means(part, WORDS)
        books[j] = found[np.arange(WORDS) % len(found)]
    return Model(centroids, books, fitted_probes(x, centroids))


INDEX = "row long, cell int, vec_id long, angle double, codes binary, embedding array<double>"


def _assigned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            matrix, ok = unit_rows(batch.column(1), model.size)
            cell = nearest_centre(matrix, model.centroids)
            near = model.centroids[cell]
            angle = np.arccos(np.clip((matrix * near).sum(axis=1), -1, 1))
            codes = np.empty((len(matrix), len(model.books)), np.uint8)
            for j, part in enumerate(_parts(matrix - near, model.padded)):
                codes[:, j] = nearest_centre(part, model.books[j])
            cell[~ok] = -1
            row = base + np.arange(len(matrix))
            base += len(matrix)
            columns = [pa.array(row), pa.array(cell, pa.int32()), batch.column(0), pa.array(angle, mask=~ok), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1).cast(pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "cell", "vec_id", "angle", "codes", "embedding"])

    return run


def build(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """The index of all ``vectors`` (vec_id, embedding); its rows are stored in order of their cells."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(vectors, cells, sample) or Model(np.zeros((1, 0)), np.zeros((0, WORDS, WIDTH)), 1)
    # A large cell spreads over as many partitions as it needs, since the id is part of the order.
    rows = vectors.mapInArrow(_assigned(model), INDEX)
    rows = stored(rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell"), "vector-index")
    n, widest = np.zeros(len(model.centroids), np.int64), np.zeros(len(model.centroids))
    for r in rows.filter("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect():
        n[r.cell], widest[r.cell] = r.n, r.widest
    return Index(rows, model, n, widest)


def _batch(best: Best) -> pa.RecordBatch:
    query, score, ids, row = best.cut() or (np.zeros(0, np.int32), np.zeros(0), pa.array([], pa.int64()), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(row), ids, pa.array(score)], ["query", "row", "vec_id", "score"])


FOUND = "query int, row long, vec_id long, score double"


def _by_cell(cell: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell among the rows, with its rows."""
    order = np.argsort(cell, kind="stable")
    cuts = np.flatnonzero(np.diff(cell[order])) + 1
    for rows in np.split(order, cuts) if len(order) else []:
        yield int(cell[rows[0]]), rows


def _by_codes(model: Model, queries: np.ndarray, looked_into: np.ndarray, limit: int):
    """The best rows by their codes, in a task; ``looked_into`` says which query (row) looks into which cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), limit)
        # What a code word adds to a query's product: parts x queries x code words.
        tables = _parts(queries, model.padded) @ model.books.transpose(0, 2, 1)
        direct = queries @ model.centroids.T
        for batch in batches:
            for part in slices(batch, len(queries)):
                part = part.take(pc.sort_indices(part.column(2)))
                row, cell = (part.column(i).to_numpy() for i in range(2))
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(row), -1)
                for c, rows in _by_cell(cell):
                    some = np.flatnonzero(looked_into[:, c])
                    scores = np.repeat(direct[some, c][:, None], len(rows), 1)
                    for j in range(len(tables)):
                        scores += tables[j][np.ix_(some, codes[rows, j])]
                    best.add(some, scores, part.column(2).take(pa.array(rows)), row[rows])
        yield _batch(best)

    return run


def _by_vectors(queries: np.ndarray):
    """Scores of rows that were found for a query, by their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix, _ = unit_rows(batch.column(3), queries.shape[1])
            scores = np.round((matrix * queries[batch.column(0).to_numpy()]).sum(axis=1), 12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores)], ["query", "row", "vec_id", "score"])

    return run


def _by_bounds(model: Model, queries: np.ndarray, least: np.ndarray, looked_into: np.ndarray, limit: int):
    """The best rows among those that the angles do not rule out for a query's least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), limit, least - SLACK)
        to_cell = np.arccos(np.clip(queries @ model.centroids.T, -1, 1))
        for batch in batches:
            for part in slices(batch, len(queries)):
                part = part.take(pc.sort_indices(part.column(2)))
                row, cell, angle = (part.column(i).to_numpy() for i in (0, 1, 3))
                matrix, _ = unit_rows(part.column(4), model.size)
                for c, rows in _by_cell(cell):
                    some = np.flatnonzero(looked_into[:, c])
                    near = np.cos(np.abs(to_cell[some, c][:, None] - angle[rows][None, :])) >= least[some][:, None] - SLACK
                    rows, some = rows[near.any(axis=0)], some[near.any(axis=1)]
                    if len(rows):
                        best.add(some, np.round(queries[some] @ matrix[rows].T, 12), part.column(2).take(pa.array(rows)), row[rows])
        yield _batch(best)

    return run


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _in_cells(rows: DataFrame, looked_into: np.ndarray) -> DataFrame:
    return rows.filter(F.col("cell").isin(np.flatnonzero(looked_into.any(axis=0)).tolist()))


def _block(index: Index, own: pa.Table, limit: int, probes: int | None, exact: bool) -> DataFrame:
    """What a block of queries finds, by the query's place in the block."""
    model = index.model
    queries, directed = unit_rows(own.column("query_vector").combine_chunks(), model.size)
    n_cells, filled = len(model.centroids), index.counts > 0
    probes = min(n_cells, probes or model.probes)
    product = np.where(filled, queries @ model.centroids.T, -np.inf)
    looked_into = np.zeros(product.shape, bool)
    np.put_along_axis(looked_into, np.argsort(-product, axis=1, kind="stable")[:, :probes], True, 1)
    looked_into &= filled & directed[:, None]
    coded = _in_cells(index.rows, looked_into).select("row", "cell", "vec_id", "codes").mapInArrow(_by_codes(model, queries, looked_into, CANDIDATES * limit), FOUND)
    # At most so many rows as there are queries in a block times candidates: few enough to broadcast.
    candidates = _ranked(coded, CANDIDATES * limit).select("query", "row")
    compared = _in_cells(index.rows, looked_into).select("row", "vec_id", "embedding").join(F.broadcast(candidates), "row").select("query", "row", "vec_id", "embedding")
    found = _ranked(compared.mapInArrow(_by_vectors(queries), FOUND), limit)
    if not exact:
        return found
    least = np.full(len(queries), -np.inf)
    for r in found.filter(F.col("rank") == limit).collect():
        least[r["query"]] = r.score
    # No vector of a cell is nearer than the cell's direction less its widest angle.
    bound = np.cos(np.maximum(0, np.arccos(np.clip(queries @ model.centroids.T, -1, 1)) - index.widest[None, :]))
    open_cells = (bound >= least[:, None] - SLACK) & filled & directed[:, None]
    rest = _in_cells(index.rows, open_cells).select("row", "cell", "vec_id", "angle", "embedding")
    return _ranked(rest.mapInArrow(_by_bounds(model, queries, least, open_cells, limit), FOUND), limit)


def search(index: Index, queries: DataFrame, limit: int = LIMIT, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score of the ``limit`` nearest rows of the index for each of ``queries`` (query_id, query_vector).

    Blocks of about ``QUERY_BLOCK`` queries come to the driver. ``probes`` is the number of cells that a query looks into,
    by default what the model was fitted to.
    """
    spark = index.rows.sparkSession
    queries = queries.select("query_id", "query_vector")
    if index.counts.sum() < limit and exact:
        return semantic_search(index.rows.select("vec_id", "embedding"), queries, limit)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()
        names = spark.createDataFrame(pa.table({"query": pa.array(range(own.num_rows), pa.int32()), "query_id": own.column("query_id")}))
        found = _block(index, own, limit, probes, exact).join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score")
        _, directed = unit_rows(own.column("query_vector").combine_chunks(), index.model.size)
        if exact and not directed.all():
            # Without a direction all scores are null, and ids decide.
            rest = spark.createDataFrame(own.filter(pa.array(~directed)).select(["query_id"])).withColumn("query_vector", F.lit(None).cast("array<double>"))
            found = found.unionByName(semantic_search(index.rows.select("vec_id", "embedding"), rest, limit))
        out = found if out is None else out.unionByName(found)
    return out


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: n_wanted, n_found and recall of the (query_id, vec_id) that a search ``found`` among those ``wanted``."""
    hit = wanted.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_wanted"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_wanted"))
