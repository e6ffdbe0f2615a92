"""Organisational knowledge: facts, procedures, patterns, health, search and the enriched bundle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators.graph import STRENGTH, expand
from faultline.operators.risks import filtered

LIMIT, ENRICH_LIMIT = 20, 10
#: Queries that are held against the vectors at once; more are taken in blocks.
QUERY_BLOCK = 1000
#: Scores that a task holds at once.
BLOCK_SCORES = 1 << 18
#: Rows that are put in order at once.
CUT_ROWS = 1 << 16


def facts(df: DataFrame, vertical=None, technology=None, status=None, limit: int | None = None) -> DataFrame:
    """Facts equal in the given columns; ``technology`` may be an array column or a plain one."""
    member = {"technologies": technology} if "technologies" in df.columns else {}
    equal = {} if member else {"technology": technology}
    out = filtered(df, member=member, vertical=vertical, validation_status=status, **equal)
    return out.orderBy(F.desc("confidence"), "id").limit(limit) if limit else out


def procedures_for_control(procedures: DataFrame, code: str) -> DataFrame:
    """Procedures related to a control; if there is none, all of them."""
    hit = F.exists("related_controls", lambda c: c == code)
    some = procedures.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_some"))
    return procedures.join(F.broadcast(some)).filter(hit | ~F.col("_some")).withColumn("matched", F.col("_some")).drop("_some")


def procedures(df: DataFrame, vertical=None, technology=None, type=None, control=None, limit: int | None = None) -> DataFrame:
    """Procedures equal in the given columns; ``technology`` may be an array column or a plain one.

    With ``control``, those related to it, or all that match otherwise where none is. With a limit, the first by id.
    """
    member = {"technologies": technology} if "technologies" in df.columns else {}
    equal = {} if member or technology is None else {"technology": technology}
    out = filtered(df, member=member, **({"vertical": vertical} if vertical else {}), **({"procedure_type": type} if type else {}), **equal)
    if control is not None:
        out = procedures_for_control(out, control)
    return out.orderBy("id").limit(limit) if limit else out


def patterns(df: DataFrame, vertical=None, type=None, min_occurrences: int = 0) -> DataFrame:
    """Patterns; a minimum of 0 or less is no predicate."""
    out = filtered(df, vertical=vertical, **({"pattern_type": type} if type else {}))
    return out.filter(F.col("occurrence_count") >= min_occurrences) if min_occurrences > 0 else out


def causal_chains(df: DataFrame) -> DataFrame:
    """Patterns with each causal chain in order."""
    return df.withColumn("causal_chain", F.array_sort("causal_chain"))


def health(facts: DataFrame, procedures: DataFrame, patterns: DataFrame) -> DataFrame:
    """Totals by kind, validated percentage (0-100), mean confidence (0-1), stale and contradicted facts, and all entries together.

    A fact is stale if its stale_since says so or, without such a column, if that is its validation status.
    """
    stale = F.coalesce(F.col("stale_since").cast("string"), F.lit("")) != "" if "stale_since" in facts.columns else F.col("validation_status") == "stale"
    f = facts.agg(
        F.count(F.lit(1)).alias("total_facts"),
        (100.0 * F.count_if(F.col("validation_status") == "analyst_validated") / F.count(F.lit(1))).alias("validated_percentage"),
        F.avg("confidence").alias("avg_confidence"),
        F.count_if(stale).alias("stale_count"),
        F.count_if(F.col("validation_status") == "contradicted").alias("contradiction_count"),
    )
    p, q = procedures.agg(F.count(F.lit(1)).alias("total_procedures")), patterns.agg(F.count(F.lit(1)).alias("total_patterns"))
    return f.join(F.broadcast(p)).join(F.broadcast(q)).withColumn("total", F.col("total_facts") + F.col("total_procedures") + F.col("total_patterns"))


def unit_rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the arrays' directions, and which rows have one: those of ``size`` numbers that are not all 0."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    ok = sizes == size
    matrix = np.zeros((len(column), size))
    if ok.any():
        matrix[ok] = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    length = np.sqrt((matrix * matrix).sum(axis=1))
    ok &= (length > 0) & np.isfinite(length)
    matrix[ok] /= length[ok, None]
    return matrix, ok


class Best:
    """The ``limit`` best rows of each query: by score, then id, then row. What cannot be among them is not kept."""

    def __init__(self, queries: int, limit: int, least: np.ndarray | None = None):
        self.limit, self.least = limit, np.full(queries, -np.inf) if least is None else least
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]] = []
        self.n = self.kept = 0

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: pa.Array, rows: np.ndarray) -> None:
        """``scores`` of some queries (their numbers) by row; the matrix is to be no larger than ``BLOCK_SCORES``, the rows in order of their ids."""
        least = self.least[queries]
        passed = scores >= least[:, None]
        if np.count_nonzero(passed) > self.limit * len(queries) and len(rows) > self.limit:
            least = np.maximum(least, -np.partition(-scores, self.limit - 1, axis=1)[:, self.limit - 1])
            passed = scores >= least[:, None]
        query, row = np.nonzero(passed)
        found = scores[query, row]
        # Of a query's rows with the least score, the first by id are enough.
        equal = np.cumsum(found == least[query])
        before = np.concatenate(([0], equal))[np.searchsorted(query, query)]
        keep = (found > least[query]) | (equal - before <= self.limit)
        if keep.any():
            row = row[keep]
            self.parts.append((queries[query[keep]].astype(np.int32), found[keep], ids.take(pa.array(row)), rows[row]))
            self.n += len(row)
            if self.n - self.kept > BLOCK_SCORES:
                self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray] | None:
        """query, score, id and row of the best so far; None if there are none."""
        if len(self.parts) > 1 or self.n > self.kept:
            query, score, row = (np.concatenate([part[i] for part in self.parts]) for i in (0, 1, 3))
            ids = pa.concat_arrays([part[2] for part in self.parts])
            self.parts = []
            rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy()
            # A run of queries at a time, since sorting takes several times the memory of what is sorted.
            by_query = np.argsort(query, kind="stable").astype(np.int32)
            ends = np.searchsorted(query, np.arange(len(self.least)), "right", sorter=by_query)
            kept, low = [], 0
            while low < len(by_query):
                q = np.searchsorted(ends, low + CUT_ROWS)
                high = int(ends[q]) if q < len(ends) else len(by_query)
                at = by_query[low:high]
                at = at[np.lexsort((row[at], rank[at], -score[at], query[at]))]
                place = np.arange(len(at)) - np.searchsorted(query[at], query[at])
                last = at[place == self.limit - 1]
                self.least[query[last]] = score[last]
                kept.append(at[place < self.limit])
                low = high
            order = np.concatenate(kept)
            self.parts = [(query[order], score[order], ids.take(pa.array(order)), row[order])]
            self.n = self.kept = len(order)
        return self.parts[0] if self.parts else None


def slices(batch: pa.RecordBatch, queries: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of which ``queries`` queries have at most ``BLOCK_SCORES`` scores."""
    n = max(1, BLOCK_SCORES // max(1, queries))
    for low in range(0, batch.num_rows, n):
        yield batch.slice(low, n)


def _nearest(names: pa.Array, queries: np.ndarray, directed: np.ndarray, limit: int):
    """The ``limit`` best (query_id, vec_id, score) of each query within a task; scores are rounded to 12 places, so that equal vectors tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, everyone = Best(len(queries), limit), np.arange(len(queries))
        for batch in batches:
            for part in slices(batch, len(queries)) if len(queries) else ():
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                matrix, ok = unit_rows(part.column(1), queries.shape[1])
                scores = np.round(queries @ matrix.T, 12)
                scores[:, ~ok], scores[~directed] = -np.inf, -np.inf
                best.add(everyone, scores, part.column(0), np.zeros(len(matrix), np.int64))
        found = best.cut()
        if found is not None:
            query, score, ids, _ = found
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), ids, pa.array(score, mask=~np.isfinite(score))], ["query_id", "vec_id", "score"])

    return run


def semantic_search(vectors: DataFrame, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` nearest vectors of each query by cosine, ties by id: every query against all vectors.

    ``queries`` has query_id and query_vector. Blocks of about ``QUERY_BLOCK`` queries come to the driver and go to the
    tasks as a matrix; vectors are brought to unit length once and multiplied with it, as many at once as make
    ``BLOCK_SCORES`` scores, and no more than ``limit`` rows of a query leave a task before the shuffle by query. A vector without a direction (null, all 0, of
    another length) has a null score, as every vector has for such a query, and ranks last.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    rows = vectors.select("vec_id", "embedding")
    schema = queries.select("query_id").schema.add(rows.schema["vec_id"]).add("score", "double")
    scored = None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "query_vector").toArrow()
        column = own.column("query_vector").combine_chunks()
        size = max([0, *pc.list_value_length(column).drop_null().to_pylist()])
        matrix, directed = unit_rows(column, size)
        part = rows.mapInArrow(_nearest(own.column("query_id").combine_chunks(), matrix, directed, limit), schema)
        scored = part if scored is None else scored.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", "rank", "vec_id", "score")


def graph_search(hits: DataFrame, expanded: DataFrame) -> DataFrame:
    """Semantic hits (id, score) and graph neighbours (id, graph_score), merged with how each was found."""
    merged = hits.join(expanded, "id", "full_outer")
    method = F.when(F.col("score").isNotNull() & F.col("graph_score").isNotNull(), "both").when(F.col("score").isNotNull(), "semantic").otherwise("graph")
    return merged.select("id", "score", "graph_score", method.alias("discovery_method"), S.discovery_badge(method).alias("badge"))


def expanded_search(hits: DataFrame, edges: DataFrame, depth: int = 1, types: str | list[str] | None = None, min_strength: float = STRENGTH) -> DataFrame:
    """Hits (id, score) and what the graph reaches from them within ``depth``: id, score, graph_score, graph_path, depth, discovery_method and badge.

    graph_score is the strength of the edge by which a node is reached. Of several hits that reach a node, the nearest
    counts, then the strongest edge, then the first path. A hit that is reached from another one was found both ways.
    """
    reached = expand(edges, hits.select(F.col("id").cast("string").alias("entity_id")), depth, min_strength, types)
    best = F.min_by(F.struct("strength", "path", "depth"), F.struct(F.col("depth"), -F.col("strength"), F.col("path")))
    near = reached.groupBy(F.col("entity_id").alias("id")).agg(best.alias("b")).select("id", F.col("b.strength").alias("graph_score"), F.array_join("b.path", " -> ").alias("graph_path"), "b.depth")
    found = graph_search(hits.select(F.col("id").cast("string").alias("id"), "score"), near.select("id", "graph_score"))
    return found.join(near.select("id", "graph_path", "depth"), "id", "left").select("id", "score", "graph_score", "graph_path", "depth", "discovery_method", "badge")


def enrich(patterns: DataFrame, procedures: DataFrame, facts: DataFrame | None = None, hits: DataFrame | None = None, health: DataFrame | None = None, limit: int = ENRICH_LIMIT) -> DataFrame:
    """One table of (section, rank, id, label, score): patterns and procedures always; facts, hits and health where given.

    Each list has id, label and score. ``health`` is the one row of :func:`health`, whose numbers become a row each, by
    name. The sections are planned as one job, so they run side by side.
    """
    out = None
    for section, df in (("patterns", patterns), ("procedures", procedures), ("facts", facts), ("search", hits)):
        if df is None:
            continue
        by = [F.desc("score"), F.col("id")]
        top = df.select("id", "label", "score").orderBy(*by).limit(limit)
        part = top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*by)).alias("rank"), F.col("id").cast("string").alias("id"), "label", F.col("score").cast("double").alias("score"))
        out = part if out is None else out.unionByName(part)
    if health is not None:
        entries = F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).cast("double").alias("score")) for c in sorted(health.columns)])
        rows = health.select(F.posexplode(entries).alias("place", "e"))
        out = out.unionByName(rows.select(F.lit("health").alias("section"), (F.col("place") + 1).alias("rank"), "e.id", F.replace("e.id", F.lit("_"), F.lit(" ")).alias("label"), "e.score"))
    return out
