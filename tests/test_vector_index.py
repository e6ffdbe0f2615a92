"""The vector index: against a comparison with every vector."""

import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.operators import knowledge as K
from faultline.operators import vector_index as X
from faultline.operators.knowledge import semantic_search
from faultline.plans import catalogue


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in rows], "vec_id long, embedding array<double>")


def asked(df):
    return df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def rows(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=lambda r: r[:3])


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 10))
    return [(i, centres[i % 30] + 0.15 * rng.normal(size=10)) for i in range(1500)]


def test_clusters_need_few_cells(spark, clustered):
    df = vectors(spark, clustered)
    index = X.build(df.repartition(3))
    queries = asked(df.filter("vec_id % 50 = 0"))
    wanted = semantic_search(df, queries)
    assert index.model.probes < len(index.model.centroids) / 2 and index.counts.sum() == 1500
    assert X.recall(X.search(index, queries), wanted).first().recall >= 0.95
    assert rows(X.search(index, queries, exact=True)) == rows(wanted)
    # A single cell looked into still gives the exact result, since the bounds decide.
    assert rows(X.search(index, queries, probes=1, exact=True)) == rows(wanted)


def test_small_sample_covers_every_row(spark, clustered):
    df = vectors(spark, clustered)
    index = X.build(df, cells=5, sample=40)
    assert index.counts.sum() == 1500 and len(index.model.centroids) == 5
    queries = asked(df.filter("vec_id < 20"))
    assert rows(X.search(index, queries, limit=7, exact=True)) == rows(semantic_search(df, queries, 7))


def test_blocks_of_queries(spark, clustered, monkeypatch):
    df = vectors(spark, clustered[:300])
    queries = asked(df.filter("vec_id < 25"))
    monkeypatch.setattr(X, "QUERY_BLOCK", 10)
    assert rows(X.search(X.build(df), queries, exact=True)) == rows(semantic_search(df, queries))


def test_rows_without_direction_copies_and_ties(spark):
    own = [(i, [1, 0, i % 3]) for i in range(40)] + [(7, [1, 0, 1]), (50, None), (51, [0, 0, 0]), (52, [1, 2]), (53, [-1, 0, 0])]
    df = vectors(spark, own)
    queries = asked(df.filter("vec_id in (0, 8, 50, 51, 52)"))
    index = X.build(df)
    assert index.counts.sum() == 42
    wanted = rows(semantic_search(df, queries))
    assert rows(X.search(index, queries, exact=True)) == wanted
    assert {r.query_id for r in X.search(index, queries).collect()} == {0, 8}
    twice = queries.union(queries)
    assert sorted(map(repr, rows(X.search(index, twice, exact=True)))) == sorted(map(repr, [w for w in wanted if w[3] is not None] * 2 + rows(semantic_search(df, twice.filter("query_id >= 50")))))


def test_fewer_rows_than_asked_for_and_none(spark):
    df = vectors(spark, [(1, [1, 2]), (2, [2, 1]), (3, None)])
    assert rows(X.search(X.build(df), asked(df), exact=True)) == rows(semantic_search(df, asked(df)))
    for some in (df.limit(0), df.filter("vec_id = 3")):
        index = X.build(some)
        assert X.search(index, asked(df)).count() == 0
        assert rows(X.search(index, asked(df), exact=True)) == rows(semantic_search(some, asked(df)))
    assert X.search(X.build(df), asked(df).limit(0), exact=True).count() == 0


def test_a_task_holds_few_scores(spark, monkeypatch):
    """Memory of a task's search does not grow with its batch of rows: small blocks of scores, whatever ties there are."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(400, 16)), 50, axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(rng.permutation(len(x))), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "embedding"])
    queries, directed = K.unit_rows(batch.column(1).slice(0, 100), 16)
    model = X.Model(queries[:4], rng.normal(size=(4, X.WORDS, X.WIDTH)), 4)
    monkeypatch.setattr(X.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    indexed = pa.Table.from_batches(X._assigned(model)([batch]), schema=pa.schema([("row", pa.int64()), ("cell", pa.int32()), ("vec_id", pa.int64()), ("angle", pa.float64()), ("codes", pa.binary()), ("embedding", pa.list_(pa.float64()))]))
    whole, every = indexed.combine_chunks().to_batches()[0], np.ones((100, 4), bool)
    coded = whole.select(["row", "cell", "vec_id", "codes"])
    exact = whole.select(["row", "cell", "vec_id", "angle", "embedding"])
    searches = {
        "vectors": (lambda: K._nearest(pa.array(range(100)), queries, directed, 20)([batch]), ["query_id", "vec_id"]),
        "codes": (lambda: X._by_codes(model, queries, every, 20)([coded]), ["query", "vec_id"]),
        "bounds": (lambda: X._by_bounds(model, queries, np.full(100, -1.0), every, 20)([exact]), ["query", "vec_id"]),
    }
    ids, scores = batch.column(0).to_numpy(), np.round(queries @ K.unit_rows(batch.column(1), 16)[0].T, 12)
    wanted = sorted((q, int(i)) for q in range(100) for i in ids[np.lexsort((ids, -scores[q]))[:20]])
    found = {}
    for name, (search, columns) in searches.items():
        found[name] = sorted(zip(*(pa.Table.from_batches(search()).column(c).to_pylist() for c in columns)))
    assert found["vectors"] == found["bounds"] == wanted
    monkeypatch.setattr(K, "BLOCK_SCORES", 1 << 14)
    for name, (search, columns) in searches.items():
        assert sorted(zip(*(pa.Table.from_batches(search()).column(c).to_pylist() for c in columns))) == found[name]
        tracemalloc.start()
        list(search())
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # A block of all rows' scores alone would be 16 MB.
        assert most < 8_000_000, (name, most)


def test_graph_searches_ask_for_one_vector(spark, sf, monkeypatch):
    """Only the query that is used is held against the vectors."""
    asked_for, search = [], K.semantic_search
    monkeypatch.setattr(K, "semantic_search", lambda vectors, queries, *a: asked_for.append(queries.count()) or search(vectors, queries, *a))
    for name in ("graph_search_merge", "graph_search_expanded"):
        assert catalogue.queries()[name](spark, sf).count() > 0
    assert asked_for == [1, 1]
