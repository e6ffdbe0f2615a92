"""Ranked lexical search: document-at-a-time merge over compressed postings.

Method
    1. :func:`index` cuts the documents, where they lie, into segments of about ``SEGMENT_WORDS`` words. A segment is one
       row that knows nothing of the others: its documents in order of doc_id with their lengths, its terms (as 64-bit
       hashes) with the number of documents of each, and for each term the documents that hold it, in order and as gaps,
       with its occurrences in them. All of it is packed. No posting is shuffled.
    2. :func:`search` takes the queries in blocks. For a block it adds up over the segments how many documents there are,
       how long they are and how many hold each term of the queries; these numbers, as many as the block has terms, give
       the weights.
    3. Each task then goes through its segments with one heap of the ``k`` best of each query, by score, then doc_id. In a
       segment a heap of cursors merges the posting lists of the query's terms by document, so that a document is scored as
       a whole when its turn comes. Terms that together can't lift a document into the best ``k`` have no cursor: they are
       looked up for documents that others bring, and only while these can still be among the best. That leaves nothing
       out: a term's bound is its weight times the largest share it has in the segment.
    4. The tasks' best are merged by a window over each query, whose input is ``k`` rows a task.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its share in a document (10^9 tf) div (1000 tf + 8 m), where m is
25 + (75 n N) div L: N documents that have a term, L all their terms, n the document's, df documents with the term, tf its
occurrences in this one. A score is the sum of weight times share over the query's terms, repeats included. A term of a
query is taken for another one of the documents if both have one hash: about one search in 10^6 with 10^4 terms in queries
and 10^9 in documents.

Cases
    Null or empty text, or text without terms: no document of N, and an item without results. Terms that no document has
    add nothing. Fewer than ``k`` documents with a score above 0: all of them. Equal scores: by doc_id, a null doc_id last.
    Rows that share a doc_id are documents of their own, rows of queries that share an item_id queries of their own. Very
    long texts are a segment of their own. Empty tables: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm._memory import released
from faultline.llm._store import bounded_batches, stored
from faultline.llm._text import ALNUM_WORDS, words_of
from faultline.llm.word_table import pack, ranges, unpack

K = 10
#: Words after which a segment ends.
SEGMENT_WORDS = 1_000_000
#: Queries, and characters of them, that a pass over the index takes.
QUERY_BLOCK, QUERY_CHARS = 1000, 4_000_000

INDEX = "doc_ids binary, lengths binary, terms binary, counts binary, gaps binary, occurrences binary"
#: Stands for a null doc_id, so that it comes last.
_NO_ID = (1 << 63) - 1


def _pack_wide(x: np.ndarray) -> bytes:
    """64-bit integers in order, as differences, byte planes apart, compressed."""
    x = np.diff(x.view(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_wide(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _segment(ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[bytes, ...]:
    """The row of some documents: their ids, numbers of words, and words' hashes one after another."""
    order = np.argsort(ids, kind="stable")
    hashes = hashes[ranges((np.cumsum(sizes) - sizes)[order], sizes[order])]
    ids, sizes = ids[order], sizes[order]
    by_term = np.argsort(hashes, kind="stable")
    term, place = hashes[by_term], np.repeat(np.arange(len(ids)), sizes)[by_term]
    first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (place[1:] != place[:-1]))))
    occurrences = np.diff(first, append=len(term))
    term, place = term[first], place[first]
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    gaps = np.diff(place, prepend=0)
    gaps[starts] = place[starts]
    return _pack_wide(ids), pack(sizes), _pack_wide(term[starts]), pack(np.diff(starts, append=len(term))), pack(gaps), pack(occurrences)


def _segments(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, hashes, n = [], [], [], 0

        def flush():
            row = _segment(*map(np.concatenate, (ids, sizes, hashes)))
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            own = batch.column(0).fill_null(_NO_ID).to_numpy()
            for low, high, w in words_of(batch.column(1), ALNUM_WORDS):
                size = np.diff(w.bounds)
                ids.append(own[low:high][size > 0])
                sizes.append(size[size > 0])
                hashes.append(w.hash)
                n += len(w.hash)
                if n >= words:
                    yield flush()
                    ids, sizes, hashes, n = [], [], [], 0
        if n:
            yield flush()

    return run


def index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The segments of ``docs`` (doc_id, text): a stored table of about a row a million words, for any number of searches."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(source.mapInArrow(released(_segments(segment_words)), INDEX), "postings")


def _looked_up(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` (sorted) there are among the sorted ``terms``, and where."""
    at = np.searchsorted(terms, wanted)
    found = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == wanted) if len(terms) else np.zeros(0, np.int64)
    return found, at[found]


def _statistics(wanted: np.ndarray):
    """(term, n): the documents that have each wanted term, by its place; at -1 all documents, at -2 all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(wanted), np.int64), 0, 0
        for batch in batches:
            for lengths, terms, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lengths = unpack(lengths)
                n, total = n + len(lengths), total + int(lengths.sum(dtype=np.int64))
                found, at = _looked_up(_unpack_wide(terms), wanted)
                df[found] += unpack(counts)[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], some))), pa.array(np.concatenate(([n, total], df[some])))], ["term", "n"])

    return run


def merge_best(lists: list[tuple[int, list[int], list[int]]], ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Takes the documents of posting lists into ``best``, the heap of the ``k`` best (score, -doc_id) with a score above 0.

    A list is (weight, documents in order, their shares); documents are places in ``ids``.
    """
    bounds = [weight * max(shares) for weight, _, shares in lists]
    order = sorted(range(len(lists)), key=bounds.__getitem__)
    weights, places, shares = ([lists[i][j] for i in order] for j in range(3))
    below, total, n = [], 0, len(lists)
    for i in order:
        total += bounds[i]
        below.append(total)
    at = [0] * n
    least = best[0][0] if len(best) == k else 1
    # Lists before this one can't bring a document to the least score that counts, even all together.
    first = sum(b < least for b in below)
    heads = [places[i][0] * n + i for i in range(first, n)]
    heapq.heapify(heads)
    while heads:
        doc = heads[0] // n
        end, score = (doc + 1) * n, 0
        while heads and heads[0] < end:
            i = heads[0] - doc * n
            p = at[i]
            score += weights[i] * shares[i][p]
            at[i] = p = p + 1
            if p < len(places[i]):
                heapq.heapreplace(heads, places[i][p] * n + i)
            else:
                heapq.heappop(heads)
        i = first - 1
        while i >= 0 and score + below[i] >= least:
            p = at[i] = bisect_left(places[i], doc, at[i])
            if p < len(places[i]) and places[i][p] == doc:
                score += weights[i] * shares[i][p]
            i -= 1
        if score < least or i >= 0:
            continue
        if len(best) < k:
            heapq.heappush(best, (score, -ids[doc]))
        elif (score, -ids[doc]) > best[0]:
            heapq.heapreplace(best, (score, -ids[doc]))
        if len(best) == k and best[0][0] > least:
            least, before = best[0][0], first
            while first < n and below[first] < least:
                first += 1
            if first > before:
                heads = [h for h in heads if h % n >= first]
                heapq.heapify(heads)


def _best(wanted: np.ndarray, weights: list[int], queries: list[list[tuple[int, int]]], n: int, total: int, k: int):
    """(query, doc_id, score): the best of each query, given as (place of a term, its repeats), among a task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in queries]
        for batch in batches:
            for doc_ids, lengths, terms, counts, gaps, occurrences in zip(*(batch.column(i).to_pylist() for i in range(6))):
                ids, terms, counts = _unpack_wide(doc_ids).view(np.int64).tolist(), _unpack_wide(terms), unpack(counts).astype(np.int64)
                m = 25 + 75 * unpack(lengths).astype(np.int64) * n // total
                found, at = _looked_up(terms, wanted)
                starts, gaps, occurrences = np.cumsum(counts) - counts, unpack(gaps), unpack(occurrences)
                lists = {}
                for term, low, size in zip(found.tolist(), starts[at].tolist(), counts[at].tolist()):
                    places, tf = np.cumsum(gaps[low : low + size], dtype=np.int64), occurrences[low : low + size].astype(np.int64)
                    lists[term] = places.tolist(), (1_000_000_000 * tf // (1000 * tf + 8 * m[places])).tolist()
                for query, own in zip(queries, best):
                    some = [(weights[t] * repeats, *lists[t]) for t, repeats in query if t in lists and weights[t]]
                    if some:
                        merge_best(some, ids, own, k)
        rows = [(q, -i, score) for q, own in enumerate(best) for score, i in own]
        query, doc_id, score = zip(*rows) if rows else ((), (), ())
        doc_id = pa.array([None if i == _NO_ID else i for i in doc_id], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), doc_id, pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    return run


def _terms_of(column: pa.Array) -> list[Counter]:
    """How often each row has each term, by hash."""
    out = []
    for _, _, w in words_of(column, ALNUM_WORDS):
        out += [Counter(w.hash[a:b].tolist()) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    return out


def search(segments: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score: the ``k`` best documents of an :func:`index` for each row (item_id, text) of ``queries``.

    A block of queries, of at most about ``QUERY_BLOCK`` rows and ``QUERY_CHARS`` characters, comes to the driver.
    """
    spark = segments.sparkSession
    queries = queries.select("item_id", F.col("text").cast("string").alias("text"))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // QUERY_BLOCK), -(-size.chars // QUERY_CHARS))
    out = None
    for b in range(blocks):
        own = (queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).toArrow()
        terms = _terms_of(own.column("text").combine_chunks()) if own.num_rows else []
        wanted = np.unique(np.array([t for c in terms for t in c], np.uint64))
        place = {t: i for i, t in enumerate(wanted.tolist())}
        # A sum for each term of the block, and the two sums over all documents.
        counts = dict(map(tuple, segments.select("lengths", "terms", "counts").mapInArrow(released(_statistics(wanted)), "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
        n, total = counts.get(-1, 0), counts.get(-2, 0)
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(wanted))]
        plans = [[(place[t], r) for t, r in c.items()] for c in terms]
        found = segments.mapInArrow(released(_best(wanted, weights, plans, n, max(total, 1), k)), "query int, doc_id long, score long")
        by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"query": pa.array(range(own.num_rows), pa.int32()), "item_id": own.column("item_id")}))
        part = found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """:func:`search` of the :func:`index` of ``docs``."""
    return search(index(docs), queries, k)
