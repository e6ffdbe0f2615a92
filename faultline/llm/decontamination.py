"""Benchmark decontamination by greedy string tiling.

Method
    The seeds of an item are the Karp-Rabin hashes of its k-grams of ``SEED`` words, kept as a stored table. Documents are
    read once; one that has a seed by which an item is looked for keeps its places of shared seeds, and these are
    joined to the items by the seed. Each pair of a text and an item found so is tiled: shared seeds are joined to runs on
    one diagonal; the longest run is marked as a tile in both texts, runs that it cuts are shortened, and so on until
    no run of ``SEED`` unmarked words is left. The share of an item's words that are in tiles, wherever in the document
    and in whatever order, is its coverage; at ``COVERAGE`` or more it leaked.

    An item is looked for by its rare seeds, those in at most ``COMMON`` items: what common seeds alone could cover of it
    does not make a leak, so a prompt that very many items share pairs no document with all of them. Only an item that
    common seeds could cover enough is looked for by all but its commonest seeds, as many as a leak must share at
    least. Both lose no leak. Pairs whose seeds cannot reach the coverage are not tiled (an upper bound).
    What comes to the driver are two bitmaps of at most 2 ** ``MOST_BITS`` bits, whatever the size of the benchmark; they
    only spare k-grams that are no seed the join.

Words are runs of ASCII letters and digits and all other non-ASCII characters, A-Z in lower case.

Cases
    Null or empty texts of either table match nothing. An item of fewer than ``SEED`` words has one seed, of all its words, and
    leaked wherever these stand one after another; ``least_words`` leaves out items that say too little. Items with equal texts have equal
    results, rows that share an item_id have the larger coverage. Repeated documents and null doc_ids are judged row
    by row. Empty tables: no leaks. Texts are read whole. Columns other than doc_id, text and item_id are ignored, or
    kept, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._memory import released
from faultline.llm._store import bounded_batches, by_position, dropped, stored
from faultline.llm._text import ALNUM_WORDS, words_of

SEED = 5
COVERAGE = 0.6
#: Items that may have a seed before it counts as common.
COMMON = 64
#: Rows that are broadcast in a join.
BROADCAST_ROWS = 500_000
#: Bits of the bitmaps: 16 for each seed, at most 2 to this power.
MOST_BITS = 27


def tiles(place: np.ndarray, at: np.ndarray, length: int, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from shared seeds: (place in the item, place in the document, words) of each tile.

    The longest run goes first; of equals, the one first in the item, then first in the document.
    """
    order = np.lexsort((place, at - place))
    place, diagonal = place[order], (at - place)[order]
    breaks = np.flatnonzero((np.diff(place) != 1) | (np.diff(diagonal) != 0)) + 1
    first, last = np.concatenate(([0], breaks)), np.concatenate((breaks, [len(place)])) - 1
    heap = [(-int(place[b] - place[a] + seed), int(place[a]), int(place[a] + diagonal[a])) for a, b in zip(first, last)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(length, bool), set(), []
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        free = [not in_item[i + d] and j + d not in in_doc for d in range(size)]
        if all(free):
            in_item[i : i + size] = True
            in_doc.update(range(j, j + size))
            out.append((i, j, size))
            continue
        start = None
        for d, f in enumerate([*free, False]):
            if f and start is None:
                start = d
            elif not f and start is not None:
                if d - start >= seed:
                    heapq.heappush(heap, (start - d, i + start, j + start))
                start = None
    return out


def _seeds(column: pa.Array, short: list[int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, its words' number, places, hashes) of each row's k-grams.

    Of an item they have SEED words, or all words if these are fewer; of a document SEED words and each of the ``short``
    numbers of words that items have.
    """
    for low, _, w in words_of(column, ALNUM_WORDS):
        grams = {k: w.grams(k) for k in {SEED, *(short or ())}}
        for r, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
            n = b - a
            if not n:
                continue
            sizes = [min(n, SEED)] if short is None else [k for k in (SEED, *short) if k <= n]
            for k in sizes:
                if k not in grams:
                    grams[k] = w.grams(k)
            own = [grams[k][a : b - k + 1] for k in sizes]
            if own:
                yield low + r, n, np.concatenate([np.arange(len(x)) for x in own]), np.concatenate(own)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, sizes, found = [], [], []
        for r, n, _, grams in _seeds(batch.column(1)):
            rows.append(r)
            sizes.append(n)
            found.append(_signed(grams))
        bounds = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["item", "n_words", "seeds"])


def looked_for(seeds: np.ndarray, n_items: np.ndarray, n_words: int, coverage: float, common: int) -> np.ndarray:
    """The seeds by which an item is looked for, distinct; ``n_items`` says how many items have each."""
    rare = n_items <= common
    places = np.flatnonzero(~rare)
    covered = np.zeros(n_words + SEED + 1, np.int64)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + min(SEED, n_words), -1)
    if np.count_nonzero(np.cumsum(covered)) < coverage * n_words:
        return np.unique(seeds[rare])
    # A leak has tiles over so many words, and at least one seed for every SEED of them.
    least = max(1, math.ceil(coverage * n_words / SEED))
    return np.unique(seeds[np.argsort(n_items, kind="stable")[: len(seeds) - least + 1]])


def _looked_for(coverage: float, common: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, hashes = [], []
            for item, n_words, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                fields = entries.values.flatten()  # place, seed and count of each, in order of places
                own = _signed(np.empty(0, np.uint64)) if not len(entries.values) else looked_for(fields[1].to_numpy(), fields[2].to_numpy(), n_words, coverage, common)
                items += [item] * len(own)
                hashes.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hashes])), pa.array(items, pa.int64())], ["seed", "item"])

    return run


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """A bitmap of a column of hashes, put together from pieces that tasks make."""
    piece = min(bits, 1 << 16)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column(1):
                flags = np.zeros(piece, bool)
                flags[at.values.to_numpy()] = True
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["piece", "bits"])

    at = F.pmod("seed", F.lit(bits))
    pieces = seeds.select(F.floor(at / piece).cast("int").alias("piece"), (at % piece).cast("int").alias("bit")).groupBy("piece").agg(F.collect_set("bit").alias("bits"))
    out = np.zeros((bits // piece, piece // 8), np.uint8)
    for row in pieces.mapInArrow(packed, "piece int, bits binary").toArrow().to_pylist():
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.tobytes()


def _has_bit(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


HITS = "source long, asked array<long>, places binary, hashes binary"


def _hits(asked_bits: bytes, all_bits: bytes, short: list[int]):
    """Of each text with a seed that an item is looked for by: these seeds, and the places and hashes of all it may share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = np.frombuffer(asked_bits, np.uint8), np.frombuffer(all_bits, np.uint8)
        for batch in batches:
            rows, asked, places, hashes = [], [], [], []
            for r, _, place, grams in _seeds(batch.column(1), short):
                hit = _has_bit(by, grams)
                if hit.any():
                    at = np.flatnonzero(_has_bit(known, grams))
                    rows.append(r)
                    asked.append(_signed(np.unique(grams[hit])))
                    places.append(place[at].astype("<i4").tobytes())
                    hashes.append(grams[at].tobytes())
            bounds = pa.array(np.cumsum([0, *map(len, asked)]), pa.int32())
            lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *asked])))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), lists, pa.array(places, pa.binary()), pa.array(hashes, pa.binary())], ["source", "asked", "places", "hashes"])

    return run


def shared(seeds: np.ndarray, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the item, place in the document) of each shared seed.

    Of a run of one repeated word that is far longer than the item, the middle is left out: tiles cannot fill it.
    """
    most = 4 * len(seeds)
    new = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (places[1:] != places[:-1] + 1))))
    length = np.diff(np.append(new, len(hashes)))
    if (length > most).any():
        within = np.arange(len(hashes)) - np.repeat(new, length)
        keep = (within < most // 2) | (within >= np.repeat(length, length) - most // 2)
        places, hashes = places[keep], hashes[keep]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    low, high = np.searchsorted(ranked, seeds, "left"), np.searchsorted(ranked, seeds, "right")
    n = high - low
    at = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    return np.repeat(np.arange(len(seeds)), n), places[at]


FOUND = "source long, item long, coverage double, n_tiles int, longest_tile int, item_words int, reordered boolean"


def _tiled(coverage: float):
    """The pairs (source, places, hashes, item, n_words, seeds) that tiles cover enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, item, n_words, places, hashes, seeds in zip(*(batch.column(c).to_pylist() if c < 3 else batch.column(c) for c in range(6))):
                own = seeds.values.to_numpy().view(np.uint64)
                doc = np.frombuffer(hashes.as_buffer(), np.uint64)
                seed = min(SEED, n_words)
                hit = np.flatnonzero(np.isin(own, doc))
                covered = np.zeros(n_words + 1, np.int64)
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + seed, -1)
                if np.count_nonzero(np.cumsum(covered)) < coverage * n_words or not len(hit):
                    continue
                place, at = shared(own, np.frombuffer(places.as_buffer(), "<i4").astype(np.int64), doc)
                found = tiles(place, at, n_words, seed)
                share = sum(t[2] for t in found) / n_words
                if share >= coverage:
                    order = [j for _, j, _ in sorted(found)]
                    rows.append((source, item, share, len(found), max(t[2] for t in found), n_words, order != sorted(order)))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*rows)] or [[]] * 7, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _few(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_ROWS else table.hint("merge")


def _text(df: DataFrame) -> DataFrame:
    """(name, text) of the rows with a text; equal texts have the same name."""
    return df.select(F.col("text").cast("string").alias("text")).filter("text is not null").select(F.xxhash64("text").alias("name"), "text")


def leaked_texts(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_words: int = 1) -> DataFrame:
    """(source, item, coverage, n_tiles, longest_tile, item_words, reordered), stored: the leaks of each text, by the hashes of both texts."""
    bounded_batches(docs.sparkSession)
    items = _text(benchmark).dropDuplicates(["name"]).mapInArrow(released(_item_seeds), "item long, n_words int, seeds array<long>")
    items = stored(items.filter(F.col("n_words") >= least_words), "benchmark-items")
    # At most SEED - 1 numbers of words.
    n_seeds, short = items.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.array_sort(F.collect_set(F.when(F.col("n_words") < SEED, F.col("n_words"))))).first()
    places = items.select("item", "n_words", F.posexplode("seeds").alias("place", "seed"))
    counts = stored(places.groupBy("seed").agg(F.count_distinct("item").alias("n")), "benchmark-counts", small=True)
    entries = places.join(counts, "seed").groupBy("item", "n_words").agg(F.array_sort(F.collect_list(F.struct("place", "seed", "n"))).alias("entries"))
    index = stored(entries.mapInArrow(released(_looked_for(coverage, COMMON)), "seed long, item long"), "benchmark-index")
    bits = 1 << min(MOST_BITS, max(10, (16 * n_seeds).bit_length()))
    by, known = _bitmap(index.select("seed"), bits), _bitmap(counts.select("seed"), bits)
    hits = stored(_text(docs).withColumnRenamed("name", "source").mapInArrow(released(_hits(by, known, [*short])), HITS).dropDuplicates(["source"]), "benchmark-hits")
    pairs = hits.select("source", F.explode("asked").alias("seed")).join(_few(index, index.count()), "seed").select("source", "item").distinct()
    pairs = stored(pairs, "benchmark-pairs", small=True)
    both = pairs.join(_few(items, n_seeds), "item").join(hits.select("source", "places", "hashes"), "source")
    out = stored(both.select("source", "item", "n_words", "places", "hashes", "seeds").mapInArrow(released(_tiled(coverage)), FOUND), "benchmark-leaks")
    dropped(items, counts, index, hits, pairs)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_words: int = 1) -> DataFrame:
    """One row a document and item that leaked into it: doc_id, item_id, coverage, n_tiles, longest_tile, item_words, reordered.

    Items of fewer than ``least_words`` words are not looked for.
    """
    found = leaked_texts(docs, benchmark, coverage, least_words)
    n = found.count()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item")).filter("item_id is not null").distinct()
    own = ["coverage", "n_tiles", "longest_tile", "item_words", "reordered"]
    by_item = items.unionByName(benchmark.filter("item_id is null and text is not null").select(F.lit(None).cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item")).distinct())
    best = found.join(by_item, "item").groupBy("source", "item_id").agg(F.max(F.struct(*own)).alias("best"))
    best = stored(best.select("source", "item_id", "best.*"), "benchmark-leaked", small=True)
    dropped(found)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("source"))
    return texts.join(_few(best, n), "source").select("doc_id", "item_id", *own)


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` into which no item of at least ``least_words`` words leaked, with their columns."""
    found = leaked_texts(docs, benchmark, coverage, least_words)
    gone = stored(found.select("source").distinct(), "benchmark-gone", small=True)
    dropped(found)
    rows, name = by_position(docs)
    out = rows.join(_few(gone, gone.count()), F.xxhash64(F.col(name["text"]).cast("string")) == F.col("source"), "left_anti")
    return out.toDF(*docs.columns)
