"""MinHash near-duplicate detection with tensored banding.

A document's set is its distinct shingles of ``SHINGLE`` words (the whole word sequence where it is shorter).
Documents are linked when 100 * |intersection| >= ``percent`` * |union|.

Method
    Two small collections of minhash tuples, A and B, are computed (``2 * TABLES * WIDTH`` minhashes). A table key
    is a pair (A_i, B_j), so TABLES ** 2 tables come from 2 * TABLES tuples. A tuple no other document has can be in
    no shared key; such tuples go first, so a document without a relative makes no key at all. At a similarity of
    0.75 a pair shares a key with probability (1 - (1 - 0.75 ** WIDTH) ** TABLES) ** 2 = 0.9999.

    Equal sets are one class, represented by its smallest doc_id. Members of a key are first linked to the key's
    smallest member (a star, not all pairs); each class keeps its best such candidate and the link is confirmed on
    the full sets. Keys whose members are by then in one component can tell nothing more. For the others this is done
    again with candidates in other components, and the members of the keys that still join several go through an
    exact prefix-filter join for links across components, which are confirmed likewise. So no pair within a key or a
    component is ever listed, and only links whose documents share no key at all are missed.
    What is counted by key is written before it is joined back, so both sides of each join come from a plain exchange
    and Spark splits a key that holds very many rows.

    A table is deleted as soon as nothing reads it any more.

Cases
    Null or empty text, or text without words: empty set, n_shingles 0, linked with nothing. Rows that share a doc_id
    are one node, whatever their texts: all of them are in one component, which joins what any of them is linked with.
    Null doc_id: a row that takes no part, component_id null, kept true. Columns other than doc_id and text are
    ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm._memory import by_batch, released
from faultline.llm._store import bounded_batches, by_position, dropped, stored
from faultline.llm._text import CACHED_BYTES, SPACE_WORDS, mix, words_of
from faultline.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
#: Tuples in each of the two collections, and minhashes in a tuple.
TABLES, WIDTH = 12, 2
#: A star whose minhashes agree in so few places that a pair to be linked does so with this probability is not confirmed; its keys stay open for what follows.
MISSED = 1e-3
#: Rounds of stars across components before the exact join.
STAR_ROUNDS = 1
#: Candidates of a class that are confirmed in such a round, the most alike by minhashes.
STAR_CANDIDATES = 4
#: Candidate ids that are broadcast as a filter of the documents (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 1 << 63, 2 * TABLES * WIDTH, dtype=np.uint64) * np.uint64(2)
_MUL = _rng.integers(0, 1 << 63, 2 * TABLES * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, 2 * TABLES, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, sizes, sets one after another), each set sorted and distinct."""
    for low, high, w in words_of(column, SPACE_WORDS, limit=CACHED_BYTES):
        grams = w.grams(SHINGLE)
        sets = []
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            n = b - a
            if n >= SHINGLE:
                s = np.sort(grams[a : b - SHINGLE + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                sets.append(s)
            elif n:
                h = np.uint64(n)
                for x in w.hash[a:b]:
                    h = mix(np.array([h]) * np.uint64(31) + x)[0]
                sets.append(np.array([h], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield low, high, np.array([len(s) for s in sets]), np.concatenate(sets)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


FEATURES = "doc_id long, n_shingles long, s1 long, s2 long, tuples array<long>, sketch array<long>"


def _features(tables: int):
    """Sums of each set, its 2 * ``tables`` tuples, and a byte of each minhash, eight to a number."""
    n_hashes = 2 * tables * WIDTH
    n_words = -(-n_hashes // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, sizes, values in shingle_sets(batch.column(1)):
                n = high - low
                full = np.flatnonzero(sizes)
                s1, s2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                tuples, sketch = np.zeros((n, 2 * tables), np.uint64), np.zeros((n, 8 * n_words), np.uint8)
                if len(full):
                    at = np.cumsum(sizes[full]) - sizes[full]
                    s1[full] = np.add.reduceat(mix(values ^ np.uint64(0xA5)), at)
                    s2[full] = np.bitwise_xor.reduceat(mix(values + np.uint64(0x5A)), at)
                    least = np.empty((len(full), n_hashes), np.uint64)
                    hashes = np.empty_like(values)
                    for k in range(n_hashes):
                        np.bitwise_xor(values, _XOR[k], out=hashes)
                        hashes *= _MUL[k]
                        least[:, k] = np.minimum.reduceat(hashes, at)
                    least = mix(least)
                    sketch[full, :n_hashes] = (least >> np.uint64(17)).astype(np.uint8)
                    joined = _SALT[None, : 2 * tables].repeat(len(full), 0)
                    for j in range(WIDTH):
                        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + least[:, j::WIDTH])
                    tuples[full] = joined
                lists, bytes_ = (pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), _signed(x.ravel())) for k, x in ((2 * tables, tuples), (n_words, sketch.view(np.uint64))))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, n), pa.array(sizes, pa.int64()), _signed(s1), _signed(s2), lists, bytes_],
                    ["doc_id", "n_shingles", "s1", "s2", "tuples", "sketch"],
                )

    return run


def least_agreeing(n: int, percent: int) -> int:
    """The smallest number of ``n`` minhashes that fewer of a linked pair agree in with a probability of at most MISSED."""
    p, total = percent / 100, 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total > MISSED:
            return k
    return n


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, sizes, values in shingle_sets(batch.column(1)):
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([values[e - s : e].tobytes() for e, s in zip(ends, sizes)], pa.binary())], ["doc_id", "shingles"])


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component, size, tokens) of stored sets."""
    for batch in batches:
        raw = batch.column(2)
        sizes = np.array([len(x.as_buffer()) // 8 for x in raw], np.int64)
        values = np.frombuffer(b"".join(x.as_py() for x in raw), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), lists], ["id", "component", "size", "tokens"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                n, m = len(x), len(y)
                if min(n, m) * 100 < percent * max(n, m):
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (n + m - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(x: str, y: str, n: int):
    """Places in which two sketches of ``n`` bytes agree: all but the bytes that differ in any bit."""
    differ = F.lit(0)
    for i in range(-(-n // 8)):
        bits = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        for shift, kept in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift)).bitwiseAND(F.lit(kept))
        differ = differ + F.bit_count(bits)
    return F.lit(n) - differ


def _selected(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of stored ``ids`` (doc_id), which are broadcast if they are few enough."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"), "doc_id", "left_semi")


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full ``sets`` are similar enough; stored.

    Few enough pairs are broadcast to the sets, so that a set moves only to its partner, and only if it has one.
    """
    pairs = stored(pairs, f"{name}-pairs", small=True)
    few = pairs.count() <= BROADCAST_IDS
    own = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).join(F.broadcast(pairs) if few else pairs, "b")
    first = pairs.select("a").distinct()
    first = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).join(F.broadcast(first) if few else first.hint("merge"), "a", "left_semi")
    links = stored(own.join(first.hint("merge"), "a").select("a", "b", "x", "y").mapInArrow(released(_confirm(percent)), "a long, b long").distinct(), name)
    dropped(pairs)
    return links


def _surviving_keys(classes: DataFrame, tables: int) -> DataFrame:
    """(id, key) of each table key both of whose tuples another class has too; stored."""
    tuples = classes.select("id", F.posexplode("tuples").alias("t", "h"))
    shared = stored(tuples.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "near-shared-tuples")
    own = tuples.join(shared, "h", "left_semi").groupBy("id").agg(F.collect_list(F.struct("t", "h")).alias("own"))
    own = own.select("id", F.expr(f"filter(own, x -> x.t < {tables})").alias("a"), F.expr(f"filter(own, x -> x.t >= {tables})").alias("b"))
    keys = stored(own.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b")).select("id", F.xxhash64("a.h", "b.h").alias("key")), "near-keys")
    dropped(shared)
    return keys


def _open_rows(keys: DataFrame, component: DataFrame, turn: int, name: str, make) -> DataFrame:
    """``make`` of (key, id, component, a) of keys that join two components or more, stored; a is a member in another component than the row's.

    It is one of the key's members by a hash that is another each turn or, for rows of that one's component, one of the
    key's first or last component.
    """
    rows = stored(keys.select("id", "key").join(component, "id"), "near-open-rows", small=True)
    lot = F.xxhash64("id", "key", F.lit(turn))
    ends = rows.groupBy("key").agg(
        F.min("component").alias("c0"),
        F.max("component").alias("c1"),
        F.min_by("id", F.struct(F.col("component"), lot)).alias("a0"),
        F.min_by("id", F.struct(-F.col("component"), lot)).alias("a1"),
        F.min_by(F.struct("id", "component"), lot).alias("any"),
    )
    ends = stored(ends.filter("c0 <> c1"), "near-open-keys", small=True)
    other = F.when(F.col("component") != F.col("any.component"), F.col("any.id")).when(F.col("component") != F.col("c0"), F.col("a0")).otherwise(F.col("a1"))
    out = stored(make(rows.join(ends, "key").select("key", "id", "component", other.alias("a"))), name, small=True)
    dropped(rows, ends)
    return out


def _merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after ``links`` (a, b) between ids; stored in place of ``component``."""
    ends = links.join(component.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(component.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    tops = connected_components(component.select(F.col("component").alias("id")).distinct(), ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    out = stored(component.join(tops.select(F.col("id").alias("component"), F.col("component").alias("top")), "component").select("id", F.col("top").alias("component")), "near-components", small=True)
    dropped(component, links)
    return out


def _prefix_pairs(sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) across components that may be similar enough, by prefix, size and position filters, and the tables they are made of.

    ``sets`` has id, component, size and tokens. Tokens are ordered from the rarest to the most common; two sets that
    overlap enough have their first common token within a short prefix of each, at places that leave enough to
    overlap. Tokens that one set alone has only move the others' places, so they are never sent anywhere. Sets of a
    pair are of one band of sizes or of neighbouring ones, so a common token meets in its band alone.
    """
    rows = sets.select("id", "component", "size", F.explode("tokens").alias("token"))
    shared = stored(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared-tokens")
    ordered = rows.join(shared, "token").groupBy("id", "component", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("order"))
    placed = ordered.select("id", "component", "size", (F.col("size") - F.size("order")).alias("own"), F.posexplode("order").alias("place", "x")).select("id", "component", "size", F.col("x.token").alias("token"), (F.col("own") + F.col("place")).alias("place"))
    # The larger set of a pair looks in its prefix for percent, the smaller one in that for equal sizes.
    placed = stored(placed.filter(100 * F.col("place") <= (100 - percent) * F.col("size")), "near-placed")
    crossing = stored(placed.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("token"), "near-crossing", small=True)
    crossed = stored(placed.join(crossing, "token", "left_semi"), "near-crossing-placed")
    dropped(shared, placed, crossing)
    # A band is twice as wide as a pair's sizes may be apart, so the smaller one is in the larger one's band or the next.
    band = F.floor(F.ln("size") / (2 * math.log(100 / percent))).cast("int") if percent < 100 else F.lit(0)
    large = crossed.withColumn("band", F.explode(F.array(band - 1, band))).select("token", "band", *[F.col(c).alias(f"{c}_a") for c in ("id", "component", "size", "place")])
    small = crossed.filter((100 + percent) * F.col("place") <= (100 - percent) * F.col("size")).withColumn("band", band).select("token", "band", *[F.col(c).alias(f"{c}_b") for c in ("id", "component", "size", "place")])
    near = (
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("id_a") > F.col("id_b"))))
        & (100 * F.col("size_b") >= percent * F.col("size_a"))
        & ((100 + percent) * F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= percent * (F.col("size_a") + F.col("size_b")))
    )
    return large.join(small, ["token", "band"]).filter(near).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), [crossed]


def near_duplicates(docs: DataFrame, percent: int = PERCENT, tables: int = TABLES, star_rounds: int | None = None, repeated_ids: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept (doc_id = component_id), one row a row of ``docs``.

    The result reads the stored tables in its ``reads``. ``tables`` (at most TABLES) is the number of tuples of either collection. With ``star_rounds``, so many rounds of
    stars across components take the place of the exact join: components are then those of the links that stars find.
    Without ``repeated_ids`` rows that share a doc_id must have the same text; nothing is then looked for that links them.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = stored(docs.mapInArrow(released(by_batch(_features(tables))), FEATURES), "near-features")
    nodes = feats.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(nodes.groupBy("s1", "s2", "n_shingles").agg(F.min_by(F.struct("doc_id", "tuples", "sketch"), "doc_id").alias("r")).select("s1", "s2", "n_shingles", F.col("r.doc_id").alias("id"), "r.tuples", "r.sketch"), "near-classes")
    keys = _surviving_keys(classes, tables)

    sketches = classes.select("id", "sketch")
    n_hashes = 2 * tables * WIDTH
    least = least_agreeing(n_hashes, percent)

    def plausible(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b")
        return pairs.withColumn("agree", _agreeing("x", "y", n_hashes)).filter(F.col("agree") >= least).select("a", "b", "agree")

    # Rows that share a doc_id are one node: such an id links the classes it is in.
    if repeated_ids:
        repeated = stored(feats.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "near-repeated", small=True)
    some_repeated = repeated_ids and not repeated.isEmpty()

    # Stars: each class with the smallest member of each of its keys; the best candidate is confirmed first.
    first = stored(keys.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "a"), "near-first", small=True)
    stars = keys.join(first, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = plausible(stars).groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
    keyed = stored(keys.select(F.col("id").alias("doc_id")).distinct(), "near-keyed", small=True)
    sets = stored(_selected(docs, keyed).mapInArrow(released(by_batch(_sets)), "doc_id long, shingles binary"), "near-sets")
    links = _confirmed(sets, stars, percent, "near-links")
    ids, both = keyed.select(F.col("doc_id").alias("id")), links
    if some_repeated:
        own = nodes.join(repeated, "doc_id", "left_semi").join(classes.select("s1", "s2", "n_shingles", "id"), ["s1", "s2", "n_shingles"]).select("id", "doc_id")
        same = stored(own.filter("id <> doc_id").distinct().toDF("a", "b"), "near-same-id", small=True)
        ids, both = ids.union(same.select("a")).union(same.select("b")), links.union(same)
    component = stored(connected_components(ids.distinct(), both), "near-components", small=True)
    dropped(first, keyed, links, *([same] if some_repeated else []))

    # Again for the keys that still join several components, with members of other components.
    for turn in range(STAR_ROUNDS if star_rounds is None else star_rounds):
        again = _open_rows(keys, component, turn, "near-again", lambda rows: rows.select("a", F.col("id").alias("b")).distinct())
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
        links = _confirmed(sets, plausible(again).withColumn("best", best).filter(F.col("best") <= STAR_CANDIDATES).select("a", "b"), percent, "near-links")
        component = _merged(component, links)
        dropped(again)

    if star_rounds is None:
        # Members of the keys that are left: every pair of them across components, by an exact join.
        open_ = _open_rows(keys, component, 0, "near-open", lambda rows: rows.select("id", "component").distinct())
        lists = stored(open_.join(sets.withColumnRenamed("doc_id", "id"), "id").select("id", "component", "shingles").mapInArrow(released(_token_lists), "id long, component long, size long, tokens array<long>"), "near-open-sets")
        pairs, made_of = _prefix_pairs(lists, percent)
        links = _confirmed(sets, pairs, percent, "near-links")
        dropped(open_, lists, *made_of)
        component = _merged(component, links)
    dropped(keys, sets)

    # Each row by its class, each class by its component.
    labels = stored(classes.join(component, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component_id")), "near-labels", small=True)
    dropped(classes)
    out = nodes.select("doc_id", "n_shingles", "s1", "s2").join(labels, ["s1", "s2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(feats.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    if some_repeated:
        # A row without words is with the other rows of its id.
        top = stored(out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("top")), "near-tops", small=True)
        out = out.join(top, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("top", "component_id").alias("component_id"))
    out = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    out.reads = [feats, labels, *([repeated] if repeated_ids else []), *([top] if some_repeated else [])]
    return out


def one_of_each_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group, with their columns.

    Rows that share a doc_id are one document, of which one row stays: the one whose text comes first, of equal texts
    the one whose other columns, as JSON, come first. A null doc_id stays.
    """
    verdicts = near_duplicates(docs, percent)
    found = stored(verdicts, "near-verdicts", small=True)
    dropped(*verdicts.reads)
    gone = found.filter("not kept").select("doc_id").distinct()
    rows, name = by_position(docs)
    key = name["doc_id"]
    gone = gone.withColumnRenamed("doc_id", "gone")
    same = F.col(key).cast("long") == F.col("gone")
    out = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("merge"), same, "left_anti")
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("gone"))
    if not again.isEmpty():
        order = Window.partitionBy(key).orderBy(F.col(name["text"]).cast("string").asc_nulls_first(), F.to_json(F.struct(*rows.columns)))
        first = out.join(again, same, "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")
        out = out.join(again, same, "left_anti").unionByName(first)
    return out.toDF(*docs.columns)
