"""Line deduplication with a log-template tree.

Units
    Lines of at least ``MIN_TOKENS`` tokens, and the sentences of at least ``SENTENCE_TOKENS`` tokens in lines of several,
    so that a passage set into a longer line is found too. Tokens with a digit are variable fields from the start.

Method
    Units are parsed by a tree of fixed depth: the number of tokens, then the first ``DEPTH`` tokens. Below them a token
    that fewer than the required number of documents have at its place of the leaf can be no fixed part of a recurring
    template, so it is a variable field. Of the other tokens one more may be variable. A unit so has a template for its
    rare tokens and one for each further place, as long as ``SIMILAR_PERCENT`` of its tokens stay fixed; units of the same fixed
    tokens share a template. A unit goes if it, or a template it has, recurs in ``MIN_DOCS`` documents or more
    (``MIN_DOCS_SHORT`` if it is short). Short sentences between two of a line that go do so too if the whole run, from the
    first of the two to the second, recurs as it is in ``MIN_DOCS`` documents; they stay if only what is around them does.
    Documents that are near copies of each other count as one family: the component of the links that near-duplicate
    detection confirms on shingle sets, among the documents with a unit that might recur (no other document can tell
    whether it does). The number of families alone decides, so copying a document does not make its lines boilerplate,
    nor do copies keep a line that recurs elsewhere. A document that would lose all its words is left as it is if it has
    a copy, equal or near; copies are for near-duplicate detection to judge.

    Everything is counted by key with partial aggregation, so neither a line in a third of all documents nor a leaf of any
    number of lines is in one task. Of a unit's families the first ``MIN_DOCS_SHORT`` are enough to tell whether its
    templates recur. Hashes are broadcast if there are at most ``BROADCAST_LINES`` of them, and joined otherwise.

Cases
    Null text stays null and empty text empty, with no lines. Shorter lines are kept, as is the white space between kept
    units. Repeated rows and null doc_ids are treated row by row; equal texts are one document when documents are
    counted. Empty table: no rows. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm._memory import by_batch, released
from faultline.llm._store import bounded_batches, by_position, dropped, stored
from faultline.llm._text import BASE, BASE_INVERSE, CACHED_BYTES, SPACE_WORDS, Words, chunks, mapped, mix, power_table, utf8, words_of
from faultline.llm.near_dedup import near_duplicates

DEPTH, SIMILAR_PERCENT = 4, 80
MIN_TOKENS, SENTENCE_TOKENS, LONG_TOKENS = 3, 8, 8
MIN_DOCS, MIN_DOCS_SHORT = 3, 8
BROADCAST_LINES = 1_000_000
#: Tuples of either collection when families are looked for: a pair of similarity 0.75 shares a key with a probability of 0.997, and families have several pairs.
FAMILY_TABLES = 8
#: Rounds of stars across components in which families grow together, after the first one within keys.
FAMILY_ROUNDS = 1
_U = np.uint64
_VARIABLE = _U(0x5851F42D4C957F2D)
_STOP = np.zeros(256, bool)
_STOP[[*b".!?"]] = True


class Units:
    """Lines and sentences of some rows as ranges of words: ``first``, ``last`` (past the end), ``hash``, ``row``,
    ``leaf``, ``is_line``. Order: lines, then sentences of lines of several."""

    def __init__(self, w: Words):
        n, data = len(w.hash), w.raw
        # The words that hold a digit, and those that a line break stands before.
        self.tokens = w.hash.copy()
        self.tokens[np.searchsorted(w.start, np.flatnonzero((data - np.uint8(0x30)) < 10), "right") - 1] = _VARIABLE
        after_break = np.searchsorted(w.start, np.flatnonzero(data == 10))
        self.word_row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        new_line = np.ones(n, bool)
        new_line[1:] = self.word_row[1:] != self.word_row[:-1]
        new_line[after_break[after_break < n]] = True
        new_sentence = new_line.copy()
        new_sentence[1:] |= _STOP.take(data.take(w.end[:-1] - 1), mode="clip")
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.tokens * power_table("power", BASE, n + 1)[:n], out=self.total[1:])
        self.inverse = power_table("inverse", BASE_INVERSE, n + 1)
        lines, sentences = np.flatnonzero(new_line), np.flatnonzero(new_sentence)
        line_end, sentence_end = np.append(lines[1:], n)[: len(lines)], np.append(sentences[1:], n)[: len(sentences)]
        self.sentences, self.sentence_end = sentences, sentence_end
        self.lines, self.line_end = lines, line_end
        size = sentence_end - sentences
        whole = new_line[sentences] & (np.append(new_line, True)[sentence_end])
        part = (size >= SENTENCE_TOKENS) & ~whole
        long = (line_end - lines) >= MIN_TOKENS
        self.first = np.concatenate((lines[long], sentences[part]))
        self.last = np.concatenate((line_end[long], sentence_end[part]))
        self.row = self.word_row[self.first] if n else np.zeros(0, np.int64)
        self.hash = self.of(self.first, self.last).view(np.int64)
        self.is_line = np.arange(len(self.first)) < long.sum()
        self.leaf = self.of(self.first, np.minimum(self.first + DEPTH, self.last), self.last - self.first).view(np.int64)

    def before_short(self) -> np.ndarray:
        """Which units are sentences that short ones of the line follow, and then one that is not short."""
        size = self.sentence_end - self.sentences
        long = np.flatnonzero(size >= SENTENCE_TOKENS)
        line = np.searchsorted(self.lines, self.sentences[long], "right")
        mark = np.zeros(len(self.tokens) + 1, bool)
        mark[self.sentences[long[:-1][(np.diff(long) > 1) & (line[1:] == line[:-1])]]] = True
        return mark[self.first] & ~self.is_line

    def of(self, first: np.ndarray, last: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """Hash of words first .. last - 1 and their number (or another)."""
        return mix((self.total[last] - self.total[first]) * self.inverse[first] + (last - first if count is None else count).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


UNITS = "line long, leaf long, n int, source long, before_short boolean"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different units of each document, with a hash of the whole text."""
    for batch in batches:
        sources = batch.column(0).to_numpy(zero_copy_only=False)
        for low, _, w in words_of(batch.column(1), SPACE_WORDS, limit=CACHED_BYTES):
            u = Units(w)
            order = np.lexsort((u.hash, u.row))
            row, line = u.row[order], u.hash[order]
            keep = np.ones(len(order), bool)
            keep[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
            at = order[keep]
            before = np.logical_or.reduceat(u.before_short()[order], np.flatnonzero(keep)) if len(at) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(u.hash[at]), pa.array(u.leaf[at]), pa.array((u.last - u.first)[at], pa.int32()), pa.array(sources[low + u.row[at]], pa.int64()), pa.array(before)], ["line", "leaf", "n", "source", "before_short"])


def _pairs(row: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of each row and line."""
    return mix(mix(row.astype(np.uint64)) ^ line.view(np.uint64))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, tokens as 32-bit hashes) of the units of each text that are in its list of wanted ones."""
    for batch in batches:
        lists = batch.column(1)
        wanted = np.sort(_pairs(np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy().astype(np.int64)))
        for low, _, w in words_of(batch.column(0), SPACE_WORDS, limit=CACHED_BYTES):
            u = Units(w)
            at = np.flatnonzero(_in(wanted, _pairs(low + u.row, u.hash)))
            at = at[np.unique(u.hash[at], return_index=True)[1]]
            first, n = u.first[at], (u.last - u.first)[at]
            bounds = np.concatenate(([0], np.cumsum(n)))
            tokens = (u.tokens[np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])] >> _U(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.hash[at]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(tokens))], ["line", "tokens"])


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def template_keys(leaf: np.ndarray, n: np.ndarray, tokens: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of units' templates, those of their rare tokens and those of one further variable place, and the unit of each.

    ``tokens`` of all units follow one another, ``n`` of each; ``rare`` says which are.
    """
    if not len(n):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, unit = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    place = np.arange(len(tokens)) - start[unit]
    spare = (100 - SIMILAR_PERCENT) * n // 100 - np.add.reduceat(rare.astype(np.int64), start)
    power = power_table("power", BASE, int(n.max()))[place]
    fixed = mix(np.where(rare, _VARIABLE, tokens.astype(np.uint64))) * power
    base = leaf.view(np.uint64) + np.add.reduceat(fixed, start)
    alone, at = np.flatnonzero(spare >= 0), np.flatnonzero(~rare & (place >= DEPTH) & (spare > 0)[unit])
    further = base[unit[at]] - fixed[at] + mix(np.array([_VARIABLE])) * power[at]
    return mix(np.concatenate((base[alone], further))).view(np.int64), np.concatenate((alone, unit[at]))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, n, docs) of each unit's templates, from rows (line, leaf, tokens, docs, places of common ones)."""
    for batch in batches:
        line, leaf = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        n, n_common = (pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy().astype(np.int64) for i in (2, 4))
        tokens, start = batch.column(2).flatten().to_numpy(), np.cumsum(n) - n
        rare = np.arange(len(tokens)) - np.repeat(start, n) >= DEPTH
        rare[np.repeat(start, n_common) + batch.column(4).flatten().to_numpy()] = False
        keys, unit = template_keys(leaf, n, tokens, rare)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(line[unit]), pa.array(n[unit], pa.int32()), pa.array(batch.column(3).to_numpy()[unit])], ["key", "line", "n", "docs"])


def _enough(docs: str):
    return F.col(docs) >= F.when(F.col("n") >= LONG_TOKENS, MIN_DOCS).otherwise(MIN_DOCS_SHORT)


def _source(text: str = "text"):
    return F.xxhash64(text)


def _few(table: DataFrame, n: int) -> DataFrame:
    """``table`` for a join, broadcast if its ``n`` rows are few enough."""
    return F.broadcast(table) if n <= BROADCAST_LINES else table.hint("merge")


def units_of(docs: DataFrame) -> DataFrame:
    """(line, leaf, n, source): the different units of each row's text, stored; equal texts have the same source."""
    bounded_batches(docs.sparkSession)
    text = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").select(_source().alias("source"), "text")
    return stored(text.mapInArrow(released(by_batch(_units)), UNITS), "lines")


class Candidates:
    """Units that might recur, and the families of the texts that have them. ``drop`` deletes its tables.

    With ``exact``, families are the components of all links that near-duplicate detection finds.
    """

    def __init__(self, docs: DataFrame, seen: DataFrame, exact: bool = False):
        # A unit might recur if its leaf has enough rows, in two texts or more: either it has them alone, or others of the leaf could make up a template with it.
        by_leaf = seen.groupBy("leaf", "n").agg(F.count(F.lit(1)).alias("rows"), F.min("source").alias("s0"), F.max("source").alias("s1"))
        leaves = stored(by_leaf.filter((F.col("s0") != F.col("s1")) & _enough("rows")).select("leaf", "n"), "lines-leaves", small=True)
        of = seen.join(_few(leaves, leaves.count()), ["leaf", "n"], "left_semi").groupBy("line", "leaf", "n", "source").agg(F.max("before_short").alias("before_short"))
        #: (line, leaf, n, source, before_short): the texts of each unit that might recur.
        self.texts_of = stored(of, "lines-carried")
        dropped(leaves)
        carried = self.texts_of
        self.sources = stored(carried.select("source").distinct(), "lines-sources", small=True)
        self.n_sources = self.sources.count()
        text = docs.select(F.col("text").cast("string").alias("text")).withColumn("source", _source()).join(_few(self.sources, self.n_sources), "source", "left_semi")
        # Read several times: where they are few it is a scan with a filter, else they are gathered once.
        self.text = text if self.n_sources <= BROADCAST_LINES else stored(text, "lines-texts")
        near = near_duplicates(self.text.select(F.col("source").alias("doc_id"), "text"), repeated_ids=False, **({} if exact else {"tables": FAMILY_TABLES, "star_rounds": FAMILY_ROUNDS}))
        found = stored(near.groupBy("doc_id").agg(F.min("component_id").alias("family"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("doc_id", "source"), "lines-families", small=True)
        large = stored(found.groupBy("family").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("family", F.lit(True).alias("copied")), "lines-copied", small=True)
        #: (source, family, copied): copied says whether more than one row is in the family.
        self.family = stored(found.join(large, "family", "left").select("source", "family", F.coalesce("copied", F.lit(False)).alias("copied")), "lines-families", small=True)
        dropped(found, large, *near.reads)
        #: (line, leaf, n, family, source), the families of each line, each once, with a text that has it.
        of = carried.join(_few(self.family.select("source", "family"), self.n_sources), "source").groupBy("line", "leaf", "n", "family").agg(F.min("source").alias("source"))
        self.carried = stored(of, "lines-families-of", small=True)

    def drop(self) -> None:
        """All but ``texts_of`` and ``family``."""
        dropped(self.sources, self.carried, *([self.text] if self.n_sources > BROADCAST_LINES else []))


def recurring_lines(candidates: Candidates) -> DataFrame:
    """(line): the hashes of the units that go; stored."""
    carried = candidates.carried
    alone = carried.groupBy("line", "n").agg(F.count(F.lit(1)).alias("docs")).filter(_enough("docs")).select("line")
    # Leaves of several units that enough families have.
    wide = carried.groupBy("leaf", "n").agg(F.min("line").alias("l0"), F.max("line").alias("l1"), F.count_distinct("family").alias("docs")).filter((F.col("l0") != F.col("l1")) & _enough("docs")).select("leaf", "n")
    wide = stored(wide, "lines-wide", small=True)
    few = stored(
        carried.join(_few(wide, wide.count()), ["leaf", "n"], "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("line").orderBy("family"))).filter(F.col("place") <= MIN_DOCS_SHORT).select("line", "leaf", "n", "family", "source"),
        "lines-few", small=True)
    units = stored(few.groupBy("line", "leaf", "n").agg(F.count(F.lit(1)).alias("docs"), F.min("source").alias("source")), "lines-units", small=True)
    n_units = units.count()
    # One text of each unit is read for its tokens; copies of that text give them again.
    wanted = units.groupBy("source").agg(F.collect_list("line").alias("wanted"))
    text = candidates.text.join(_few(wanted, n_units), "source").select("text", "wanted")
    tokens = text.mapInArrow(released(by_batch(_tokens)), "line long, tokens array<long>").dropDuplicates(["line"])
    tokens = stored(units.drop("source").join(tokens, "line"), "lines-tokens")
    places = tokens.select("line", "leaf", "n", "docs", F.posexplode("tokens").alias("place", "token")).filter(F.col("place") >= DEPTH)
    # Tokens that enough documents have at their place are far fewer than the rare ones.
    common = stored(places.groupBy("leaf", "n", "place", "token").agg(F.sum("docs").alias("docs")).filter(_enough("docs")).select("leaf", "n", "place", "token"), "lines-common", small=True)
    masks = places.join(_few(common, common.count()), ["leaf", "n", "place", "token"], "left_semi").groupBy("line").agg(F.collect_list("place").alias("common"))
    keys = tokens.select("line", "leaf", "tokens", "docs").join(masks, "line", "left").mapInArrow(released(_keyed), "key long, line long, n int, docs long")
    keys = stored(keys, "lines-keys")
    # Several units, which have families enough between them should no two share one.
    shared = keys.groupBy("key").agg(F.min("line").alias("l0"), F.max("line").alias("l1"), F.max("n").alias("n"), F.sum("docs").alias("docs")).filter((F.col("l0") != F.col("l1")) & _enough("docs")).select("key")
    members = stored(keys.select("key", "line").join(shared, "key", "left_semi"), "lines-members", small=True)
    often = members.join(few.select("line", "n", "family"), "line").select("key", "n", "family").distinct().groupBy("key", "n").agg(F.count(F.lit(1)).alias("docs")).filter(_enough("docs")).select("key")
    out = stored(alone.union(members.join(often, "key", "left_semi").select("line")).distinct(), "lines-recurring", small=True)
    dropped(wide, few, units, tokens, common, keys, members)
    return out


def _between(go: np.ndarray, short: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sentences of a line that go, with nothing between them but short ones that don't."""
    at = np.flatnonzero(go).tolist()
    return [(x, y) for x, y in zip(at[:-1], at[1:]) if y > x + 1 and short[x + 1 : y].all()]


def _dropped(u: Units, n: int, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By first word: which lines and which sentences go."""
    line, sentence = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    line[u.first[gone & u.is_line]] = True
    sentence[u.first[gone & ~u.is_line]] = True
    return line, sentence


def _by_line(u: Units, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's first sentence and the number of its sentences that go."""
    starts = np.searchsorted(u.sentences, u.lines)
    return starts, np.add.reduceat(sentence[u.sentences].astype(np.int64), starts) if len(starts) else starts


def _runs(column: pa.Array, sources: np.ndarray, gone_of) -> Iterator[tuple[int, int]]:
    """(hash, source) of each run of short sentences, with those on either side that go."""
    for low, _, w in words_of(column, SPACE_WORDS, limit=CACHED_BYTES):
        u = Units(w)
        line, sentence = _dropped(u, len(w.hash), gone_of(low + u.row, u.hash))
        starts, go = _by_line(u, sentence)
        for i in np.flatnonzero(~line[u.lines] & (go > 1)).tolist():
            a, b = int(starts[i]), int(starts[i + 1]) if i + 1 < len(starts) else len(u.sentences)
            firsts, ends = u.sentences[a:b], u.sentence_end[a:b]
            for x, y in _between(sentence[firsts], (ends - firsts) < SENTENCE_TOKENS) if b > a + 2 else ():
                yield int(u.of(firsts[x : x + 1], ends[y : y + 1]).view(np.int64)[0]), int(sources[low + u.word_row[firsts[x]]])


def _cuts(u: Units, w: Words, gone: np.ndarray, copied: np.ndarray, whole_run) -> dict[int, tuple[list[tuple[int, int]], int]]:
    """By row: byte ranges of the row's text to cut, and the units that go.

    ``gone`` says which units do, ``copied`` which rows are not to lose all words, ``whole_run`` whether a run recurs, by row and hash.
    """
    dropped_line, dropped_sentence = _dropped(u, len(w.hash), gone)
    starts, go = _by_line(u, dropped_sentence)
    changed, bounds = dropped_line[u.lines] | (go > 0), np.searchsorted(u.lines, w.bounds).tolist()
    out: dict[int, tuple[list[tuple[int, int]], int]] = {}
    # Lines of which nothing goes are left as they are; of the others, the bytes from the one break to the other.
    at = np.flatnonzero(changed)
    row, word = u.word_row[u.lines[at]], w.start[u.lines[at]]
    breaks = np.concatenate(([-1], np.flatnonzero(w.raw == 10), [len(w.raw)]))
    k = np.searchsorted(breaks, word)
    begins, ends_at = np.maximum(breaks[k - 1] + 1, w.offsets[row]) - w.offsets[row], np.minimum(breaks[k], w.offsets[row + 1]) - w.offsets[row]
    places = list(zip(at.tolist(), begins.tolist(), ends_at.tolist(), dropped_line[u.lines[at]].tolist()))
    first_of = np.searchsorted(row, np.arange(len(w.bounds))).tolist()
    for r in np.unique(row).tolist():
        begin, low, high = int(w.offsets[r]), first_of[r], first_of[r + 1]
        cuts, count, left = [], 0, high - low < bounds[r + 1] - bounds[r]
        for i, line_start, line_end, whole in places[low:high]:
            if whole:
                cuts.append((line_start, line_end + 1))
                count += 1
                continue
            s_low, s_high = starts[i], starts[i + 1] if i + 1 < len(starts) else len(u.sentences)
            firsts, ends = u.sentences[s_low:s_high], u.sentence_end[s_low:s_high]
            go = dropped_sentence[firsts].copy()
            count += int(go.sum())
            for x, y in _between(go, (ends - firsts) < SENTENCE_TOKENS):
                if whole_run(r, u.of(firsts[x : x + 1], ends[y : y + 1]).view(np.int64)[0]):
                    go[x + 1 : y] = True
            if go.all():
                cuts.append((line_start, line_end + 1))
                continue
            for j in np.flatnonzero(go).tolist():
                last = int(w.start[firsts[j + 1]]) - begin if j + 1 < len(firsts) else line_end
                cuts.append((int(w.start[firsts[j]]) - begin, last))
            left = True
        if cuts and (left or not copied[r]):
            out[r] = (cuts, count)
    return out


def _lines_with_words(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Lines of each row that are not blank."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    begins = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1])
    begins = begins[begins < len(data)]
    full = np.concatenate(([0], np.cumsum(np.logical_or.reduceat(mapped(data, SPACE_WORDS), begins))))
    at = np.searchsorted(begins, offsets)
    return full[at[1:]] - full[at[:-1]]


def _rewritten(column: pa.Array, look: np.ndarray, copied: np.ndarray, gone_of, whole_run) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """New texts (null where a text stays as it is), lines with words and dropped units of each row; ``look`` says which rows may change, ``copied`` which have a copy."""
    texts, n_lines, n_dropped = [None] * len(column), _lines_with_words(*utf8(column)), np.zeros(len(column), np.int64)
    at = np.flatnonzero(look)
    offsets, data = utf8(column.take(pa.array(at)))
    for low, high in chunks(offsets, CACHED_BYTES):
        w = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], SPACE_WORDS, True)
        u = Units(w)
        for r, (cuts, count) in _cuts(u, w, gone_of(at[low + u.row], u.hash), copied[at[low:]], lambda r, h, low=low: whole_run(at[low + r], h)).items():
            raw = data[offsets[low + r] : offsets[low + r + 1]].tobytes()
            kept, done = [], 0
            for a, b in cuts:
                kept.append(raw[done:a])
                done = min(b, len(raw))
            kept.append(raw[done:])
            new = b"".join(kept)
            if cuts[-1][1] > len(raw) and new.endswith(b"\n"):
                new = new[:-1]
            i = int(at[low + r])
            texts[i], n_dropped[i] = new, count
    return texts, n_lines, n_dropped


def without_recurring(docs: DataFrame, lines: DataFrame, texts_of: DataFrame, family: DataFrame) -> DataFrame:
    """``docs`` (columns named by position, text the last) with ``lines`` (hashes of units) gone from text, and n_lines and n_dropped as last columns.

    ``texts_of`` has (line, source, before_short) of these units at least.
    """
    columns = docs.columns
    *others, text = columns
    docs = docs.withColumn(text, F.col(text).cast("string"))
    schema = docs.schema.add("n_lines", "long").add("n_dropped", "long")
    n_lines = lines.count()
    touched = texts_of.select("line", "source", "before_short").join(_few(lines, n_lines), "line")
    few = n_lines <= BROADCAST_LINES
    # Only texts with a unit that goes are looked at; whether they have a copy is known of each of them. Hashes that are
    # too many to send are joined to the texts that have them.
    drop = F.collect_list("line") if not few else F.lit(None).cast("array<long>")
    hit = stored(touched.groupBy("source").agg(drop.alias("drop"), F.max("before_short").alias("before_short")).join(family.select("source", "copied"), "source"), "lines-hit", small=True)
    dropped(texts_of)
    n_hit = hit.count()
    table = np.sort(lines.toArrow().column("line").to_numpy().astype(np.int64)) if few else None

    def among(lists: pa.Array, sorted_: np.ndarray | None):
        """Whether a hash is among a row's ``lists``, or in the table that holds for all rows."""
        if sorted_ is not None:
            return lambda _, found: _in(sorted_, found)
        own = [frozenset(x or ()) for x in lists.to_pylist()]
        return lambda row, found: np.fromiter((h in own[r] for r, h in zip(row.tolist(), found.tolist())), bool, len(found))

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {*_runs(batch.column(0), batch.column(1).to_numpy(), among(batch.column(2), table))}
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["run", "source"])

    # A run begins with a sentence that goes and that short ones follow, so texts that have none have no run.
    around = hit.filter("before_short").select("source", "drop")
    texts = docs.select(F.col(text).alias("text"), _source(text).alias("source")).join(_few(around, n_hit) if few else around.hint("merge"), "source").select("text", "source", "drop")
    runs = stored(texts.mapInArrow(released(runs_of), "run long, source long").distinct(), "lines-runs", small=True)
    often = runs.join(_few(family.select("source", "family"), n_hit), "source").groupBy("run").agg(F.count_distinct("family").alias("docs")).filter(F.col("docs") >= MIN_DOCS).select("run")
    often = stored(often, "lines-often", small=True)
    few_runs = often.count() <= BROADCAST_LINES
    run_table = np.sort(often.toArrow().column("run").to_numpy().astype(np.int64)) if few_runs else None
    own_runs = F.lit(None).cast("array<long>").alias("runs")
    if not few_runs:
        hit = hit.join(runs.join(often, "run").groupBy("source").agg(F.collect_list("run").alias("runs")), "source", "left")
    else:
        hit = hit.select("*", own_runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, hits, copied, drops, runs = batch.columns[len(others) :]
            gone_of, in_runs = among(drops, table), among(runs, run_table)
            changes = _rewritten(old, hits.is_valid().to_numpy(zero_copy_only=False), copied.fill_null(False).to_numpy(zero_copy_only=False), gone_of, lambda r, h: in_runs(np.array([r]), np.array([h]))[0])
            changed = pa.array([t is not None for t in changes[0]], pa.bool_())
            new = pc.if_else(changed, pa.array(changes[0], pa.binary()).cast(pa.string()), old)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], new, pa.array(changes[1]), pa.array(changes[2])], [*others, text, "n_lines", "n_dropped"])

    keyed = docs.join(_few(hit, n_hit) if few and few_runs else hit.hint("merge"), _source(text) == F.col("source"), "left")
    return keyed.select(*columns, "source", "copied", "drop", "runs").mapInArrow(released(run), schema)


def _deduplicated(docs: DataFrame, exact_families: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without recurring units, columns named by position, with n_lines and n_dropped; and the name of each column."""
    rows, name = by_position(docs)
    text = name["text"]
    seen = units_of(docs)
    candidates = Candidates(docs, seen, exact_families)
    dropped(seen)
    lines = recurring_lines(candidates)
    candidates.drop()
    return without_recurring(rows.select(*[c for c in rows.columns if c != text], text), lines, candidates.texts_of, candidates.family), name


def line_dedup(docs: DataFrame, exact_families: bool = False) -> DataFrame:
    """doc_id, text without recurring lines and sentences, n_lines and n_dropped, one row a row of ``docs``.

    ``exact_families`` takes all links of near copies, by the exact join, in place of those that stars find.
    """
    out, name = _deduplicated(docs.select("doc_id", "text"), exact_families)
    return out.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"), "n_lines", "n_dropped")


def lines_filtered(docs: DataFrame, exact_families: bool = False) -> DataFrame:
    """``docs`` without recurring lines and sentences; n_chars follows. For ``exact_families`` see :func:`line_dedup`."""
    out, name = _deduplicated(docs, exact_families)
    if "n_chars" in name:
        at = name["n_chars"]
        out = out.withColumn(at, F.when(F.col("n_dropped") == 0, F.col(at)).otherwise(F.length(name["text"])).cast(docs.schema["n_chars"].dataType))
    return out.select(*name.values()).toDF(*docs.columns)
